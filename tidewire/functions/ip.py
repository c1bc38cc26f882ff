"""Addresses: order-preserving keys, ranges and classes.

A key is hexadecimal text: ``04`` and 8 digits for IPv4, ``06`` and 32 digits for IPv6.
Keys compare like addresses (all of IPv4 first), so a network is a range of keys and range
predicates reach the Parquet statistics.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(address: str) -> str:
    """The key of an address literal."""
    ip = ipaddress.ip_address(address)
    return f"0{ip.version}{int(ip):0{8 if ip.version == 4 else 32}x}"


def key_range(network: str) -> tuple[str, str]:
    """First and last key of a network literal; host bits are ignored."""
    net = ipaddress.ip_network(network, strict=False)
    return key_of(str(net.network_address)), key_of(str(net.broadcast_address))


def ipv4_key(text: Column) -> Column:
    """The key of dotted-quad text, NULL if it is none; built-in functions only."""
    quad = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    parts = [F.regexp_extract(text, quad, i).try_cast("int") for i in range(1, 5)]
    fits = F.greatest(*parts) <= 255
    return F.when(fits, F.concat(F.lit("04"), F.format_string("%02x%02x%02x%02x", *parts)))


def ipv4_text(key: Column) -> Column:
    """Dotted-quad text of an IPv4 key."""
    octet = lambda at: F.conv(F.substring(key, at, 2), 16, 10)
    return F.when(key.startswith("04"), F.concat_ws(".", *[octet(at) for at in (3, 5, 7, 9)]))


def ipv4_number(key: Column) -> Column:
    return F.when(key.startswith("04"), F.conv(F.substring(key, 3, 8), 16, 10).cast("long"))


def number_key(number: Column) -> Column:
    return F.concat(F.lit("04"), F.format_string("%08x", number))


def within(key: Column, network: str) -> Column:
    low, high = key_range(network)
    return key.between(low, high)


def _any(key: Column, networks: list[str]) -> Column:
    out = F.lit(False)
    for n in networks:
        out = out | within(key, n)
    return out


#: Address classes, the first that holds an address names it.
CLASSES: tuple[tuple[str, list[str]], ...] = (
    ("unspecified", ["0.0.0.0/32", "::/128"]),
    ("loopback", ["127.0.0.0/8", "::1/128"]),
    ("broadcast", ["255.255.255.255/32"]),
    ("multicast", ["224.0.0.0/4", "ff00::/8"]),
    ("link-local", ["169.254.0.0/16", "fe80::/10"]),
    ("private", ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7"]),
    ("reserved", ["0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/16", "198.18.0.0/15", "203.0.0.0/16", "240.0.0.0/4"]),
)


def ip_class(key: Column) -> Column:
    """Name of the class of an address, ``public`` if none holds it."""
    out = F.when(key.isNull(), F.lit(None))
    for name, networks in CLASSES:
        out = out.when(_any(key, networks), name)
    return out.otherwise("public")


def is_private(key: Column) -> Column:
    return _any(key, ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "fc00::/7", "fe80::/10"])


def ipv4_network(key: Column, prefix: Column) -> Column:
    """Key of the network address of an IPv4 key."""
    mask = F.lit(4294967295) - (F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - prefix).cast("int")) - 1)
    return number_key(ipv4_number(key).bitwiseAND(mask))


def host_count(prefix: Column) -> Column:
    """Usable IPv4 addresses of a prefix: all of /31 and /32, else without network and broadcast."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(32) - prefix).cast("int"))
    return F.when(prefix >= 31, size).otherwise(F.least(size - 2, F.lit(2147483648)))


def mac_flags(mac: Column) -> dict[str, Column]:
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")
    return {"multicast": first.bitwiseAND(F.lit(1)) != 0, "local": first.bitwiseAND(F.lit(2)) != 0, "zero": mac == "00:00:00:00:00:00", "broadcast": mac == "ff:ff:ff:ff:ff:ff"}


def mac_text(text: Column) -> Column:
    """Canonical lower-case form of a MAC with any separators, NULL if it has not 12 hex digits."""
    digits = F.lower(F.regexp_replace(text, "[:.-]", ""))
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.regexp_replace(digits, "(..)(?=.)", "$1:"))
