"""Services by what they say first: banners against a table of signatures.

Few banners get as far as a regular expression: every signature names literals of which a
banner must hold one, told by a search of bytes (or by the port alone where it has one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode.binary import let


@dataclass(frozen=True)
class Signature:
    """``literals`` in small letters, one of which every banner that fits has; ``$n`` in texts stands for a group."""

    pattern: str
    service: str
    product: str
    version: int
    extra: str
    confidence: int
    port: int
    literals: tuple[str, ...]


#: Pattern, service, product, group of the version, extra text, confidence, port (0 for any); and their literals.
SIGNATURES: tuple[Signature, ...] = tuple(
    Signature(*row)
    for row in (
        (r"^SSH-[12]\.[0-9]+-OpenSSH[_ ]([0-9][^\s\r\n]*)[^\r\n]*", "ssh", "OpenSSH", 1, "", 9, 0, ("-openssh",)),
        (r"^SSH-[12]\.[0-9]+-Dropbear[_ ]([0-9][^\s\r\n]*)", "ssh", "Dropbear SSH", 1, "", 9, 0, ("-dropbear",)),
        (r"^SSH-[12]\.[0-9]+-([A-Za-z0-9_.\-]+)", "ssh", "$1", 0, "SSH banner", 7, 0, ("ssh-",)),
        (r"^HTTP/([12](?:\.[01])?)\s+([0-9]{3})", "http", "", 0, "HTTP $1 response, status $2", 7, 0, ("http/",)),
        (r"(?i)^server:\s*([^\r\n]+)", "http", "$1", 0, "", 6, 0, ("server:",)),
        (r"^RTSP/1\.0\s+([0-9]{3})", "rtsp", "", 1, "RTSP status $1", 7, 554, ("rtsp/",)),
        (r"^SIP/2\.0\s+([0-9]{3})", "sip", "", 1, "SIP status $1", 7, 5060, ("sip/",)),
        (r"^220[ \-][^\r\n]*FTP", "ftp", "", 0, "", 7, 0, ("ftp",)),
        (r"(?i)vsFTPd ([0-9][0-9.]*)[^\r\n]*", "ftp", "vsftpd", 1, "", 9, 0, ("vsftpd ",)),
        (r"(?i)ProFTPD(?:[ \t]+([0-9][0-9.a-z]*))?", "ftp", "ProFTPD", 1, "", 8, 0, ("proftpd",)),
        (r"(?i)Pure-FTPd", "ftp", "Pure-FTPd", 0, "", 8, 0, ("pure-ftpd",)),
        (r"(?i)FileZilla Server(?: ([0-9][0-9.]*))?", "ftp", "FileZilla Server", 1, "", 8, 0, ("filezilla server",)),
        (r"^220[ \-][^\r\n]*(?:SMTP|ESMTP)", "smtp", "", 0, "", 7, 0, ("smtp",)),
        (r"(?i)(Postfix|Exim|Sendmail|Microsoft ESMTP|hMailServer)", "smtp", "$1", 0, "", 8, 0, ("postfix", "exim", "sendmail", "microsoft esmtp", "hmailserver")),
        (r"^220[ \-][^\r\n]*POP3", "pop3", "", 0, "", 7, 0, ("pop3",)),
        (r"^\+OK[^\r\n]*Dovecot", "pop3", "Dovecot", 0, "", 8, 0, ("dovecot",)),
        (r"^\* OK[^\r\n]*IMAP", "imap", "", 0, "", 7, 0, ("imap",)),
        (r"^\* OK[^\r\n]*Dovecot", "imap", "Dovecot", 0, "", 8, 0, ("dovecot",)),
        (r"^\* OK[^\r\n]*(?:Cyrus|UW IMAP)", "imap", "$1", 0, "", 8, 0, ("cyrus", "uw imap")),
        (r"^220[ \-][^\r\n]*NNTP", "nntp", "", 0, "", 7, 119, ("nntp",)),
        (r"(?i)^MySQL|^\x2e\x00\x00\x00\x0a([0-9][0-9.]*)[^\r\n]*", "mysql", "MySQL", 1, "", 8, 0, ("mysql", "\x2e\0\0\0")),
        (r"([0-9]+\.[0-9]+\.[0-9]+)-MariaDB", "mysql", "MariaDB", 1, "", 9, 0, ("-mariadb",)),
        (r"(?i)PostgreSQL ([0-9][0-9.]*)[^\r\n]*", "postgresql", "PostgreSQL", 1, "", 9, 5432, ("postgresql ",)),
        (r"^\-ERR[^\r\n]*(?:unknown command|wrong number)", "redis", "Redis", 0, "", 7, 6379, ("-err",)),
        (r"^\+PONG", "redis", "Redis", 0, "", 9, 6379, ("+pong",)),
        (r"^VERSION ([0-9][0-9.]*)\r?\n", "memcached", "Memcached", 1, "", 9, 11211, ("version ",)),
        (r"^STAT [a-z_]+ [0-9]+\r\n", "memcached", "Memcached", 0, "", 7, 11211, ("stat ",)),
        (r"^AMQP", "amqp", "RabbitMQ", 0, "AMQP protocol header", 7, 5672, ("amqp",)),
        (r"^\x10[^\r\n]{0,4}MQTT", "mqtt", "MQTT broker", 0, "", 7, 1883, ("mqtt",)),
        (r'(?i)\"cluster_name\"\s*:\s*\"([^\"]+)\"', "http", "Elasticsearch", 0, "cluster $1", 9, 9200, ('"cluster_name"',)),
        (r"^\xffSMB|\xfeSMB", "microsoft-ds", "Samba or Windows SMB", 0, "SMB dialect negotiation", 7, 445, ("smb",)),
        (r"^RFB 0*([0-9]{3}\.[0-9]{3})", "vnc", "RFB", 1, "", 8, 5900, ("rfb ",)),
        (r"^\x03\x00\x00", "ms-wbt-server", "Microsoft Terminal Services", 0, "RDP negotiation", 7, 3389, ("\x03\0\0",)),
        (r"^\xff[\xfd\xfb\xfc]", "telnet", "", 0, "telnet option negotiation", 7, 23, ("\xff",)),
        (r"^@RSYNCD: ([0-9.]+)", "rsync", "rsyncd", 1, "", 9, 873, ("@rsyncd",)),
        (r"(?i)^220[^\r\n]*rsync", "rsync", "rsyncd", 0, "", 7, 873, ("rsync",)),
        (r"^Connected to ([^\r\n]*MongoDB)", "mongodb", "MongoDB", 0, "$1", 8, 27017, ("mongodb",)),
        (r"^\{[^\r\n]*\"jsonrpc\"", "jsonrpc", "", 0, "JSON-RPC response", 6, 0, ('"jsonrpc"',)),
        (r"^(?:<!DOCTYPE html|<html|<HTML)", "http", "", 0, "HTML response", 5, 0, ("<!doctype html", "<html")),
        (r"^ldap_bind|^\x30\x0c\x02\x01\x01h", "ldap", "", 0, "LDAP response", 6, 389, ("ldap_bind", "\x30\x0c")),
        (r"(?i)netbios|NBSTAT", "netbios-ssn", "", 0, "", 6, 137, ("netbios", "nbstat")),
        (r"^HTTP/1\.[01] 200[^\r\n]*\r\n(?s).*upnp", "upnp", "", 0, "SSDP response", 7, 1900, ("upnp",)),
        (r"(?i)ntp|stratum", "ntp", "", 0, "", 5, 123, ("ntp", "stratum")),
        (r"(?i)sysDescr|SNMPv", "snmp", "", 0, "", 6, 161, ("sysdescr", "snmpv")),
    )
)


def groups(pattern: str) -> int:
    """Capturing groups of a pattern: brackets that are no escape, no class and no ``(?``."""
    n, inside, k = 0, False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(" and pattern[k + 1] != "?":
            n += 1
        k += 1
    return n


def _filled(banner: Column, signature: Signature, template: str) -> Column:
    """A template with its groups put in, trimmed; a group that the pattern has not or that met nothing is empty."""
    parts, rest = [], template
    while "$" in rest:
        before, _, after = rest.partition("$")
        number = int(after[0])
        parts += [F.lit(before), F.regexp_extract(banner, signature.pattern, number) if number <= groups(signature.pattern) else F.lit("")]
        rest = after[1:]
    return F.trim(F.concat(*parts, F.lit(rest))) if parts else F.lit(template)


def match_banner(banner: Column, port: Column) -> Column:
    """Struct of service, product, version, extra and confidence; of equal confidence the earlier signature; NULL if none fits."""

    def best(low: Column) -> Column:
        fits = []
        for order, s in enumerate(SIGNATURES):
            held = low.contains(s.literals[0])
            for literal in s.literals[1:]:
                held = held | low.contains(literal)
            here = (port == s.port) & held if s.port else held
            fits.append(F.when(here & banner.rlike(s.pattern), F.struct(F.lit(s.confidence).alias("confidence"), F.lit(-order).alias("rank"))))
        return F.array_max(F.array_compact(F.array(*fits)))

    def told(found: Column) -> Column:
        out = None
        for order, s in enumerate(SIGNATURES):
            version = F.trim(F.regexp_extract(banner, s.pattern, s.version)) if s.version else F.lit("")
            row = F.struct(F.lit(s.service).alias("service"), _filled(banner, s, s.product).alias("product"), version.alias("version"), _filled(banner, s, s.extra).alias("extra"), F.lit(s.confidence).alias("confidence"))
            out = F.when(found["rank"] == -order, row) if out is None else out.when(found["rank"] == -order, row)
        return out

    return let(let(F.lower(banner), best), told)


def match_services(ports: DataFrame) -> DataFrame:
    """The best signature of each banner; rows whose banner fits none are left out."""
    best = ports.withColumn("_best", match_banner(F.col("banner"), F.col("port"))).where("_best is not null")
    return best.select("scan_id", "address", "proto", "port", "_best.service", "_best.product", "_best.version", "_best.extra", "_best.confidence")


def apply_match(match: Column, probe: Column, service: Column, product: Column, version: Column, extra: Column, confidence: Column) -> dict[str, Column]:
    """A port's columns after a match: the service is replaced, the others filled where empty, the greater confidence counts.

    The extra text and the name of the probe that met the answer are joined by ``; ``.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    told = F.array_join(F.array_compact(F.array(some(match["extra"]), F.when(some(probe).isNotNull(), F.concat(F.lit("probe "), probe)))), "; ")
    hit = match.isNotNull()
    return {
        "service": F.coalesce(some(match["service"]), service),
        "product": F.coalesce(some(product), match["product"], product),
        "version": F.coalesce(some(version), match["version"], version),
        "extra": F.when(hit, F.coalesce(some(extra), told)).otherwise(extra),
        "confidence": F.when(hit, F.greatest(confidence, match["confidence"])).otherwise(confidence),
    }
