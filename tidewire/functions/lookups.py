"""Small fixed tables: services, vendors, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Well-known services as port, protocols and name; of a port's names the first counts.
_SERVICES = """
20 tcp ftp-data, 21 tcp ftp, 22 tcp/udp ssh, 23 tcp telnet, 25 tcp smtp, 53 tcp/udp domain, 67 udp dhcps, 68 udp dhcpc, 69 udp tftp, 80 tcp http, 88 tcp kerberos, 110 tcp pop3, 111 tcp/udp rpcbind,
113 tcp ident, 119 tcp nntp, 123 udp ntp, 135 tcp msrpc, 137 udp netbios-ns, 138 udp netbios-dgm, 139 tcp netbios-ssn, 143 tcp imap, 161 udp snmp, 162 udp snmptrap, 179 tcp bgp, 194 tcp irc,
389 tcp ldap, 443 tcp/udp https, 445 tcp microsoft-ds, 465 tcp smtps, 500 udp isakmp, 514 udp syslog, 515 tcp printer, 520 udp route, 523 udp ibm-db2, 539 udp apertus-ldp, 554 tcp rtsp,
559 udp nntp-ssl, 587 tcp submission, 593 tcp http-rpc-epmap, 623 udp asf-rmcp, 626 udp asia, 631 tcp/udp ipp, 636 tcp ldaps, 646 tcp ldp, 853 tcp domain-s, 873 tcp rsync, 902 tcp vmware-authd,
993 tcp imaps, 995 tcp pop3s, 998 udp puparp, 1022 udp exp2, 1023 udp netvenuechat, 1025 tcp nfs-or-iis, 1026 tcp lsa-or-nterm, 1027 tcp/udp iis, 1029 tcp ms-lsa, 1080 tcp socks, 1194 udp openvpn,
1433 tcp ms-sql-s, 1434 udp ms-sql-m, 1521 tcp oracle, 1701 udp l2tp, 1720 tcp h323q931, 1723 tcp pptp, 1741 tcp cisco-net-mgmt, 1755 tcp wms, 1812 udp radius, 1883 tcp mqtt, 1900 udp upnp,
2000 tcp cisco-sccp, 2001 tcp dc, 2002 udp globe, 2049 tcp/udp nfs, 2082 tcp cpanel, 2083 tcp cpanels, 2086 tcp gnump3d-http, 2087 tcp whm, 2121 tcp ftp-proxy, 2181 tcp eforward,
2222 tcp ethernet-ip-s, 2323 tcp telnet-alt, 2375 tcp docker, 2376 tcp docker-tls, 2404 tcp iec-104, 2455 tcp wago-io, 2483 tcp oracle-ttc, 3000 tcp ppp, 3128 tcp squid-http, 3260 tcp iscsi-target,
3268 tcp globalcatLDAP, 3283 udp net-assistant, 3306 tcp mysql, 3389 tcp/udp ms-wbt-server, 3689 tcp daap, 3690 tcp svn, 3702 udp ws-discovery, 4000 tcp remoteanything, 4040 tcp yo-main,
4444 tcp krb524, 4500 udp ipsec-nat-t, 4567 tcp tram, 5000 tcp upnp, 5001 tcp commplex-link, 5009 tcp airport-admin, 5051 tcp ida-agent, 5060 tcp/udp sip, 5061 tcp sips, 5222 tcp xmpp-client,
5353 udp zeroconf, 5355 udp llmnr, 5357 tcp wsdapi, 5432 tcp postgresql, 5555 tcp freeciv, 5601 tcp kibana, 5631 tcp pcanywheredata, 5666 tcp nrpe, 5800 tcp vnc-http, 5900 tcp vnc, 5901 tcp vnc-1,
5984 tcp couchdb, 5985 tcp wsman, 5986 tcp wsmans, 6000 tcp/udp x11, 6001 tcp x11-1, 6379 tcp redis, 6443 tcp kubernetes-api, 6667 tcp irc, 6697 tcp ircs-u, 7000 tcp/udp afs3-fileserver,
7001 tcp afs3-callback, 7070 tcp realserver, 7077 tcp spark, 7080 tcp empowerid, 7443 tcp oracleas-https, 7474 tcp neo4j, 8000 tcp http-alt, 8001 tcp vcom-tunnel, 8008 tcp http, 8009 tcp ajp13,
8010 tcp xmpp, 8020 tcp intu-ec-svcdisc, 8080 tcp http-proxy, 8081 tcp blackice-icecap, 8082 tcp blackice-alerts, 8083 tcp us-srv, 8086 tcp influxdb, 8087 tcp simplifymedia, 8088 tcp radan-http,
8090 tcp opsmessaging, 8091 tcp couchbase, 8093 tcp couchbase-query, 8123 tcp home-assistant, 8161 tcp activemq, 8443 tcp https-alt, 8500 tcp consul, 8530 tcp wsman-http, 8531 tcp wsmans-http,
8649 tcp ganglia, 8686 tcp sun-as, 8761 tcp eureka, 8888 tcp ddi-tcp-1, 8889 tcp ddi-tcp-2, 9000 tcp cslistener, 9001 tcp/udp tor-orport, 9002 tcp dynamid, 9009 tcp pichat, 9010 tcp sdr,
9042 tcp cassandra-native, 9043 tcp webSphere, 9080 tcp glrpc, 9090 tcp zeus-admin, 9091 tcp xmltec-xmlmail, 9092 tcp kafka, 9100 tcp jetdirect, 9200 tcp elasticsearch,
9300 tcp elasticsearch-cluster, 9418 tcp git, 9443 tcp tungsten-https, 9535 tcp man, 9800 tcp webdav, 9900 tcp iua, 9999 tcp abyss, 10000 tcp snet-sensor-mgmt, 10001 tcp scp-config,
10250 tcp kubelet, 10255 tcp kubelet-readonly, 11211 tcp/udp memcached, 15672 tcp rabbitmq-mgmt, 16992 tcp amt-soap-http, 16993 tcp amt-soap-https, 27017 tcp mongodb, 27018 tcp mongodb-shard,
28017 tcp mongodb-web, 31337 udp elite, 32400 tcp plex, 33060 tcp mysqlx, 37777 tcp dvr-portmapper, 50000 tcp ibm-db2-ii
"""
SERVICES: tuple[tuple[int, str, str], ...] = tuple((int(port), proto, name) for port, protos, name in (entry.split() for entry in _SERVICES.split(",")) for proto in protos.split("/"))

#: Ports by how often they are open, the most often first.
TOP_TCP: tuple[int, ...] = (
    80, 23, 443, 21, 22, 25, 3389, 110, 445, 139, 143, 53, 135, 3306, 8080, 1723, 111, 995, 993, 5900, 1025, 587, 8888, 199, 1720, 113, 5901, 1026, 2000, 179, 8081, 1027, 2001, 5984, 5985, 1028, 873,
    1029, 1755, 2049, 1030, 3000, 5432, 3128, 5000, 5001, 5800, 8443, 9000, 10000, 2121, 2601, 2604, 32764, 3333, 554, 7070, 8008, 8082, 8889, 9090, 49152, 515, 544, 631, 2002, 2401, 3369, 4000,
    464, 5101, 5190, 6646, 8000, 8009, 8090, 9443, 10010, 1218, 264, 371, 513, 548, 625, 2100, 3001, 3168, 3388, 4001, 5009, 5051, 5060, 5120, 5566, 5631, 5801, 6000, 6001, 6379, 6667, 7000,
    7001, 7937, 8180, 8888, 9001, 9080, 9200, 9300, 10001, 11211, 15672, 27017, 32400, 33060, 50000, 1024, *range(1031, 1094),
)
TOP_UDP: tuple[int, ...] = (
    631, 161, 1434, 123, 137, 138, 445, 135, 67, 53, 520, 500, 623, 69, 998, 1900, 5353, 3702, 162, 514, 4500, 5060, 1025, 1026, 1027, 1028, 1701, 11211, 2002, 2049, 3283, 49152, 5355,
    5222, 7000, 9001, 10000, 16080, 31337, 32764, 33434, 4569, 5061, 5432, 6646, 8000, 8080, 8443, 9103, 11300, 12345, 27017, 3306, 5900, 6000, 6001, 3000, 4444, 5555, 9999,
)

#: MAC prefixes by vendor.
_PREFIXES = {
    "VMware": "00:05:69 00:0c:29 00:1c:14 00:50:56", "Oracle VirtualBox": "08:00:27 0a:00:27", "Microsoft Hyper-V": "00:15:5d", "Parallels": "00:1c:42", "QEMU/KVM": "52:54:00", "Xen": "00:16:3e",
    "Docker bridge": "02:42:ac", "Raspberry Pi Foundation": "b8:27:eb", "Raspberry Pi Trading": "dc:a6:32 e4:5f:01",
    "Espressif (ESP32)": "28:cd:c1 30:ae:a4 5c:cf:7f 84:0d:8e a4:cf:12 bc:dd:c2 60:01:94 24:0a:c4", "Edimax": "74:da:38 00:1f:1f 80:1f:02", "Google": "00:1a:11 f4:f5:e8 3c:5a:b4",
    "Apple": "3c:07:54 f0:18:98 a4:83:e7 ac:bc:32 d0:81:7a f4:5c:89 34:c0:59", "Samsung": "00:1a:8a b0:25:aa 8c:77:12 34:23:87 78:1f:db", "Xiaomi": "34:be:00 64:09:80 98:fa:e3 f0:b4:29 00:9e:c8 28:6c:07",
    "Intel": "a0:88:b4 3c:fd:fe 94:e6:f7 5c:e0:c5 7c:7a:91 00:1b:21", "Dell": "00:1a:6b 00:14:22 f8:bc:12 b8:ac:6f", "HP": "00:1f:29 3c:d9:2b a0:d3:c1", "Hewlett Packard": "00:1a:4b",
    "AzureWave": "2c:cf:67 00:15:af 74:2f:68 dc:85:de", "Hon Hai": "00:22:68 9c:d2:1e 1c:66:6d", "Universal Global Scientific": "00:1e:37", "Realtek": "00:e0:4c 00:0e:8e",
    "ASUSTek": "2c:4d:54 f4:6d:04 d8:50:e6 50:46:5d 00:0e:a6", "Giga-Byte": "94:de:80 1c:6f:65", "Elitegroup": "00:21:97 00:19:21",
    "TP-Link": "00:1d:0f 50:c7:bf 14:cc:20 30:b5:c2 ac:84:c6 f8:1a:67 ec:08:6b f4:ec:38 14:cf:92 c4:6e:1f 00:27:19", "Huawei": "00:1e:10 00:18:82 48:43:5a d0:2d:b3 00:34:fe 00:e0:fc",
    "Netgear": "00:0f:b5 20:e5:2a 9c:3d:cf 00:1b:2f 00:26:f2", "D-Link": "00:1e:58 1c:bd:b9 c8:d3:a3 00:26:5a", "Cisco-Linksys": "00:0c:41 20:aa:4b 58:6d:8f",
    "Cisco Systems": "00:11:92 58:97:1e 00:00:0c 00:1b:54 58:97:bd", "Ubiquiti": "fc:75:16 78:8a:20 04:18:d6 f0:9f:c2 24:a4:3c 00:15:6d", "Aruba Networks": "00:0b:86 24:de:c6",
    "MikroTik": "00:0c:42 4c:5e:0c b8:69:f4 e4:8d:8c d4:ca:6d 74:4d:28", "DrayTek": "00:1d:aa", "Belkin": "58:ef:68 08:86:3b", "Sonos": "e8:9a:ff b8:e9:37 78:28:ca", "Sony": "00:13:a9 fc:0f:e6 00:d9:d1",
    "LG Electronics": "00:22:a9 c4:43:8f a0:39:f7", "Check Point": "00:1c:7f", "Gemtek": "00:1a:73", "Cameo Communications": "00:18:e7", "Arris": "00:22:10",
    "Amazon": "dc:b4:c4 44:65:0d 68:37:e9 74:c2:46 fc:65:de 68:54:fd", "Microsoft": "28:18:78 60:45:bd 7c:1e:52 00:1d:d8",
}
VENDORS: tuple[tuple[str, str], ...] = tuple((prefix, vendor) for vendor, prefixes in _PREFIXES.items() for prefix in prefixes.split())

#: Names of DNS record types and reply codes; flows name fewer types.
DNS_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 39: "DNAME", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY",
    50: "NSEC3", 52: "TLSA", 64: "SVCB", 65: "HTTPS", 99: "SPF", 255: "ANY", 256: "URI", 257: "CAA",
}
DNS_FLOW_TYPES = {k: v for k, v in DNS_TYPES.items() if k not in (39, 41, 47, 50, 52, 64, 257)}
DNS_RCODES = {
    0: "No error", 1: "Format error", 2: "Server failure", 3: "Non-existent domain (NXDOMAIN)", 4: "Not implemented", 5: "Query refused", 6: "Name exists when it should not",
    7: "RR set exists when it should not", 8: "RR set that should exist does not", 9: "Server not authoritative for zone", 10: "Name not contained in zone",
}
#: Names of ether types, IP protocols, options, operations and modes.
ETHER_TYPES = {0x0800: "IPv4 (0x0800)", 0x0806: "ARP (0x0806)", 0x86DD: "IPv6 (0x86dd)", 0x8100: "802.1Q VLAN", 0x88A8: "802.1ad QinQ", 0x88CC: "LLDP", 0x8864: "PPPoE", 0x0842: "Wake-on-LAN"}
IP_PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6 encapsulation", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 103: "PIM", 132: "SCTP"}
IP_OPTIONS = {0: "End of options", 1: "NOP", 2: "Security", 3: "Loose source route", 4: "Timestamp", 6: "Strict source route", 7: "Record route"}
TCP_OPTIONS = {0: "End of options", 1: "NOP", 2: "MSS", 3: "Window scale", 4: "SACK permitted", 5: "SACK", 8: "Timestamps", 19: "TCP MD5 signature", 29: "TCP-AO", 34: "TFO (fast open)"}
ARP_OPERATIONS = {1: "request", 2: "reply", 3: "request reverse", 4: "reply reverse", 8: "gratuitous"}
DHCP_MESSAGES = {1: "DISCOVER", 2: "OFFER", 3: "REQUEST", 4: "DECLINE", 5: "ACK", 6: "NAK", 7: "RELEASE", 8: "INFORM"}
NTP_MODES = {1: "symmetric active", 2: "symmetric passive", 3: "client", 4: "server", 5: "broadcast", 6: "control message", 7: "private"}
#: ICMP types and codes, TCP flags in wire order.
ICMP_TYPES = {0: "Echo reply (ping)", 8: "Echo request (ping)", 3: "Destination unreachable", 5: "Redirect", 11: "Time exceeded (fragment reassembly)", 12: "Parameter problem"}
ICMP_CODES = {(3, 0): "Destination network unreachable", (3, 1): "Destination host unreachable", (3, 3): "Destination port unreachable", (3, 4): "Fragmentation needed and DF set", (11, 0): "Time exceeded (TTL)"}
ICMP6_TYPES = {128: "ICMPv6 echo request", 129: "ICMPv6 echo reply"}
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")


def service_table(spark: SparkSession) -> DataFrame:
    """(port, proto, service), one row for each port and protocol; a fixed table, so broadcasting it is bounded."""
    return spark.createDataFrame(SERVICES, "port int, proto string, service string").dropDuplicates(["port", "proto"])


def services_from(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a text table of names, ``port/protocol`` and comments, where a system keeps its own; the least name of a port counts."""
    words = spark.read.text(path).select(F.split(F.trim(F.substring_index("value", "#", 1)), r"\s+").alias("w"))
    place = F.split(F.get("w", F.lit(1)), "/")
    rows = words.select(F.get(place, F.lit(0)).try_cast("int").alias("port"), F.lower(F.get(place, F.lit(1))).alias("proto"), F.get("w", F.lit(0)).alias("service"))
    return rows.where("port between 0 and 65535 and proto is not null").groupBy("port", "proto").agg(F.min("service").alias("service"))


def top_ports(spark: SparkSession, proto: str, n: int = 0) -> DataFrame:
    """(rank from 1, port) of the ``n`` ports that are open most often; all for 0.  A port that is listed twice keeps its first rank."""
    known = TOP_UDP if proto == "udp" else TOP_TCP
    kept = dict.fromkeys(known[: n or len(known)])
    return spark.createDataFrame([(known.index(p) + 1, p) for p in kept], "rank int, port int")


def vendor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENDORS, "prefix string, vendor string")


def named(code: Column, names: dict[int, str], other: str | None) -> Column:
    """The name of a code by one look-up; else ``other``, with the code where it has a place for it."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, code.cast("int"))
    if other is None:
        return found
    return F.when(code.isNotNull(), F.coalesce(found, F.format_string(other, code) if "%" in other else F.lit(other)))


def name_of(code: Column, names: dict[int, str], other: str) -> Column:
    """The name of a code, or ``other`` with the code in it."""
    out = F.format_string(other, code)
    for value, name in names.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def icmp_name(kind: Column, code: Column, ipv6: Column) -> Column:
    """What an ICMP message says, by type and code, for either version."""
    other = F.format_string("ICMP%s type %d code %d", F.when(ipv6, "v6").otherwise(""), kind, code)
    out = F.when(F.lit(False), other)
    for (k, c), name in ICMP_CODES.items():
        out = out.when(~ipv6 & (kind == k) & (code == c), name)
    for six, names in ((False, ICMP_TYPES), (True, ICMP6_TYPES)):
        for k, name in names.items():
            out = out.when((ipv6 == six) & (kind == k), name)
    return out.otherwise(other)


def service_name(df: DataFrame, port: str = "port", proto: str = "proto", more: DataFrame | None = None) -> DataFrame:
    """Add ``service`` by a broadcast look-up; ports without a name are ``unknown``.

    ``more`` (see :func:`services_from`) names ports that the fixed table does not; there are
    at most 65,536 of each protocol.
    """
    known = service_table(df.sparkSession)
    if more is not None:
        known = known.unionByName(more.join(F.broadcast(known), ["port", "proto"], "left_anti"))
    names = known.select(F.col("port").alias("_port"), F.col("proto").alias("_proto"), "service")
    joined = df.join(F.broadcast(names), (df[port] == F.col("_port")) & (df[proto] == F.col("_proto")), "left")
    return joined.drop("_port", "_proto").withColumn("service", F.coalesce("service", F.lit("unknown")))


def vendor_name(df: DataFrame, mac: str = "mac") -> DataFrame:
    """Add ``vendor`` of a MAC address, or NULL."""
    names = F.broadcast(vendor_table(df.sparkSession))
    return df.join(names, F.substring(df[mac], 1, 8) == names["prefix"], "left").drop("prefix")
