"""Queries over one protocol each, on frames made from the rows of a table, and their SQL over the columns themselves.

Every customer becomes a frame (or two) of the protocol, so the queries check encoding, dissection and the fields of the tree
against SQL that never saw a byte.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.dissect import stage
from tidewire.dissect.headers import be
from tidewire.filters.compiler import displayed
from tidewire.functions import text
from tidewire.operators import reports
from tidewire.plans.traffic import _raw, event_frames, ipv4, order_frames, order_segments, raw_hex, segment_frames, tcp, udp
from tidewire.sources.tables import table

MACS = "020000000001 020000000002"


def _k() -> Column:
    return F.col("c_custkey")


def _frames(spark: SparkSession, folder: str, frame: Column, link: int = 1) -> DataFrame:
    return _raw(table(spark, folder, "customer"), _k(), _k().cast("bigint") * 1_000_000, frame).withColumn("link_type", F.lit(link))


def _fields(raw: DataFrame, wanted: dict[str, tuple[str, str]], stateful: bool = False) -> DataFrame:
    """number and a column for each name in wanted: (field, node column); where a field occurs again the first in its frame."""
    fields = [f for f, _ in wanted.values()]
    nodes = stage.fields((stage.dissect if stateful else stage.dissect_stateless)(raw, keep=fields))
    return nodes.groupBy("number").agg(*(F.min_by(F.when(F.col("field") == f, F.col(c)), F.when(F.col("field") == f, F.col("idx"))).alias(name) for name, (f, c) in wanted.items()))


def _eth(kind: int, payload: Column) -> Column:
    return F.concat(raw_hex(MACS), raw_hex(f"{kind:04x}"), payload)


def _address(first: int) -> Column:
    return F.concat(raw_hex(f"{first:02x}"), be(_k(), 3))


def _udp4(payload: Column, dport: int = 9000) -> Column:
    """An IPv4 packet with a UDP datagram, without link header."""
    return F.substring(ipv4(_address(0x0A), raw_hex("0a0a0a0a"), 17, udp(F.lit(5000), F.lit(dport), payload), _k()), 15, 1 << 20)


def vlan_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Two VLAN tags before UDP: the outer tag's id and priority, and the port behind both."""
    outer, inner = be(_k() % 4096 + (_k() % 8) * 8192, 2), be((_k() + 1) % 4096, 2)
    frame = _eth(0x88A8, F.concat(outer, raw_hex("8100"), inner, raw_hex("0800"), _udp4(F.encode(F.lit("tagged"), "UTF-8"))))
    f = _fields(_frames(spark, folder, frame), {"vlan": ("vlan.id", "u"), "priority": ("vlan.priority", "u"), "port": ("udp.dstport", "u")})
    return f.select("number", "vlan", "priority", "port")


def arp_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Who asks for whom, from the tree and as the packet list says it."""
    frame = _eth(0x0806, F.concat(raw_hex("0001 0800 06 04 0001 020000000002"), _address(0x0A), raw_hex("000000000000"), _address(0x0B)))
    raw = _frames(spark, folder, frame)
    told = stage.dissect_stateless(raw, keep=()).select("number", "protocol", "info")
    f = _fields(raw, {"sender": ("arp.src.proto_ipv4", "a"), "target": ("arp.dst.proto_ipv4", "a"), "opcode": ("arp.opcode", "u")})
    return f.join(told, "number").select("number", text.ip4_text(F.col("sender")).alias("sender"), text.ip4_text(F.col("target")).alias("target"), "opcode", "protocol", "info")


def llc_snap(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 behind LLC and SNAP in a frame with a length in place of a type."""
    packet = _udp4(F.encode(F.lit("snapped"), "UTF-8"), 9001)
    body = F.concat(raw_hex("aaaa03 000000 0800"), packet)
    frame = F.concat(raw_hex(MACS), be(F.length(body), 2), body)
    return _fields(_frames(spark, folder, frame), {"length": ("eth.len", "u"), "dsap": ("llc.dsap", "u"), "type": ("llc.type", "u"), "ident": ("ip.id", "u"), "port": ("udp.dstport", "u")})


def loopback_families(spark: SparkSession, folder: str) -> DataFrame:
    """Loopback frames: the address family in either byte order before IPv4."""
    frame = F.concat(F.when(_k() % 2 == 0, raw_hex("02000000")).otherwise(raw_hex("00000002")), _udp4(F.encode(F.lit("loop"), "UTF-8"), 9002))
    return _fields(_frames(spark, folder, frame, 0), {"family": ("null.family", "u"), "ident": ("ip.id", "u"), "port": ("udp.dstport", "u")})


def _six(nxt: str, payload: Column) -> Column:
    """IPv6 from 2001:db8::k to 2001:db8::1."""
    net = "20010db8 0000000000000000"
    return _eth(0x86DD, F.concat(raw_hex("60000000"), be(F.length(payload), 2), raw_hex(nxt), raw_hex("40"), raw_hex(net), be(_k(), 4), raw_hex(net), raw_hex("00000001"), payload))


def ipv6_extensions(spark: SparkSession, folder: str) -> DataFrame:
    """UDP behind hop-by-hop and destination options, found by a filter on its port; and its conversations."""
    inner = udp(F.lit(5000), 9000 + _k() % 5, F.encode(F.lit("deep"), "UTF-8"))
    raw = _frames(spark, folder, _six("00", F.concat(raw_hex("3c00 0104 00000000"), raw_hex("1100 0104 00000000"), inner)))
    seen = displayed(raw, "udp.dstport == 9003 && ipv6.hlim == 64").select("number", F.lit(True).alias("displayed"))
    talk = reports.packets(raw, "udp").select("number", text.ip6_text(F.col("src.addr")).alias("sender"), F.col("dst.port").alias("port"))
    return talk.join(seen, "number", "left").select("number", "sender", "port", F.coalesce("displayed", F.lit(False)).alias("displayed"))


def icmp_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """ICMP errors: the quoted datagram's identification and port, and the frame's own type and code."""
    quoted = F.substring(_udp4(F.encode(F.lit("lost"), "UTF-8"), 9004), 1, 28)
    frame = ipv4(raw_hex("0a090909"), _address(0x0A), 1, F.concat(raw_hex("0b00 0000 00000000"), quoted), _k() + 1)
    raw = _frames(spark, folder, frame)
    inner = stage.fields(stage.dissect_stateless(raw, keep=["ip.id"])).groupBy("number").agg(F.max_by("u", "idx").alias("quoted"), F.count("*").alias("headers"))
    return _fields(raw, {"type": ("icmp.type", "u"), "code": ("icmp.code", "u"), "port": ("udp.dstport", "u")}).join(inner, "number")


def ndp_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour solicitations: whom they ask for, and the link-layer address they tell."""
    target = F.concat(raw_hex("fe80 000000000000 0000 0000"), be(_k(), 4))
    frame = _six("3a", F.concat(raw_hex("8700 0000 00000000"), target, raw_hex("0101 0200"), be(_k(), 4)))
    f = _fields(_frames(spark, folder, frame), {"type": ("icmpv6.type", "u"), "target": ("icmpv6.nd.ns.target_address", "a"), "mac": ("icmpv6.opt.linkaddr", "a")})
    return f.select("number", "type", text.ip6_text(F.col("target")).alias("target"), text.mac_text(F.col("mac")).alias("mac"))


def dhcp_options(spark: SparkSession, folder: str) -> DataFrame:
    """Discover messages: transaction, host name and requested address."""
    host = F.encode(F.concat(F.lit("c"), _k().cast("string")), "UTF-8")
    options = F.concat(raw_hex("63825363 350101 0c"), be(F.length(host), 1), host, raw_hex("3204"), _address(0x0A), raw_hex("ff"))
    message = F.concat(raw_hex("01010600"), be(_k(), 4), raw_hex("00000000"), F.lit(bytes(16)), raw_hex("020000000002"), F.lit(bytes(10 + 64 + 128)), options)
    frame = ipv4(raw_hex("00000000"), raw_hex("ffffffff"), 17, udp(F.lit(68), F.lit(67), message), _k())
    f = _fields(_frames(spark, folder, frame), {"kind": ("dhcp.option.dhcp", "u"), "transaction": ("dhcp.id", "u"), "host": ("dhcp.option.hostname", "s"), "wanted": ("dhcp.option.requested_ip_address", "a")})
    return f.select("number", "kind", "transaction", "host", text.ip4_text(F.col("wanted")).alias("wanted"))


def _hello() -> Column:
    """A TLS record with a ClientHello that names c<k>.example."""
    name = F.encode(F.concat(F.lit("c"), _k().cast("string"), F.lit(".example")), "UTF-8")
    n = F.length(name)
    extension = F.concat(raw_hex("0000"), be(n + 5, 2), be(n + 3, 2), raw_hex("00"), be(n, 2), name)
    hello = F.concat(raw_hex("0303"), F.lit(bytes(32)), raw_hex("00 0002 1301 01 00"), be(F.length(extension), 2), extension)
    shake = F.concat(raw_hex("01"), be(F.length(hello), 3), hello)
    return F.concat(raw_hex("16 0301"), be(F.length(shake), 2), shake)


def tls_sni(spark: SparkSession, folder: str) -> DataFrame:
    """Server names of ClientHellos, each split over two segments."""
    c = table(spark, folder, "customer").select("c_custkey", _hello().alias("hello")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    mid = F.call_function("div", F.length("hello"), F.lit(2)).cast("int")
    part = F.when(F.col("half") == 0, F.substring("hello", F.lit(1), mid)).otherwise(F.substring("hello", mid + 1, F.length("hello")))
    number = _k() * 2 + F.col("half")
    raw = _raw(c, number, number.cast("bigint") * 1_000_000, ipv4(_address(0x0C), raw_hex("0a050001"), 6, tcp(F.lit(30000), F.lit(443), 1 + F.when(F.col("half") == 1, mid).otherwise(0), 0x18, part), _k()))
    return _fields(raw, {"name": ("tls.handshake.extensions_server_name", "s"), "suite": ("tls.handshake.ciphersuite", "u")}, stateful=True).where("name is not null")


def malformed(spark: SparkSession, folder: str) -> DataFrame:
    """DNS messages of which every third is cut: the frames whose tree says so, and the protocol they are listed under."""
    message = F.concat(be(_k(), 2), raw_hex("0100 0001 0000 0000 0000 07"), F.lit(b"example"), raw_hex("00 0001 0001"))
    message = F.when(_k() % 3 == 0, F.substring(message, 1, 17)).otherwise(message)
    raw = _frames(spark, folder, ipv4(_address(0x0A), raw_hex("0a040002"), 17, udp(F.lit(40000), F.lit(53), message), _k()))
    f = stage.dissect_stateless(raw, keep=["_ws.malformed"])
    return f.select("number", "protocol", (F.size("nodes") > 0).alias("malformed"), F.coalesce(F.col("expert.severity"), F.lit(0)).alias("severity"))


def _ones(words: list[Column]) -> Column:
    """The Internet checksum of 16-bit words."""
    s = reduce(lambda a, b: a + b, words)
    for _ in range(2):
        s = s.bitwiseAND(F.lit(0xFFFF)) + F.shiftright(s, 16)
    return F.lit(0xFFFF) - s


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 headers with a right checksum, every fifth with a wrong one; UDP without any."""
    payload = udp(F.lit(5000), F.lit(9000), F.encode(F.lit("sum"), "UTF-8"))
    k = _k().cast("bigint")
    words = [F.lit(0x4500), F.lit(31), k % 65536, F.lit(0x4000), F.lit(0x4011), F.shiftright(k % (1 << 24), 16) + 0x0A00, k % 65536, F.lit(0x0A0A), F.lit(0x0A0A)]
    right = _ones(words)
    sent = F.when(k % 5 == 0, (right + 1) % 65536).otherwise(right)
    frame = _eth(0x0800, F.concat(raw_hex("4500 001f"), be(_k(), 2), raw_hex("4000 4011"), be(sent, 2), _address(0x0A), raw_hex("0a0a0a0a"), payload))
    f = _fields(_frames(spark, folder, frame), {"ip": ("ip.checksum.status", "u"), "udp": ("udp.checksum.status", "u"), "bad": ("_ws.checksum.bad", "idx")})
    return f.groupBy("ip", "udp", F.col("bad").isNotNull().alias("bad")).agg(F.count("*").alias("frames"))


def padded(spark: SparkSession, folder: str) -> DataFrame:
    """Frames filled up to 60 bytes: how many bytes of padding the tree finds."""
    payload = F.encode(F.repeat(F.lit("p"), (_k() % 30).cast("int")), "UTF-8")
    frame = ipv4(_address(0x0A), raw_hex("0a0a0a0a"), 17, udp(F.lit(5000), F.lit(9000), payload), _k())
    frame = F.concat(frame, F.when(F.length(frame) < 60, F.unhex(F.repeat(F.lit("00"), 60 - F.length(frame)))).otherwise(F.lit(b"")))
    f = stage.fields(stage.dissect_stateless(_frames(spark, folder, frame), keep=["eth.padding"]))
    return f.select("number", (F.col("end") - F.col("start")).cast("bigint").alias("padding"))


def tcp_options(spark: SparkSession, folder: str) -> DataFrame:
    """SYN segments: largest segment, window scale, SACK permission and timestamps."""
    options = F.concat(raw_hex("0204"), be(1000 + _k() % 400, 2), raw_hex("0402 080a"), be(_k(), 4), raw_hex("00000000 01 0303"), be(_k() % 15, 1))
    segment = F.concat(be(F.lit(30000), 2), be(F.lit(7000), 2), be(_k(), 4), raw_hex("00000000 a002 2000 0000 0000"), options)
    frame = ipv4(_address(0x0A), raw_hex("0a030001"), 6, segment, _k())
    return _fields(_frames(spark, folder, frame), {"mss": ("tcp.options.mss_val", "u"), "shift": ("tcp.options.wscale.shift", "u"), "tsval": ("tcp.options.timestamp.tsval", "u"), "header": ("tcp.hdr_len", "u"), "seq": ("tcp.seq", "u")})


def ip_header_fields(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 headers with varied service class, lifetime and flags."""
    payload = udp(F.lit(5000), F.lit(9000), F.encode(F.lit("h"), "UTF-8"))
    head = F.concat(raw_hex("45"), be((_k() % 64) * 4 + _k() % 4, 1), raw_hex("001d"), be(_k(), 2), F.when(_k() % 2 == 0, raw_hex("4000")).otherwise(raw_hex("0000")), be(1 + _k() % 255, 1), raw_hex("11 0000"), _address(0x0A), raw_hex("0a0a0a0a"))
    wanted = {"dscp": ("ip.dsfield.dscp", "u"), "ecn": ("ip.dsfield.ecn", "u"), "ttl": ("ip.ttl", "u"), "df": ("ip.flags.df", "b"), "length": ("ip.len", "u"), "ident": ("ip.id", "u"), "sender": ("ip.src", "a")}
    f = _fields(_frames(spark, folder, _eth(0x0800, F.concat(head, payload))), wanted)
    return f.withColumn("sender", text.ip4_text(F.col("sender")))


def _resent(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' segments, and each order's first one again, late; it comes last in its stream."""
    first = F.expr("(l_orderkey * 8 + l_linenumber) % 8 = 1 and seq = 1")
    late = F.when(first, F.array(F.lit(0).cast("bigint"), F.lit(1 << 40))).otherwise(F.array(F.lit(0).cast("bigint")))
    return segment_frames(order_segments(spark, folder).withColumn("late", F.explode(late)), F.col("late"))


def tcp_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Expert findings of streams in which a segment was sent again: findings, severities, frames and the first of them."""
    r = reports.findings_of(_resent(spark, folder))
    return r.select("field", "severity", "grp", F.col("count").alias("frames"), F.get("frames", F.lit(0)).alias("first_frame"), F.size("frames").alias("shown"))


def tcp_severities(spark: SparkSession, folder: str) -> DataFrame:
    return reports.severity_counts_of(_resent(spark, folder)).drop("capture_id")


def semi_displayed(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of the senders that have a frame on port 9002."""
    from tidewire.dissect.headers import headers

    raw = event_frames(spark, folder)
    hit = headers(displayed(raw, "udp.dstport == 9002"), ("ip_src",)).select("capture_id", "ip_src").distinct()
    return headers(raw, ("ip_src",)).join(hit, ["capture_id", "ip_src"], "left_semi").select("number")


def follow_udp(spark: SparkSession, folder: str) -> DataFrame:
    """Datagrams of each UDP stream in capture order: frames and bytes, none missing."""
    p = reports.payloads(stage.dissect(event_frames(spark, folder), keep=["udp.srcport", "udp.payload"]))
    return reports.transcript_totals(p, reports.transcript(p)).select("stream_id", "direction", "frames", "payload", "bytes", "missing")


def find_in_list(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose packet-list columns hold a destination's address."""
    return reports.find_text(stage.dissect_stateless(event_frames(spark, folder), keep=()), "10.1.0.2").select("number")


def find_in_details(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose tree has a line with a port by its label."""
    return reports.find_text(stage.dissect_stateless(event_frames(spark, folder)), "destination port: 9003", "details").select("number")


def udp_port_total(spark: SparkSession, folder: str) -> DataFrame:
    """Frames per destination port, UDP over all ways to it."""
    from tidewire.dissect.headers import headers

    return headers(event_frames(spark, folder), ("udp_dst", "udp_length")).groupBy("udp_dst").agg(F.count("*").alias("frames"), F.sum("udp_length").alias("bytes"))


def udp_header_fields(spark: SparkSession, folder: str) -> DataFrame:
    from tidewire.dissect.headers import headers

    h = headers(event_frames(spark, folder), ("udp_src", "udp_dst", "udp_length"))
    return h.select("number", "udp_src", "udp_dst", "udp_length")


def tcp_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of the orders' segments, from header columns."""
    from tidewire.dissect.headers import headers

    h = headers(order_frames(spark, folder), ("tcp_flags", "tcp_psh", "tcp_ackf", "tcp_syn", "tcp_len"))
    return h.groupBy("tcp_flags", "tcp_psh", "tcp_ackf", "tcp_syn").agg(F.count("*").alias("frames"), F.sum("tcp_len").alias("bytes"))


QUERIES = {f.__name__: f for f in (vlan_tags, arp_requests, llc_snap, loopback_families, ipv6_extensions, icmp_quoted, ndp_targets, dhcp_options, tls_sni, malformed, checksums, padded, tcp_options, ip_header_fields, tcp_findings, tcp_severities, semi_displayed, follow_udp, find_in_list, find_in_details, udp_port_total, udp_header_fields, tcp_flags)}

_C = "c_custkey AS number"
_IP = "'{0}.' || (c_custkey // 65536 % 256) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256)"
_A, _B = _IP.format(10), _IP.format(11)
_HEX = "lower(printf('%08X', c_custkey))"
_SHORT = "CASE WHEN c_custkey = 0 THEN '' WHEN c_custkey >= 65536 THEN lower(printf('%X', c_custkey // 65536)) || ':' ELSE '' END || CASE WHEN c_custkey = 0 THEN '' ELSE lower(printf('%X', c_custkey % 65536)) END"
#: findings of the orders' segments, none of which has a TCP checksum, and of the first ones sent again after all others
_SENT = """o AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY l_orderkey),
again AS (SELECT DISTINCT l_orderkey * 8 + 1 + 1099511627776 AS number, size FROM lineitem JOIN o ON l_orderkey = k WHERE l_linenumber = 1),
said AS (SELECT '_ws.checksum.bad' AS field, 4 AS severity, 1 AS grp, number FROM (SELECT l_orderkey * 8 + l_linenumber AS number FROM lineitem UNION ALL SELECT number FROM again)
UNION ALL SELECT CASE WHEN size = 1 THEN 'tcp.analysis.keep_alive' ELSE 'tcp.analysis.retransmission' END, 2, 2, number FROM again)"""
_TYPE = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1"
ORACLE = {
    "udp_header_fields": f"SELECT event_id + 1 AS number, CAST(20000 + user_id AS BIGINT) AS udp_src, CAST(9000 + {_TYPE} AS BIGINT) AS udp_dst, CAST(8 + octet_length(encode(props)) AS BIGINT) AS udp_length FROM events",
    "tcp_flags": "SELECT CAST(24 AS BIGINT) AS tcp_flags, true AS tcp_psh, true AS tcp_ackf, false AS tcp_syn, count(*) AS frames, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem",
    "vlan_tags": f"SELECT {_C}, c_custkey % 4096 AS vlan, c_custkey % 8 AS priority, CAST(9000 AS BIGINT) AS port FROM customer",
    "arp_requests": f"SELECT {_C}, {_A} AS sender, {_B} AS target, CAST(1 AS BIGINT) AS opcode, 'arp' AS protocol, 'Who has ' || {_B} || '? Tell ' || {_A} AS info FROM customer",
    "llc_snap": f"SELECT {_C}, CAST(8 + 28 + 7 AS BIGINT) AS length, CAST(170 AS BIGINT) AS dsap, CAST(2048 AS BIGINT) AS type, c_custkey % 65536 AS ident, CAST(9001 AS BIGINT) AS port FROM customer",
    "loopback_families": f"SELECT {_C}, CAST(2 AS BIGINT) AS family, c_custkey % 65536 AS ident, CAST(9002 AS BIGINT) AS port FROM customer",
    "ipv6_extensions": f"SELECT {_C}, '2001:db8::' || {_SHORT} AS sender, 9000 + c_custkey % 5 AS port, c_custkey % 5 = 3 AS displayed FROM customer",
    "icmp_quoted": f"SELECT {_C}, CAST(11 AS BIGINT) AS type, CAST(0 AS BIGINT) AS code, CAST(9004 AS BIGINT) AS port, c_custkey % 65536 AS quoted, CAST(2 AS BIGINT) AS headers FROM customer",
    "ndp_targets": f"SELECT {_C}, CAST(135 AS BIGINT) AS type, 'fe80::' || {_SHORT} AS target, '02:00:' || substr({_HEX}, 1, 2) || ':' || substr({_HEX}, 3, 2) || ':' || substr({_HEX}, 5, 2) || ':' || substr({_HEX}, 7, 2) AS mac FROM customer",
    "dhcp_options": f"SELECT {_C}, CAST(1 AS BIGINT) AS kind, c_custkey AS transaction, 'c' || c_custkey AS host, {_A} AS wanted FROM customer",
    "tls_sni": "SELECT c_custkey * 2 + 1 AS number, 'c' || c_custkey || '.example' AS name, CAST(4865 AS BIGINT) AS suite FROM customer",
    "malformed": f"SELECT {_C}, 'dns' AS protocol, c_custkey % 3 = 0 AS malformed, CAST(CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 0 END AS INTEGER) AS severity FROM customer",
    "checksums": "SELECT CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS ip, CAST(3 AS BIGINT) AS udp, c_custkey % 5 = 0 AS bad, count(*) AS frames FROM customer GROUP BY ALL",
    "padded": f"SELECT {_C}, 18 - c_custkey % 30 AS padding FROM customer WHERE c_custkey % 30 < 18",
    "tcp_options": f"SELECT {_C}, 1000 + c_custkey % 400 AS mss, c_custkey % 15 AS shift, c_custkey AS tsval, CAST(40 AS BIGINT) AS header, c_custkey AS seq FROM customer",
    "ip_header_fields": f"SELECT {_C}, c_custkey % 64 AS dscp, c_custkey % 4 AS ecn, 1 + c_custkey % 255 AS ttl, c_custkey % 2 = 0 AS df, CAST(29 AS BIGINT) AS length, c_custkey % 65536 AS ident, {_A} AS sender FROM customer",
    "tcp_findings": f"""WITH {_SENT}
SELECT field, CAST(severity AS BIGINT) AS severity, CAST(grp AS BIGINT) AS grp, count(*) AS frames, min(number) AS first_frame, CAST(least(count(*), 32) AS INTEGER) AS shown FROM said GROUP BY field, severity, grp""",
    "tcp_severities": f"WITH {_SENT} SELECT count(*) FILTER (severity = 4) AS errors, count(*) FILTER (severity = 3) AS warnings, count(*) FILTER (severity = 2) AS notes, count(*) FILTER (severity = 1) AS chats FROM said",
    "semi_displayed": f"SELECT event_id + 1 AS number FROM events WHERE user_id IN (SELECT user_id FROM events WHERE {_TYPE} = 2)",
    "follow_udp": f"SELECT row_number() OVER (ORDER BY f) - 1 AS stream_id, CAST(0 AS INTEGER) AS direction, n AS frames, b AS payload, b AS bytes, CAST(0 AS BIGINT) AS missing FROM (SELECT min(event_id) AS f, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS b FROM events GROUP BY user_id, {_TYPE})",
    "find_in_list": f"SELECT event_id + 1 AS number FROM events WHERE {_TYPE} = 2",
    "find_in_details": f"SELECT event_id + 1 AS number FROM events WHERE {_TYPE} = 3",
    "udp_port_total": f"SELECT CAST(9000 + {_TYPE} AS BIGINT) AS udp_dst, count(*) AS frames, CAST(sum(8 + octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY ALL",
}
