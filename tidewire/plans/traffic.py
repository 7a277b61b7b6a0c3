"""Queries over frames made from the tables of a folder, and their SQL over the tables themselves.

events become UDP datagrams, one per event; lineitem TCP segments, one stream per order with l_quantity bytes a line;
customer DNS queries; part HTTP requests, each split over two segments; orders fragmented UDP datagrams. The queries see
bytes only, so each checks encoding, dissection and query against SQL that never left the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.dissect import stage
from tidewire.dissect.headers import be, headers
from tidewire.filters.compiler import compile_filter, displayed
from tidewire.functions import text
from tidewire.functions.times import epoch_us
from tidewire.operators import reports
from tidewire.sources.tables import table

TYPES = ("click", "error", "purchase", "signup", "view")
CAPTURE = "main"


def raw_hex(h: str) -> Column:
    return F.lit(bytes.fromhex(h.replace(" ", "")))


def ipv4(src: Column, dst: Column, proto: int, payload: Column, ident: Column, flags: Column | None = None) -> Column:
    """Ethernet and IPv4 headers before a payload; no header checksum."""
    return F.concat(raw_hex("020000000001 0200"), src, raw_hex("0800 4500"), be(F.length(payload) + 20, 2), be(ident, 2), raw_hex("4000") if flags is None else flags, raw_hex(f"40{proto:02x}0000"), src, dst, payload)


def udp(sport: Column, dport: Column, payload: Column) -> Column:
    return F.concat(be(sport, 2), be(dport, 2), be(F.length(payload) + 8, 2), raw_hex("0000"), payload)


def tcp(sport: Column, dport: Column, seq: Column, flags: int, payload: Column) -> Column:
    return F.concat(be(sport, 2), be(dport, 2), be(seq, 4), raw_hex(f"00000000 50{flags:02x} 2000 0000 0000"), payload)


def _raw(df: DataFrame, number: Column, ts_ns: Column, frame: Column) -> DataFrame:
    r = df.select(F.lit(CAPTURE).alias("capture_id"), number.cast("bigint").alias("number"), F.lit(1).alias("link_type"), ts_ns.alias("ts_ns"), frame.alias("bytes"))
    return r.select("capture_id", "number", "link_type", "ts_ns", F.length("bytes").cast("bigint").alias("orig_len"), "bytes")


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    user = F.col("user_id")
    frame = ipv4(F.concat(raw_hex("0a00"), be(user, 2)), F.concat(raw_hex("0a0100"), be(kind, 1)), 17, udp(user + 20000, kind + 9000, F.encode("props", "UTF-8")), F.col("event_id"))
    return _raw(e, F.col("event_id") + 1, epoch_us(e, "ts") * 1000, frame)


def order_segments(spark: SparkSession, folder: str) -> DataFrame:
    """l_orderkey, l_linenumber, n (bytes of the line) and seq, which counts the order's bytes from 1."""
    from pyspark.sql import Window

    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return l.withColumn("seq", before + 1)


def segment_frames(segments: DataFrame, later: Column | None = None) -> DataFrame:
    """Frames of order_segments(): number = 8 x l_orderkey + l_linenumber, a millisecond each; later is added to both."""
    k = F.col("l_orderkey")
    frame = ipv4(F.concat(raw_hex("0b"), be(k, 3)), raw_hex("0a030001"), 6, tcp(20000 + F.pmod(k, F.lit(40000)), F.lit(7000), F.col("seq"), 0x18, F.encode(F.repeat(F.lit("x"), F.col("n")), "UTF-8")), k)
    number = k * 8 + F.col("l_linenumber")
    ts_ns = number.cast("bigint") * 1_000_000
    return _raw(segments, number if later is None else number + later, ts_ns if later is None else ts_ns + later, frame)


def order_frames(spark: SparkSession, folder: str) -> DataFrame:
    """number = 8 x l_orderkey + l_linenumber, a millisecond each; seq counts the order's bytes from 1."""
    return segment_frames(order_segments(spark, folder))


def query_frames(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    label = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    name = F.concat(be(F.length(label), 1), F.encode(label, "UTF-8"), raw_hex("07"), F.lit(b"example"), raw_hex("00"))
    msg = F.concat(be(F.col("c_custkey"), 2), raw_hex("0100 0001 0000 0000 0000"), name, raw_hex("0001 0001"))
    k = F.col("c_custkey")
    return _raw(c, k, k.cast("bigint") * 1_000_000, ipv4(raw_hex("0a040001"), raw_hex("0a040002"), 17, udp(F.lit(40000), F.lit(53), msg), k))


def request_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each part's request in two segments, split in the middle; numbers 2k and 2k + 1."""
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    request = F.encode(F.concat(F.lit("GET /part/"), k.cast("string"), F.lit(" HTTP/1.1\r\nHost: p"), k.cast("string"), F.lit(".example\r\n\r\n")), "UTF-8")
    p = p.select("p_partkey", request.alias("request")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    mid = F.call_function("div", F.length("request"), F.lit(2)).cast("int")
    part = F.when(F.col("half") == 0, F.substring("request", F.lit(1), mid)).otherwise(F.substring("request", mid + 1, F.length("request")))
    seq = 1 + F.when(F.col("half") == 1, mid).otherwise(0)
    number = k * 2 + F.col("half")
    return _raw(p, number, number.cast("bigint") * 1_000_000, ipv4(F.concat(raw_hex("0c"), be(k, 3)), raw_hex("0a050001"), 6, tcp(F.lit(30000), F.lit(80), seq, 0x18, part), k))


def fragment_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's key as a datagram in two fragments, the second one first; numbers 2k and 2k + 1."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    datagram = udp(F.lit(1111), F.lit(2222), F.encode(F.concat(F.lit("order "), k.cast("string"), F.lit(" is split")), "UTF-8"))
    o = o.select("o_orderkey", datagram.alias("d")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    late = F.col("half") == 0
    part = F.when(late, F.substring("d", 17, 1000)).otherwise(F.substring("d", 1, 16))
    flags = F.when(late, raw_hex("0002")).otherwise(raw_hex("2000"))
    number = k * 2 + F.col("half")
    return _raw(o, number, number.cast("bigint") * 1_000_000, ipv4(F.concat(raw_hex("0d"), be(k, 3)), raw_hex("0a060001"), 17, part, k, flags))


def _numbers(text_: str, name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return displayed(event_frames(spark, folder), text_).select("number")

    query.__name__ = name
    return query


_N, _T, _P = "event_id + 1 AS number", "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1", "octet_length(encode(props))"
#: name -> display filter, SQL condition on events
FILTERS = {
    "filter_presence": ("udp", "true"), "filter_eq_port": ("udp.dstport == 9001", f"{_T} = 1"), "filter_ne_any": ("udp.port != 9001", "true"), "filter_ne": ("udp.dstport != 9001", f"{_T} <> 1"),
    "filter_order_len": ("frame.len > 75", f"42 + {_P} > 75"), "filter_in_ports": ("udp.dstport in {9000, 9003}", f"{_T} IN (0, 3)"), "filter_cidr": ("ip.src == 10.0.0.77/25", "user_id < 128"),
    "filter_slice": ("eth.src[4:2] == 00:05", "user_id = 5"), "filter_contains_payload": ('data.data contains "1"', "contains(props, '1')"), "filter_matches": (r'data.data matches "[0-9]{2}"', r"regexp_matches(props, '[0-9]{2}')"),
    "filter_enum_name": ('ip.proto == "udp" && eth.type == "IPv4"', "true"), "filter_not": ("!(udp.dstport == 9000) && not tcp", f"{_T} <> 0"), "filter_precedence": ("udp.dstport == 9000 || udp.dstport == 9001 && ip.src == 10.0.0.7", f"{_T} = 0 OR ({_T} = 1 AND user_id = 7)"),
    "filter_alias_addr": ("ip.addr == 10.1.0.2", f"{_T} = 2"), "filter_absent": ("tcp || arp || dns.qry.name", "false"), "filter_unsigned": ("ip.id >= 65000", "event_id % 65536 >= 65000"),
}


def frame_projection(spark: SparkSession, folder: str) -> DataFrame:
    h = headers(event_frames(spark, folder))
    return h.select("number", text.mac_text(F.col("eth_src")).alias("eth_src"), text.ip4_text(F.col("ip_src")).alias("src"), text.ip4_text(F.col("ip_dst")).alias("dst"), "udp_src", "udp_dst", "udp_length", "ip_len", "ip_id", "ip_ttl", reports.utc_text(F.col("ts_ns")).alias("at"))


def tree_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts from the full tree: one row per frame, from the exploded fields."""
    wanted = ["udp.srcport", "udp.dstport", "udp.length", "ip.id", "data.len"]
    f = stage.fields(stage.dissect_stateless(event_frames(spark, folder), keep=wanted))
    return f.groupBy("number").pivot("field", wanted).agg(F.max("u")).toDF("number", "udp_src", "udp_dst", "udp_length", "ip_id", "data_len")


def _talks(p: DataFrame, show) -> DataFrame:
    c = reports.conversations(p, [c for c in ("stream_id",) if c in p.columns])
    return c.select(show(F.col("a.addr")).alias("a"), F.col("a.port").alias("a_port"), show(F.col("b.addr")).alias("b"), F.col("b.port").alias("b_port"), "packets_a", "packets_b", "bytes_a", "bytes_b", "first_number", F.round("duration_s", 6).alias("duration_s"), F.round("bps", 3).alias("bps"))


def conversations_eth(spark: SparkSession, folder: str) -> DataFrame:
    return _talks(reports.packets(event_frames(spark, folder), "eth"), text.mac_text)


def conversations_ip(spark: SparkSession, folder: str) -> DataFrame:
    return _talks(reports.packets(event_frames(spark, folder), "ip"), text.addr_text)


def conversations_udp(spark: SparkSession, folder: str) -> DataFrame:
    return _talks(reports.packets(event_frames(spark, folder), "udp"), text.addr_text)


def conversations_tcp(spark: SparkSession, folder: str) -> DataFrame:
    return _talks(reports.packets(order_frames(spark, folder), "tcp"), text.addr_text)


def _small(spark: SparkSession, folder: str) -> DataFrame:
    q, r = query_frames(spark, folder), request_frames(spark, folder)
    most = 1 << 40  # the requests come after the queries
    return q.unionByName(r.withColumns({"number": F.col("number") + most, "ts_ns": F.col("ts_ns") + most}))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return reports.hierarchy(stage.dissect(_small(spark, folder), keep=())).select("path", "depth", "packets", "bytes", "end_packets", "end_bytes")


def hierarchy_totals(spark: SparkSession, folder: str) -> DataFrame:
    return reports.totals(event_frames(spark, folder)).select("packets", "bytes", F.round("duration_s", 6).alias("duration_s"), F.round("bps", 3).alias("bps"))


def _graph(unit: str, interval: float, name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        series = [("all_frames", ""), ("clicks", "udp.dstport == 9000"), ("broken", "udp.dstport ==")]
        return reports.io_graph_of(event_frames(spark, folder), series, interval, unit)[0].drop("capture_id")

    query.__name__ = name
    return query


def stream_ids(spark: SparkSession, folder: str) -> DataFrame:
    s = stage.with_streams(stage.with_flows(event_frames(spark, folder), ("capture_id", "number")))
    return s.groupBy("stream_id").agg(F.min("number").alias("first_number"), F.count("*").alias("frames"))


def follow_stream(spark: SparkSession, folder: str) -> DataFrame:
    h = headers(order_frames(spark, folder), ("tcp_src", "ip_src", "tcp_seq", "l4", "tcp_hdr", "tcp_len")).where("tcp_src is not null")
    s = h.select("capture_id", F.hex("ip_src").alias("stream_id"), F.lit(0).alias("side"), "number", F.col("tcp_seq").alias("seq"), F.expr("substring(bytes, cast(l4 + tcp_hdr + 1 as int), cast(tcp_len as int))").alias("payload"))
    return reports.follow(s).groupBy("stream_id").agg(F.count("*").alias("segments"), F.sum(F.length("bytes")).cast("bigint").alias("size"), F.sum("gap").cast("bigint").alias("missing"))


def colour_claims(spark: SparkSession, folder: str) -> DataFrame:
    rules = [("broken", "udp.dstport =="), ("errors", "udp.dstport == 9001"), ("low", "ip.src == 10.0.0.0/26"), ("rest", "udp && ip.ttl == 64")]
    return reports.coloured(event_frames(spark, folder), rules).select("number", "rule")


def default_colours(spark: SparkSession, folder: str) -> DataFrame:
    """The default rules over queries and requests: messages, bad checksums and the rest of their segments."""
    return reports.coloured(_small(spark, folder)).groupBy("rule").agg(F.count("*").alias("frames"))


def find_next(spark: SparkSession, folder: str) -> DataFrame:
    return reports.find(displayed(event_frames(spark, folder), "udp.dstport == 9002"), 100).select("number")


def find_prev_wrap(spark: SparkSession, folder: str) -> DataFrame:
    return reports.find(displayed(event_frames(spark, folder), "udp.dstport == 9002"), 1, forward=False).select("number")


def time_columns(spark: SparkSession, folder: str) -> DataFrame:
    t = reports.with_times(displayed(event_frames(spark, folder), "udp.dstport == 9003"))
    return t.select("number", "since_start_ns", "delta_ns", reports.time_text(F.col("delta_ns")).alias("delta"))


def ring_view(spark: SparkSession, folder: str) -> DataFrame:
    return reports.ring(event_frames(spark, folder), most_frames=5000).select("number")


def ring_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What a store of 5000 frames holds and has let go."""
    return reports.ring_stats(event_frames(spark, folder), most_frames=5000).drop("capture_id")


def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return reports.store_stats(event_frames(spark, folder)).drop("capture_id")


def anti_displayed(spark: SparkSession, folder: str) -> DataFrame:
    raw = event_frames(spark, folder)
    return raw.join(displayed(raw, "udp.dstport == 9000").select("capture_id", "number"), ["capture_id", "number"], "left_anti").select("number")


def export_marked(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "events").where("value > 100").select(F.lit(CAPTURE).alias("capture_id"), (F.col("event_id") + 1).alias("number"))
    return reports.exported(event_frames(spark, folder), "marked", marks=marks).select("number", F.hex("bytes").alias("frame"))


def dns_qry_name(spark: SparkSession, folder: str) -> DataFrame:
    f = stage.fields(stage.dissect_stateless(query_frames(spark, folder), keep=["dns.qry.name"]))
    return f.select("number", F.col("s").alias("name"))


def http_host_uri(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that span two segments, put together."""
    f = stage.fields(stage.dissect(request_frames(spark, folder), keep=["http.host", "http.request.uri"]))
    return f.groupBy("number").pivot("field", ["http.host", "http.request.uri"]).agg(F.max("s")).toDF("number", "host", "uri")


def reassembly(spark: SparkSession, folder: str) -> DataFrame:
    """Datagrams put together from their fragments: the frame that completed them, and their text."""
    d = stage.dissect(fragment_frames(spark, folder), keep=["ip.fragments", "udp.dstport"]).where(compile_filter("ip.fragments && udp.dstport == 2222"))
    return d.select("number", F.decode(F.expr("substring(sources[1], 9)"), "UTF-8").alias("payload"))


def frame_protocols(spark: SparkSession, folder: str) -> DataFrame:
    """Protocol chains of the fixtures' frames."""
    f = stage.dissect_stateless(stage.as_raw(table(spark, folder, "fixture_frame")), keep=())
    return f.groupBy(F.array_join("protocols", ":").alias("protocols")).agg(F.count("*").alias("frames"))


def fixture_ports(spark: SparkSession, folder: str) -> DataFrame:
    """Frames per link type and IP protocol of the fixtures, from header columns."""
    h = headers(stage.as_raw(table(spark, folder, "fixture_frame")), ("ip_src", "ip_proto"))
    return h.where("ip_src is not null").groupBy("ip_proto").agg(F.count("*").alias("frames"), F.sum("orig_len").alias("bytes"))


def expert_summary(spark: SparkSession, folder: str) -> DataFrame:
    f = stage.dissect(stage.as_raw(table(spark, folder, "fixture_frame")))
    return reports.findings(reports.finding_records(f)).select("capture_id", "field", "summary", "severity", "grp", "count", "frames")


def checksum_status(spark: SparkSession, folder: str) -> DataFrame:
    f = stage.fields(stage.dissect_stateless(stage.as_raw(table(spark, folder, "fixture_frame"))))
    return f.where(F.col("field").endswith(".checksum.status")).groupBy("field", "u").agg(F.count("*").alias("nodes"))


_BY = f"FROM (SELECT *, {_T} AS t, 42 + {_P} AS n, epoch_us(ts) AS us FROM events)"
_AB = "CAST({a} AS BIGINT) AS packets_a, CAST({b} AS BIGINT) AS packets_b, CAST({x} AS BIGINT) AS bytes_a, CAST({y} AS BIGINT) AS bytes_b"
_DUR = "greatest(arg_max(us, event_id) - arg_min(us, event_id), 0) / 1e6"
_RATE = f"round({_DUR}, 6) AS duration_s, CASE WHEN {_DUR} > 1e-6 THEN round(sum(n) * 8 / ({_DUR}), 3) END AS bps"
_USER = "'10.0.' || (user_id // 256) || '.' || (user_id % 256)"
_HEXU = "lower(substr(printf('%04X', user_id), 1, 2)) || ':' || lower(substr(printf('%04X', user_id), 3, 2))"


def _graph_sql(unit: str, interval: float) -> str:
    value = {"packets": "CAST(1 AS DOUBLE)", "bytes": "CAST(n AS DOUBLE)", "bits": f"n * 8 / CAST({interval} AS DOUBLE)"}[unit]
    return f"""WITH e AS (SELECT event_id, {_T} AS t, 42 + {_P} AS n, epoch_us(ts) * 1000 AS ns FROM events),
s AS (SELECT arg_min(ns, event_id) AS start, arg_max(ns, event_id) AS stop FROM e),
n AS (SELECT start, least(greatest(CAST(floor((stop - start) / 1e9 / {interval}) AS BIGINT), 0) + 1, {reports.MOST_BUCKETS}) AS many FROM s),
b AS (SELECT CAST(floor((ns - start) / 1e9 / {interval}) AS BIGINT) AS bucket, t, {value} AS v FROM e, n),
g AS (SELECT unnest(range(many)) AS bucket FROM n)
SELECT g.bucket, coalesce(sum(v), 0) AS all_frames, coalesce(sum(v) FILTER (t = 0), 0) AS clicks, CAST(0 AS DOUBLE) AS broken FROM g LEFT JOIN b USING (bucket) GROUP BY g.bucket"""


GRAPHS = {"io_graph_packets": ("packets", 60.0), "io_graph_bytes": ("bytes", 600.0), "io_graph_bits": ("bits", 60.0)}
QUERIES = {n: _numbers(f, n) for n, (f, _) in FILTERS.items()} | {n: _graph(u, i, n) for n, (u, i) in GRAPHS.items()}
QUERIES |= {f.__name__: f for f in (frame_projection, tree_projection, conversations_eth, conversations_ip, conversations_udp, conversations_tcp, hierarchy, hierarchy_totals, stream_ids, follow_stream, colour_claims, default_colours, find_next, find_prev_wrap, time_columns, ring_view, ring_stats, store_stats, anti_displayed, export_marked, dns_qry_name, http_host_uri, reassembly, frame_protocols, fixture_ports, expert_summary, checksum_status)}

_HTTP = "length('GET /part/' || p_partkey || ' HTTP/1.1' || ' Host: p' || p_partkey || '.example') + 5"
_DNS = "54 + 4 + length('c' || c_custkey) + 1 + 9"
ORACLE = {n: f"SELECT {_N} FROM events WHERE {c}" for n, (_, c) in FILTERS.items()} | {n: _graph_sql(u, i) for n, (u, i) in GRAPHS.items()}
ORACLE |= {
    "frame_projection": f"SELECT {_N}, '02:00:0a:00:' || {_HEXU} AS eth_src, {_USER} AS src, '10.1.0.' || ({_T}) AS dst, 20000 + user_id AS udp_src, CAST(9000 + {_T} AS BIGINT) AS udp_dst, CAST(8 + {_P} AS BIGINT) AS udp_length, CAST(28 + {_P} AS BIGINT) AS ip_len, event_id % 65536 AS ip_id, CAST(64 AS BIGINT) AS ip_ttl, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events",
    "tree_projection": f"SELECT {_N}, 20000 + user_id AS udp_src, CAST(9000 + {_T} AS BIGINT) AS udp_dst, CAST(8 + {_P} AS BIGINT) AS udp_length, event_id % 65536 AS ip_id, CAST({_P} AS BIGINT) AS data_len FROM events",
    "conversations_eth": f"SELECT '02:00:00:00:00:01' AS a, CAST(NULL AS BIGINT) AS a_port, '02:00:0a:00:' || {_HEXU} AS b, CAST(NULL AS BIGINT) AS b_port, {_AB.format(a='0', b='count(*)', x='0', y='sum(n)')}, min(event_id) + 1 AS first_number, {_RATE} {_BY} GROUP BY user_id",
    "conversations_ip": f"SELECT {_USER} AS a, CAST(NULL AS BIGINT) AS a_port, '10.1.0.' || t AS b, CAST(NULL AS BIGINT) AS b_port, {_AB.format(a='count(*)', b='0', x='sum(n)', y='0')}, min(event_id) + 1 AS first_number, {_RATE} {_BY} GROUP BY user_id, t",
    "conversations_udp": f"SELECT {_USER} AS a, 20000 + user_id AS a_port, '10.1.0.' || t AS b, CAST(9000 + t AS BIGINT) AS b_port, {_AB.format(a='count(*)', b='0', x='sum(n)', y='0')}, min(event_id) + 1 AS first_number, {_RATE} {_BY} GROUP BY user_id, t",
    "conversations_tcp": """WITH l AS (SELECT l_orderkey AS k, l_orderkey * 8 + l_linenumber AS num, 54 + CAST(l_quantity AS BIGINT) AS n FROM lineitem), g AS (SELECT k, count(*) AS c, sum(n) AS s, min(num) AS f, (max(num) - min(num)) / 1e3 AS d FROM l GROUP BY k)
SELECT '10.3.0.1' AS a, CAST(7000 AS BIGINT) AS a_port, '11.' || (k // 65536 % 256) || '.' || (k // 256 % 256) || '.' || (k % 256) AS b, 20000 + k % 40000 AS b_port, CAST(0 AS BIGINT) AS packets_a, c AS packets_b, CAST(0 AS BIGINT) AS bytes_a, CAST(s AS BIGINT) AS bytes_b, f AS first_number, round(d, 6) AS duration_s, CASE WHEN d > 1e-6 THEN round(s * 8 / d, 3) END AS bps FROM g""",
    "hierarchy": f"""WITH q AS (SELECT count(*) AS c, sum({_DNS}) AS b FROM customer), h AS (SELECT count(*) AS c, sum({_HTTP}) AS s FROM part), x AS (SELECT c, s, 108 * c + s AS b, (SELECT sum(54 + ({_HTTP}) - ({_HTTP}) // 2) FROM part) AS e FROM h)
SELECT path, CAST(depth AS INTEGER) AS depth, CAST(packets AS BIGINT) AS packets, CAST(bytes AS BIGINT) AS bytes, CAST(end_packets AS BIGINT) AS end_packets, CAST(end_bytes AS BIGINT) AS end_bytes FROM (
SELECT 'eth' AS path, 1 AS depth, q.c + 2 * x.c AS packets, q.b + x.b AS bytes, 0 AS end_packets, 0 AS end_bytes FROM q, x UNION ALL SELECT 'eth:ip', 2, q.c + 2 * x.c, q.b + x.b, 0, 0 FROM q, x
UNION ALL SELECT 'eth:ip:udp', 3, c, b, 0, 0 FROM q UNION ALL SELECT 'eth:ip:udp:dns', 4, c, b, c, b FROM q
UNION ALL SELECT 'eth:ip:tcp', 3, 2 * c, b, c, b - e FROM x UNION ALL SELECT 'eth:ip:tcp:http', 4, c, e, c, e FROM x)""",
    "hierarchy_totals": f"SELECT count(*) AS packets, CAST(sum(n) AS BIGINT) AS bytes, {_RATE} {_BY}",
    "stream_ids": f"SELECT row_number() OVER (ORDER BY f) - 1 AS stream_id, f AS first_number, c AS frames FROM (SELECT min(event_id) + 1 AS f, count(*) AS c {_BY} GROUP BY user_id, t)",
    "follow_stream": "SELECT '0B' || printf('%06X', l_orderkey) AS stream_id, count(*) AS segments, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, CAST(0 AS BIGINT) AS missing FROM lineitem WHERE l_quantity > 0 GROUP BY l_orderkey",
    "colour_claims": f"SELECT {_N}, CASE WHEN {_T} = 1 THEN 'errors' WHEN user_id < 64 THEN 'low' ELSE 'rest' END AS rule FROM events",
    "default_colours": "SELECT 'Bad checksum' AS rule, (SELECT 2 * count(*) FROM part) + 0 AS frames UNION ALL SELECT 'DNS', count(*) FROM customer",
    "find_next": f"SELECT coalesce(min(event_id + 1) FILTER (event_id + 1 > 100), min(event_id + 1)) AS number FROM events WHERE {_T} = 2",
    "find_prev_wrap": f"SELECT coalesce(max(event_id + 1) FILTER (event_id + 1 < 1), max(event_id + 1)) AS number FROM events WHERE {_T} = 2",
    "time_columns": f"""WITH e AS (SELECT event_id + 1 AS number, epoch_us(ts) * 1000 AS ns FROM events WHERE {_T} = 3), d AS (SELECT number, ns - first_value(ns) OVER w AS since_start_ns, coalesce(ns - lag(ns) OVER w, 0) AS delta_ns FROM e WINDOW w AS (ORDER BY number))
SELECT *, CASE WHEN delta_ns < 0 THEN '-' ELSE '' END || (abs(delta_ns) // 1000 // 1000000) || '.' || lpad(CAST(abs(delta_ns) // 1000 % 1000000 AS VARCHAR), 6, '0') AS delta FROM d""",
    "ring_view": f"WITH n AS (SELECT count(*) AS n FROM events) SELECT {_N} FROM events, n WHERE event_id // 4096 >= least(CAST(ceil(greatest(n - 5000, 0) / 4096) AS BIGINT), CAST(ceil(n / 4096) AS BIGINT) - 1)",
    "ring_stats": f"""WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT 42 + {_P} AS size, event_id, event_id // 4096 >= least(CAST(ceil(greatest(n - 5000, 0) / 4096) AS BIGINT), CAST(ceil(n / 4096) AS BIGINT) - 1) AS kept FROM events, n)
SELECT count(*) FILTER (kept) AS frames, CAST(sum(size) FILTER (kept) AS BIGINT) AS bytes, count(*) FILTER (NOT kept) AS evicted_frames, CAST(coalesce(sum(size) FILTER (NOT kept), 0) AS BIGINT) AS evicted_bytes, max(event_id) + 2 AS next_number FROM e""",
    "store_stats": f"SELECT count(*) AS frames, CAST(sum(n) AS BIGINT) AS bytes, max(event_id) + 2 AS next_number {_BY}",
    "anti_displayed": f"SELECT {_N} FROM events WHERE {_T} <> 0",
    "export_marked": f"""SELECT {_N}, '0200000000010200' || a || '08004500' || printf('%04X', 28 + {_P}) || printf('%04X', event_id % 65536) || '400040110000' || a || '0A0100' || printf('%02X', {_T}) || printf('%04X', 20000 + user_id) || printf('%04X', 9000 + {_T}) || printf('%04X', 8 + {_P}) || '0000' || hex(encode(props)) AS frame
FROM (SELECT *, '0A00' || printf('%04X', user_id) AS a FROM events) WHERE value > 100""",
    "dns_qry_name": "SELECT c_custkey AS number, 'c' || c_custkey || '.example' AS name FROM customer",
    "http_host_uri": "SELECT p_partkey * 2 + 1 AS number, 'p' || p_partkey || '.example' AS host, '/part/' || p_partkey AS uri FROM part",
    "reassembly": "SELECT o_orderkey * 2 + 1 AS number, 'order ' || o_orderkey || ' is split' AS payload FROM orders",
    "fixture_ports": "WITH f AS (SELECT DISTINCT fixture, number, link_type, orig_len, hex(bytes) AS h FROM fixture_frame) SELECT CAST('0x' || substr(h, 47, 2) AS BIGINT) AS ip_proto, count(*) AS frames, CAST(sum(orig_len) AS BIGINT) AS bytes FROM f WHERE link_type = 1 AND substr(h, 25, 4) = '0800' AND length(h) >= 68 AND substr(h, 29, 1) = '4' AND substr(h, 30, 1) >= '5' GROUP BY 1",
}
