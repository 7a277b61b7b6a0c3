"""Reports over hand-made frames, and the queries over encoded tables against SQL."""

import random

import packets as P
import pytest
from pyspark.sql import functions as F
from test_dissect import mixed_frames

from compare import difference, views
from tidewire.dissect import stage
from tidewire.filters import flat_filter
from tidewire.functions import text
from tidewire.operators import reports
from tidewire.plans import segments, traffic


@pytest.fixture(scope="module")
def frames(spark):
    return stage.dissect(spark.createDataFrame(mixed_frames(), P.RAW)).cache()


@pytest.mark.parametrize("name", sorted({**traffic.ORACLE, **segments.ORACLE}))
def test_sql(spark, data, name):
    query = {**traffic.QUERIES, **segments.QUERIES}[name]
    assert difference(query(spark, data), views(data), {**traffic.ORACLE, **segments.ORACLE}[name]) == ""


def test_rows_only(spark, data):
    for module in (traffic, segments):
        for n, q in module.QUERIES.items():
            if n not in module.ORACLE:
                assert q(spark, data).count() > 0, n


def test_hierarchy_walk(frames):
    h = reports.hierarchy(frames).orderBy("order").collect()
    paths = [r.path for r in h]
    assert paths[0] == "eth" and paths.index("eth:ip") < paths.index("eth:ip:tcp") < paths.index("eth:ip:tcp:http") < paths.index("eth:ip:tcp:http:http") < paths.index("eth:ip:udp") < paths.index("eth:arp")
    by = {r.path: r for r in h}
    assert by["eth"].packets == 16 and by["eth:ip:tcp:http:http"].end_packets == 1
    assert reports.hierarchy_filter("eth:ip:tcp") == "eth && ip && tcp"


def test_findings(spark):
    rows = [("c", n, 0, f, 3, 2, "said") for n in range(100) for f in ("tcp.analysis.lost_segment",)] + [("c", 5, 1, "_ws.malformed", 4, 3, "bad")]
    r = spark.createDataFrame(rows, "capture_id string, number bigint, idx int, field string, severity bigint, grp bigint, summary string")
    f = reports.findings_order(reports.findings(r)).collect()
    assert [(x.field, x["count"]) for x in f] == [("_ws.malformed", 1), ("tcp.analysis.lost_segment", 100)]
    assert f[1].frames == list(range(reports.SAMPLE))
    s = reports.severity_counts(r).first()
    assert (s.errors, s.warnings, s.notes, s.chats) == (1, 100, 0, 0)


def test_finding_records(frames):
    got = {(r.number, r.field) for r in reports.finding_records(frames).collect()}
    assert (15, "_ws.malformed") in got and all(r.severity is not None for r in reports.finding_records(frames).collect())


def brute_follow(rows):
    out, done = [], {}
    first = {}
    for side, number, seq, payload in sorted(rows, key=lambda r: r[1]):
        first.setdefault(side, seq)
    for side, number, seq, payload in sorted(rows, key=lambda r: (r[0], (r[2] - first[r[0]] + 2**31) % 2**32, r[1])):
        at = (seq - first[side] + 2**31) % 2**32 - 2**31
        d = done.get(side, at)
        if at + len(payload) > d:
            out.append((side, number, max(at - d, 0), payload[max(d - at, 0) :]))
            done[side] = at + len(payload)
    return sorted(out)


def test_follow(spark, frames):
    r = random.Random(6)
    for wrap in (0, 2**32 - 50):
        rows = [(r.randrange(2), n, (wrap + r.randrange(100)) % 2**32, bytes(r.randrange(256) for _ in range(r.randint(1, 12)))) for n in range(60)]
        df = spark.createDataFrame([("c", 1, *x) for x in rows], "capture_id string, stream_id int, side int, number int, seq bigint, payload binary")
        got = sorted((x.side, x.number, x.gap, bytes(x.bytes)) for x in reports.follow(df).collect())
        assert got == brute_follow(rows)
    f = reports.follow(reports.payloads(frames.where("stream_id = 0"))).orderBy("number").collect()
    assert b"".join(bytes(x.bytes) for x in f if x.side.port == 80).endswith(b"ABCDEFGHIJ") and sum(x.gap for x in f) == 0


def test_follow_blocks_udp_and_both_directions(spark, monkeypatch):
    monkeypatch.setattr(reports, "SEQUENCE_BLOCK", 16)
    r = random.Random(7)
    rows = [(r.randrange(2), n, (2**32 - 50 + r.randrange(200)) % 2**32, bytes(r.randrange(256) for _ in range(r.randint(1, 40)))) for n in range(80)]
    df = spark.createDataFrame([("c", 1, *x) for x in rows], "capture_id string, stream_id int, side int, number int, seq bigint, payload binary")
    assert sorted((x.side, x.number, x.gap, bytes(x.bytes)) for x in reports.follow(df).collect()) == brute_follow(rows)
    udp = spark.createDataFrame([("c", 2, s, n, None, p) for s, n, p in (("b", 4, b"hello"), ("a", 5, b"yes"), ("b", 6, b"hello"), ("b", 7, b""))], "capture_id string, stream_id int, side string, number int, seq bigint, payload binary")
    t = reports.transcript(udp)
    assert [(x.direction, x.number, x.gap, bytes(x.bytes)) for x in reports.transcript_order(t).collect()] == [(0, 4, 0, b"hello"), (1, 5, 0, b"yes"), (0, 6, 0, b"hello")]
    assert sorted((x.direction, x.frames, x.payload, x.bytes, x.missing) for x in reports.transcript_totals(udp, t).collect()) == [(0, 2, 10, 10, 0), (1, 1, 3, 3, 0)]


def test_marks_of_several_captures(spark):
    df = spark.createDataFrame([(c, n) for c in "xy" for n in (1, 2)], "capture_id string, number bigint")
    got = lambda **k: sorted(tuple(r) for r in reports.exported(df, **k).collect())
    assert got(what="marked", marks=df.where("capture_id = 'x' and number = 2")) == [("x", 2)]
    assert got(what="selected", number=1, capture="y") == [("y", 1)] and len(got(what="selected", number=1)) == 2


def test_times_blocks_and_ring(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 3)
    ns = [50, 40, 90, 95, 96, 10, 200, 201]
    df = spark.createDataFrame([("c", i + 1, v, b"xx") for i, v in enumerate(ns)], "capture_id string, number bigint, ts_ns bigint, bytes binary")
    got = {r.number: (r.since_start_ns, r.delta_ns) for r in reports.with_times(df).collect()}
    assert got == {i + 1: (v - 50, v - ns[i - 1] if i else 0) for i, v in enumerate(ns)}
    monkeypatch.setattr(reports, "CHUNK_FRAMES", 3)
    keep = lambda **k: sorted(r.number for r in reports.ring(df, **k).collect())
    assert keep(most_frames=8) == list(range(1, 9)) and keep(most_frames=7) == [4, 5, 6, 7, 8] and keep(most_frames=1) == [7, 8] and keep(most_bytes=10) == [4, 5, 6, 7, 8]


def test_io_graph_and_series_errors(spark):
    df = spark.createDataFrame([("c", i + 1, t * 10**9, 100) for i, t in enumerate([10, 12, 9, 11, 15])] + [("e", 1, None, 1)], "capture_id string, number bigint, ts_ns bigint, orig_len bigint")
    series, errors = reports.series_predicates([("a", ""), ("b", "nope ==")], lambda t: F.lit(True) if not t else flat_filter(t))
    got = {r.bucket: (r.a, r.b) for r in reports.io_graph(df, series, 2.0, "bits").collect()}
    assert got == {0: (800.0, 0.0), 1: (400.0, 0.0), 2: (400.0, 0.0)} and set(errors) == {"b"}


def test_payload_views(spark):
    b = bytes(range(60, 80)) + b"\r\n\t" + "é".encode() + b"\xff\x00"
    df = spark.createDataFrame([(b,), (b"",), (None,)], "b binary")
    got = [tuple(r) for r in df.select(*(text.payload_text(F.col("b"), v) for v in ("ascii", "utf8", "hex"))).collect()]
    shown = "".join(chr(c) if 32 <= c < 127 or c in (10, 9, 13) else "." for c in b)
    lines = ""
    for i in range(0, len(b), 16):
        row = b[i : i + 16]
        pairs = [f"{c:02x} " for c in row] + ["   "] * (16 - len(row))
        lines += f"{i:08x}  {''.join(pairs[:8])} {''.join(pairs[8:])} {''.join(chr(c) if 32 <= c < 127 else '.' for c in row)}\n"
    assert got == [(shown, b.decode("utf-8", "replace"), lines), ("", "", ""), (None, None, None)]
    with pytest.raises(ValueError):
        text.payload_text(F.col("b"), "ebcdic")


def test_rules_of_any_field_over_nested_frames(spark):
    """A rule that header columns cannot answer, and frames whose headers nest, are coloured and counted like the others."""
    deep = P.eth(P.ip6(b"\x11\0\x01\x04\0\0\0\0" + P.udp(b"x", 7, 9003, bytes(16), bytes(15) + b"\1"), 0, bytes(16), bytes(15) + b"\1"), 0x86DD)
    raw = spark.createDataFrame(P.rows([P.eth(P.ip(P.udp(b"hello", 5, 9001), 17)), deep, P.eth(P.ip(b"x", 99))]), P.RAW)
    flat = [("a", "udp.dstport == 9003"), ("broken", "udp =="), ("b", "udp")]
    assert {r.number: r.rule for r in reports.coloured(raw, flat).collect()} == {1: "b", 2: "a", 3: None}
    assert {r.number: r.rule for r in reports.coloured(raw, [("text", 'data.data contains "hell"'), *flat]).collect()} == {1: "text", 2: "a", 3: None}
    g, errors = reports.io_graph_of(raw, flat, 10.0)
    assert [(r.a, r.b, r.broken) for r in g.collect()] == [(1.0, 2.0, 0.0)] and set(errors) == {"broken"}


def test_search(frames):
    n = lambda d: sorted(r.number for r in d.select("number").collect())
    assert n(reports.find_text(frames, "who HAS")) == [14] and n(reports.find_text(frames, "example.com", "details")) == [11]
    assert n(reports.find_bytes(frames, reports.hex_needle("30:31 32-33"))) == [7, 10] and n(reports.find_text(frames, "GET /two", "bytes")) == [16] and n(reports.find_text(frames, "get /two", "bytes")) == []
    one = frames.where(F.length("src") == 4).orderBy("number").first()
    source = n(frames.where(F.col("src") == F.lit(bytes(one.src))))
    assert source and set(source) <= set(n(reports.find_text(frames, ".".join(map(str, bytes(one.src)))))) and n(reports.find_text(frames, "tcp10.0")) == []
    assert n(reports.find_bytes(frames, b"who has", "details")) == n(reports.find_bytes(frames, b"nowhere", "list")) == []
    assert n(reports.find_bytes(frames, b"Who has", "list")) == [14] and n(reports.find_text(frames, "don't fragment: ", "details")) != []
    with pytest.raises(ValueError):
        reports.find_text(frames, "x", "tree")
    with pytest.raises(ValueError):
        reports.hex_needle("abc")
    hits = frames.where("number in (3, 9)")
    assert reports.find(hits, 3).first().number == 9 and reports.find(hits, 9).first().number == 3 and reports.find(hits, 3, False).first().number == 9
    assert n(reports.exported(frames, "selected", number=4)) == [4] and n(reports.exported(frames, "displayed", F.col("number") < 3)) == [1, 2]
    assert frames.select(reports.colour().alias("c"), "number").where("number = 14").first().c == "ARP"


def test_conversation_order_and_filter(spark):
    p = reports.packets(spark.createDataFrame(mixed_frames(), P.RAW), "tcp")
    c = reports.conversations_order(reports.conversations(p)).collect()
    assert [(r.packets_a, r.packets_b) for r in c][:1] == [(5, 4)] or (c[0].packets_a + c[0].packets_b) == 9
    assert reports.conversation_filter(c[0], "tcp").startswith("ip.addr == ") and "tcp.port == 80" in reports.conversation_filter(c[0], "tcp")


def test_texts(spark):
    six = ["::", "::1", "2001:db8::1", "fe80::211:22ff:fe33:4455", "1:0:0:2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "0:1::"]
    import ipaddress

    df = spark.createDataFrame([(ipaddress.IPv6Address(a).packed, s) for a, s in zip(six, six)], "b binary, want string")
    from tidewire.dissect.tree import ip6_text

    for r in df.select("b", "want", text.addr_text(F.col("b")).alias("got")).collect():
        assert r.got == ip6_text(bytes(r.b)), r
    r = spark.range(1).select(text.mac_text(F.lit(P.MAC_A)).alias("m"), text.hex_line(F.lit(b"GET \x00\xff"), 0).alias("h"), text.byte_size(F.lit(1500)).alias("s"), text.percent(F.lit(1), F.lit(0)).alias("p"), text.number_text(F.lit(10), "hexdec", 2).alias("n"), text.sequence_offset(F.lit(5), F.lit(2**32 - 5)).alias("q")).first()
    assert r.m == "00:11:22:33:44:55" and r.h.startswith("00000000  47 45 54 20 00 ff") and r.h.endswith("GET ..") and (r.s, r.p, r.n, r.q) == ("1.5 kB", "—", "0x000a (10)", 10)


def test_numbers_and_counters(spark, monkeypatch):
    monkeypatch.setattr(reports, "BLOCK", 4)
    df = spark.createDataFrame([("c", n) for n in (3, 5, 9, 10, 40)] + [("d", 7)], "capture_id string, number bigint").withColumn("was", F.col("number"))
    assert sorted((r.capture_id, r.was, r.number) for r in reports.renumbered(df).collect()) == [("c", 3, 1), ("c", 5, 2), ("c", 9, 3), ("c", 10, 4), ("c", 40, 5), ("d", 7, 1)]
    assert {r.capture_id: r.number for r in reports.row_at_or_after(df, 6).collect()} == {"c": 9, "d": 7}
    d = spark.createDataFrame([("c", [(5, 2, None), (None, 1, 4)])], "capture_id string, interfaces array<struct<received:bigint,dropped:bigint,os_dropped:bigint>>")
    assert tuple(reports.capture_counters(d).first()) == ("c", 5, 3, 4)


def test_details_and_navigation(frames):
    from tidewire.dissect import labels

    r = labels.details(frames.where("number = 3")).first()
    assert any("Destination: 66:77:88:99:aa:bb" in x or "66:77:88:99:aa:bb" in x for x in r.lines) and any("TCP (6)" in x for x in r.lines) and "  GET /a HTTP/1.1" in [x[2:] if x.startswith("    ") else x for x in r.lines] + r.lines
    f = frames.where("number = 3").select(labels.roots(F.col("nodes")).alias("roots"), F.expr("filter(nodes, n -> n.field = 'ip')[0].idx").alias("ip"), "nodes")
    x = f.select("roots.field", labels.children(F.col("nodes"), F.col("ip")).alias("kids"), labels.subtree_end(F.col("nodes"), F.col("ip")).alias("end"), labels.innermost_at(F.col("nodes"), F.lit(0), F.lit(30)).alias("at"), "ip", "nodes").first()
    assert x.field[0] == "frame" and "ip.src" in [k.field for k in x.kids] and "ip.flags.df" not in [k.field for k in x.kids]
    assert x.nodes[x.end].field == "tcp" and x["at"].field == "ip.dst"


def test_filter_bar():
    from tidewire.filters.bar import FilterBar

    b = FilterBar()
    assert b.edit("tcp") == "ready" and b.apply() and b.state == "applied"
    assert b.edit("tcp &&") == "invalid" and not b.apply() and b.applied == "tcp" and b.error.column == 6
    assert b.edit("  ") == "empty" and b.apply() and b.applied == ""
