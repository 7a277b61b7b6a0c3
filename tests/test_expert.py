"""Findings counted from headers against those of the trees."""

import random

import packets as P
import pyarrow as pa
import pytest
from test_dissect import mixed_frames

from tidewire.dissect import expert, layers, stage
from tidewire.operators import reports
from tidewire.plans import protocols

IP6 = [bytes.fromhex("20010db8") + bytes(11) + bytes([i]) for i in (1, 2)]


def talk(rng, port, sport, n, v6=False, texts=(b"x" * 9, b"yy", b"z")):
    """Frames of both ends of a connection: lost, repeated, overlapping and empty segments, resets of it, windows of 0."""
    at, out = [1000, (1 << 32) - 20], []
    for i in range(n):
        side = int(rng.random() < 0.3 and i > 3)
        text = rng.choice(texts) if rng.random() < 0.8 else b""
        seq = (at[side] + rng.choice((0, 0, 0, 0, 0, 0, 5, -1, -4, -9))) % (1 << 32)
        flags = 0x02 if rng.random() < 0.03 else 0x11 if rng.random() < 0.03 else 0x14 if rng.random() < 0.02 else 0x18
        options = rng.choice((b"", b"", b"\x01\x01\x08\x0a" + bytes(8), b"\x03\x03\x02\x00", b"\x03\x03\x02\x00", b"\x08\x01\x00\x00"))
        more = {"seq": seq, "ack": at[1 - side] % (1 << 32), "flags": flags, "window": rng.choice((8192, 8192, 8192, 0, 12)), "options": options}
        a, b = (IP6 if v6 else [P.IP_A, P.IP_B])[:: -1 if side else 1]
        body = bytearray(P.tcp(text, *((port, sport) if side else (sport, port)), src=a, dst=b, **more))
        if rng.random() < 0.2:
            body[16] ^= 0x55
        out.append(P.eth(P.ip6(bytes(body), 6, a, b), 0x86DD) if v6 else P.eth(P.ip(bytes(body), 6, a, b, good=rng.random() < 0.9)))
        at[side] = (seq + len(text)) % (1 << 32)
    return out


def fragments(rng, sport):
    """A TCP segment in two fragments, in any order, or one of them."""
    body = P.tcp(b"q" * 40, sport, 7000, seq=1000)
    parts = [P.ip(body[:32], 6, flags=0x2000, ident=sport), P.ip(body[32:], 6, flags=4, ident=sport)]
    rng.shuffle(parts)
    return [P.eth(p) for p in parts[: rng.choice((1, 2, 2))]]


def odd_frames(seed):
    rng = random.Random(seed)
    http = (b"GET / HTTP/1.1\r\nHo", b"st: a\r\n", b"\r\n", b"POST /b HTTP/1.1\r\n", b"\x16\x03\x01\x00\x05\x01", b"\x16\x03\x01\xff", b"zz")
    flows = [talk(rng, port, sport, 40, v6, http if web else (b"x" * 9, b"yy", b"z")) for port, sport, v6, web in ((7000, 40000, 0, 0), (7000, 40001, 0, 0), (7000, 40002, 1, 0), (7001, 40003, 0, 1), (80, 40004, 0, 1), (443, 40005, 1, 1))]
    flows += [fragments(rng, 40000), fragments(rng, 40001), fragments(rng, 40006)]
    bad = bytearray(P.udp(b"hello", 5000, 9000))
    bad[6] ^= 0x11
    flows += [[P.eth(P.ip(u, 17)) for u in (bytes(bad), P.udp(b"abc", 5000, 9000), P.udp(b"abc", 5000, 9000, sum_=False), P.udp(b"\0\1", 5000, 53), P.udp(b"abc", 5000, 9000, length=40))]]
    flows += [[b"", b"\0", P.eth(b"E\0")[:20], P.segment(b"abc")[:40], P.eth(P.ip(bytes([3, 1, 0, 0]) + bytes(4) + P.ip(P.tcp(b"", 40000, 7000), 6), 1))]]
    out = []
    while flows:  # the connections meet in the capture
        f = rng.choice(flows)
        out.append(f.pop(0))
        flows = [f for f in flows if f]
    return [(f"c{rng.random() < 0.1}" if seed else "c", *r[1:]) for r in P.rows(out, step_ns=rng.choice((10**6, 10**9)))]


def same(spark, rows, parts):
    raw = spark.createDataFrame(rows, P.RAW).repartition(parts)
    r = reports.finding_records(stage.dissect(raw)).cache()
    order = lambda f: sorted(map(tuple, f.collect()), key=repr)
    want = order(reports.findings(r))
    assert want and order(reports.findings_of(raw)) == want
    assert order(reports.severity_counts_of(raw, 3)) == order(reports.severity_counts(r, 3))
    return {x[1] for x in want}


@pytest.mark.parametrize("seed", range(3))
def test_as_trees(spark, seed):
    fields = same(spark, odd_frames(seed), 1 + seed)
    assert {"_ws.checksum.bad", "_ws.malformed", "tcp.analysis.lost_segment", "tcp.analysis.zero_window"} <= fields


def test_mixed(spark):
    same(spark, mixed_frames(), 3)


def test_small_pieces(spark):
    """Streams over many rows, blocks and batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(spark, odd_frames(2), 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_trees_of_plain_frames(monkeypatch):
    """Neither the reading of plain frames nor the sweep of their streams dissects one, resent segments included."""
    frames = [P.segment(b"x" * 10, seq=1 + 10 * i, sport=s) for s in range(1024, 1034) for i in range(6)] + [P.segment(b"x" * 10, seq=1, sport=1030)]
    rows = P.rows(frames)
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(stage.RAW))
    monkeypatch.setattr(layers, "frame", lambda *a, **k: pytest.fail("dissected"))
    b = expert._packed(batch)
    got = pa.Table.from_batches(list(expert._swept(iter([b.take(pa.array(sorted(range(b.num_rows), key=lambda i: (b["key"][i].as_py(), b["block"][i].as_py()))))])))).to_pylist()
    assert [(x["field"], x["count"], x["frames"]) for x in got] == [("tcp.analysis.retransmission", 1, [61])]


@pytest.mark.parametrize("name", ["tcp_findings", "tcp_severities"])
def test_frames_made_twice_at_most(spark, data, name):
    """The frames are read once for their headers and once for fragments."""
    plan = protocols.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and plan.count("MapInArrow") == 5
