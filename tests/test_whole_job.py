"""Cases in which a part of the job was once left out: each query or operator against a count by hand."""

import random
from collections import Counter

import packets as P
import pytest
from test_dissect import name

from tidewire.dissect import flow, stage
from tidewire.filters import compile_filter
from tidewire.filters.compiler import displayed
from tidewire.operators import reports, sessions
from tidewire.plans import segments
from tidewire.streaming import live

SEGMENT = "fixture string, frame bigint, ts timestamp, lo struct<addr:binary,v6:boolean,port:int>, hi struct<addr:binary,v6:boolean,port:int>, proto int, from_lo boolean, seq bigint, ack bigint, payload_len bigint, win bigint, syn boolean, fin boolean, rst boolean, ack_flag boolean, window_scale int"
#: the forms in which stream_segment writes an IPv4 address
FORMS = (lambda a: (a + bytes(12), False), lambda a: (bytes(12) + a, False), lambda a: (bytes(10) + b"\xff\xff" + a, True))


def test_segment_findings_of_mixed_address_forms(spark, tmp_path):
    import datetime

    r, rows, said = random.Random(4), [], Counter()
    ends = ((bytes([10, 0, 0, 9]), 5000), (bytes([10, 0, 0, 2]), 40000))
    for c in ("clean", "odd"):
        state, at = flow.Stream(), [100, 9000]
        for n in range(120):
            side = 0 if n == 0 else 1 if n == 1 else r.randrange(2)
            syn, size = n < 2, 0 if n < 2 else r.randrange(1, 50)
            skip = r.choice((0, 0, -10, 40)) if c == "odd" and n > 3 else 0
            seq, ack = at[side] + skip, at[1 - side]
            at[side] = max(at[side], seq + size + syn)
            # a swapped pair of ends is the same stream: the sender is then told by from_lo
            swap = r.randrange(2)
            e = [(*r.choice(FORMS)(a), p - 65536 if p > 32767 and r.randrange(2) else p) for a, p in ends]
            ts = 10**9 + n
            rows.append((c, n + 1, datetime.datetime.fromtimestamp(ts, datetime.UTC), e[swap], e[1 - swap], 6, side == swap, seq, ack if n else 0, size, 8000, syn, False, False, n > 0, None))
            seen = state.observe(side, n + 1, ts * 10**9, seq, ack if n else 0, size, 8000, syn, False, False, n > 0, None)
            for f in seen.names():
                said[f] += 1
        assert c == "odd" or not said
    spark.createDataFrame(rows, SEGMENT).write.parquet(str(tmp_path / "stream_segment.parquet"))
    got = {x.finding: x.segments for x in segments.segment_findings(spark, str(tmp_path)).collect()}
    assert {"lost_segment", "overlap"} <= set(said) and got == dict(said)


def fragments(datagram, proto, ident, cut=24):
    """The datagram as two frames, cut at a multiple of 8."""
    return [P.eth(P.ip(datagram[:cut], proto, ident=ident, flags=0x2000)), P.eth(P.ip(datagram[cut:], proto, ident=ident, flags=cut // 8))]


@pytest.mark.parametrize("text,numbers", [('dns.qry.name == "www.example.com"', [2, 5]), ("!dns", [1, 3, 4, 6, 7]), ("icmp.seq == 7", [6]), ('udp contains "example"', [2, 5]), ("frame.len > 0 && dns", [2, 5]), ("udp.checksum && !dns.qry.name", [7])])
def test_displayed_meets_fragments(spark, text, numbers):
    dns = P.udp(b"\x1a\x2b\x01\0\0\x01\0\0\0\0\0\0" + name("www.example.com") + b"\0\x01\0\x01", 5000, 53)
    one, ping = fragments(dns, 17, 5), fragments(b"\x08\0\0\0\0\x01\0\x07" + b"p" * 40, 1, 6)
    frames = [one[0], one[1], ping[1], fragments(dns, 17, 7)[0], P.eth(P.ip(dns, 17)), ping[0], P.eth(P.ip(P.udp(b"x", 9, 10), 17))]
    raw = spark.createDataFrame(P.rows(frames), P.RAW)
    got = lambda df: sorted(r.number for r in df.select("number").collect())
    assert got(displayed(raw, text)) == numbers == got(stage.dissect(raw).where(compile_filter(text)))


def test_conversations_of_deep_frames_and_reused_ports(spark):
    a6, b6 = bytes(15) + b"\1", bytes(15) + b"\2"
    syn = P.segment(flags=2)
    whole = P.udp(b"z" * 40, 5000, 53)
    one = fragments(whole, 17, 9)
    tags = P.eth(b"\0\1\x81\0\0\2\x81\0\0\3\x08\0" + P.ip(P.udp(b"vlan", 5000, 53), 17), 0x8100)
    hop = P.eth(P.ip6(b"\x11\0" + bytes(6) + P.udp(b"six", 7, 8, src=a6, dst=b6), 0, a6, b6), 0x86DD)
    quote = P.eth(P.ip(b"\x03\x03" + bytes(6) + P.ip(whole, 17)[:28], 1, P.IP_B, P.IP_A))
    frames = [syn, P.segment(b"abc", back=True), one[0], one[1], tags, hop, syn, P.segment(b"d"), quote, P.eth(P.ip(P.udp(b"r", 53, 5000, src=P.IP_B, dst=P.IP_A), 17, P.IP_B, P.IP_A))]
    raw = spark.createDataFrame(P.rows(frames), P.RAW)
    n = lambda *i: sum(len(frames[k - 1]) for k in i)

    def got(layer):
        c = reports.conversations(reports.packets(raw, layer), ["stream_id"])
        return sorted((r.stream_id, (bytes(r.a.addr), r.a.port), (bytes(r.b.addr), r.b.port), r.packets_a, r.packets_b, r.bytes_a, r.bytes_b, r.first_number, r.duration_s) for r in c.collect())

    # a SYN on known ports begins another stream; the frame that completes a datagram holds its ports
    a, b = (P.IP_B, 7000), (P.IP_A, 40000)
    assert got("tcp") == [(0, a, b, 1, 1, n(2), n(1), 1, 1.0), (3, a, b, 0, 2, 0, n(7, 8), 7, 1.0)]
    # an ICMP error has its own addresses, the ports and the stream of what it quotes
    assert got("udp") == [(1, (P.IP_B, 53), (P.IP_A, 5000), 1, 2, n(10), n(4, 5), 4, 6.0), (1, (P.IP_B, 5000), (P.IP_A, 53), 1, 0, n(9), 0, 9, 0.0), (2, (a6, 7), (b6, 8), 1, 0, n(6), 0, 6, 0.0)]


def test_items_repeated_in_a_session_count_once(spark):
    r = random.Random(5)
    rows = [(r.choice(("a", None)), r.randrange(400), r.choice((1, 2, 3, 4, 5, 6, 7, None))) for _ in range(160)]
    want = []
    for k in ("a", None):
        run = []
        for t, i in [*sorted(((t, i) for x, t, i in rows if x == k), key=lambda x: x[0]), (10**6, None)]:
            if run and t - run[-1][0] > 6:
                want.append((k, run[0][0], run[-1][0], run[-1][0] - run[0][0], len(run), len({i for _, i in run} - {None})))
                run = []
            run.append((t, i))
    df = spark.createDataFrame(rows, "k string, us bigint, frame bigint")
    for shard in (7, 50, 10**6):
        got = [tuple(x) for x in sessions.sessions(df, ["k"], "us", "frame", 6, shard, once_a_session=True).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_streaming_segments_behind_nested_headers(spark):
    a6, b6 = bytes(15) + b"\1", bytes(15) + b"\2"
    tcp = P.tcp(b"abc", 5, 6, seq=77, flags=0x12, window=900, options=b"\3\3\7\0")
    hop = P.eth(P.ip6(b"\x06\0" + bytes(6) + tcp, 0, a6, b6), 0x86DD)
    tags = P.eth(b"\0\1\x81\0\0\2\x81\0\0\3\x08\0" + P.ip(tcp, 6), 0x8100)
    quote = P.eth(P.ip(b"\x03\x03" + bytes(6) + P.ip(tcp, 6), 1, P.IP_B, P.IP_A))
    raw = spark.createDataFrame(P.rows([hop, tags, quote, P.eth(P.ip(tcp, 6))]), P.RAW)
    got = {r.number: r for r in live.segments(raw).collect()}
    assert sorted(got) == [1, 2, 4]
    for r in got.values():
        assert (r.seq, r.size, r.win, r.flags, bytes(r.options)) == (77, 3, 900, 0x12, b"\3\3\7\0")
    assert (got[2].a, got[2].b, got[2].sender) == (got[4].a, got[4].b, got[4].sender)
    assert got[1].sender == f"{a6.hex().upper()}/00005" and got[1].b == f"{b6.hex().upper()}/00006"
