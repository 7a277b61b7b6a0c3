"""Layers on hand-made frames, and the distributed stage against one sequential pass over the same frames."""

import random
import struct

import packets as P
import pytest
from pyspark.sql import functions as F

from tidewire.dissect import flow, headers, layers, stage
from tidewire.dissect.fields import FIELDS

D, N = bytes, None


def dissect(raw, link=1, **more):
    x = layers.frame(raw, link, 1, 1_700_000_000_123_456_000, len(raw), **more)
    assert set(x.tree.field) <= set(FIELDS)
    return x


def value(x, field):
    t = x.tree
    return [next((v for v in (t.u[i], t.b[i], t.s[i], t.a[i]) if v is not None), None) for i, f in enumerate(t.field) if f == field]


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".")) + b"\0"


ARP = struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + P.MAC_A + P.IP_A + bytes(6) + D([192, 168, 1, 1])
ECHO = (lambda b: b[:2] + P._sum(b) + b[4:])(b"\x08\0\0\0\x12\x34\0\x01hello")
HELLO = b"\x16\x03\x01" + (lambda h: struct.pack(">H", len(h)) + h)(b"\x01" + (lambda b: len(b).to_bytes(3, "big") + b)(b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + (lambda e: struct.pack(">H", len(e)) + e)(b"\0\0\0\x10\0\x0e\0\0\x0bexample.com" + b"\0\x10\0\x05\0\x03\x02h2" + b"\0\x2b\0\x03\x02\x03\x04")))
INFO = [
    (P.eth(ARP, 0x0806), "arp", "Who has 192.168.1.1? Tell 192.168.1.10"),
    (P.eth(b"\0\x05\x08\x06" + ARP, 0x8100), "arp", "Who has 192.168.1.1? Tell 192.168.1.10"),
    (P.eth(b"\x42\x42\x03" + bytes(20), 23), "llc", "LLC DSAP 0x42 SSAP 0x42"),
    (P.eth(b"\xaa\xaa\x03\0\0\x0c\x20\0xx", 10), "llc", "SNAP OUI 0x00000c PID 0x2000"),
    (P.eth(bytes(9), 0x88B5), "eth", "Ethertype 0x88b5"),
    (P.eth(P.ip(ECHO, 1)), "icmp", "Echo (ping) request id=0x1234, seq=1"),
    (P.eth(P.ip(b"\x03\x03\0\0\0\0\0\0" + P.ip(P.udp(b"q", 4000, 5000), 17), 1, P.IP_B, P.IP_A)), "icmp", "Destination port unreachable"),
    (P.eth(P.ip(b"x", 99)), "ip", "Unknown (99)"),
    (P.eth(P.ip(P.udp(b"y" * 11, 40000, 9), 17)), "udp", "40000 → 9 Len=11"),
    (P.segment(flags=2, seq=1000, window=65535, options=b"\x02\x04\x05\xb4\x01\x03\x03\x07\x04\x02\0\0"), "tcp", "40000 → 7000 [SYN] Seq=1000 Ack=0 Win=65535 Len=0"),
    (P.eth(P.ip(P.udp(struct.pack(">HHHHHH", 0x1A2B, 0x0100, 1, 0, 0, 0) + name("www.example.com") + b"\0\x01\0\x01", 5000, 53), 17)), "dns", "Standard query 0x1a2b A www.example.com"),
    (P.eth(P.ip(P.udp(struct.pack(">HHHHHH", 2, 0x8180, 1, 2, 0, 0) + name("a.b") + b"\0\x01\0\x01" + b"\xc0\x0c\0\x05\0\x01\0\0\0\x0a\0\x04\x01c\xc0\x0e" + b"\xc0\x0c\0\x01\0\x01\0\0\0\x0a\0\x04\x01\x02\x03\x04", 53, 5000), 17)), "dns", "Standard query response 0x0002 A a.b CNAME c.b A 1.2.3.4"),
    (P.eth(P.ip(P.udp(b"\x01\x01\x06\0\xab\xcd\x12\x34" + bytes(20) + P.MAC_A + bytes(10 + 192) + b"\x63\x82\x53\x63\x35\x01\x01\x37\x02\x01\x03\xff", 68, 67), 17)), "dhcp", "DHCP Discover - Transaction ID 0xabcd1234 from 00:11:22:33:44:55"),
    (P.segment(b"GET /index.html HTTP/1.1\r\nHost: h\r\n\r\n", dport=80), "http", "GET /index.html HTTP/1.1"),
    (P.segment(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", back=True, dport=80), "http", "HTTP/1.1 200 OK"),
    (P.segment(b"nonsense", dport=80), "http", "Continuation"),
    (P.segment(HELLO, dport=443), "tls", "Client Hello"),
    (P.segment(b"\x15\x03\x03\0\x02\x01\0", dport=443), "tls", "Alert (Close Notify)"),
    (P.segment(b"\0\0nothing", dport=443), "tls", "Continuation Data"),
    (P.eth(b""), "ip", "[Malformed Packet: ip] truncated at offset 14: need 1 bytes, 0 left"),
    (P.eth(b"\x44" + bytes(30)), "ip", "[Malformed Packet: ip] invalid IPv4 header length (IHL < 5) at offset 14"),
    (b"", "eth", "[Malformed Packet: eth] truncated at offset 0: need 6 bytes, 0 left"),
    (P.eth(P.ip(P.udp(b"", 1, 2, length=7), 17)), "udp", "[Malformed Packet: udp] invalid UDP length (< 8) at offset 38"),
    (P.eth(P.ip(struct.pack(">HHHHHH", 1, 53, 30, 0, 0, 0)[:8] + struct.pack(">HHHHHH", 1, 0x100, 1, 0, 0, 0) + b"\xc0\x30\0\0", 17)), "dns", "Standard query 0x0001 [Malformed]"),
]


@pytest.mark.parametrize("raw,protocol,info", INFO)
def test_info(raw, protocol, info):
    x = dissect(raw)
    assert (x.protocol, x.info) == (protocol, info)


def test_fields():
    x = dissect(INFO[9][0])
    assert value(x, "tcp.options.mss_val") == [1460] and value(x, "tcp.options.wscale.multiplier") == [128] and value(x, "tcp.checksum.status") == [1]
    x = dissect(INFO[16][0])
    assert value(x, "tls.handshake.extensions_server_name") == ["example.com"] and value(x, "tls.handshake.extensions_alpn_str") == ["h2"] and value(x, "tls.handshake.extensions.supported_version") == [0x0304]
    x = dissect(INFO[6][0])
    assert value(x, "udp.srcport") == [4000] and x.protocols == ["eth", "ip", "icmp"] and x.src == P.IP_B
    x = dissect(P.eth(P.ip(b"x", 99, good=False)))
    assert value(x, "ip.checksum.status") == [0] and x.expert == (4, 1, "Bad IPv4 header checksum")
    assert dissect(P.eth(P.ip(b"x", 99, good=False)), options=layers.Options(False, False)).expert is None
    assert value(dissect(P.eth(P.ip(P.udp(b"z", 1, 2), 17)) + bytes(9)), "eth.padding") == [None]
    assert value(dissect(P.eth(P.ip(P.udp(b"z", 1, 2, sum_=False), 17)) + b"tail"), "udp.checksum.status") == [3]


def test_ipv6_and_null():
    a, b = bytes.fromhex("fe80" + "00" * 13 + "01"), bytes.fromhex("20010db8" + "00" * 11 + "01")
    hop = b"\x3c\0\x05\x02\0\0\x01\0" + b"\x11\0\x01\x04\0\0\0\0"
    x = dissect(P.eth(P.ip6(hop + P.udp(b"hello", 1234, 5678, a, b, sum_=False), 0, a, b), 0x86DD))
    assert x.info == "1234 → 5678 Len=5" and value(x, "ipv6.opt.router_alert") == [0]
    x = dissect(P.eth(P.ip6(b"\x11\0\0\x08\0\0\0\x07rest", 44, a, b), 0x86DD))
    assert x.info == "Fragmented IPv6 (proto=UDP 17)"
    x = dissect(b"\x1e\0\0\0" + P.ip6(b"\x87\0\0\0\0\0\0\0" + b, 58, a, b), link=0)
    assert x.info == "Neighbor Solicitation for 2001:db8::1"


def test_every_truncation_and_corruption_is_total():
    r = random.Random(1)
    for raw, _, _ in INFO:
        for n in range(len(raw)):
            x = dissect(raw[:n])
            assert all(0 <= s <= e for s, e in zip(x.tree.start, x.tree.end)) and x.tree.level == 0
        for _ in range(60):
            b = bytearray(raw or b"\0")
            b[r.randrange(len(b))] = r.randrange(256)
            x = dissect(bytes(b))
            sizes = [len(b), *map(len, x.sources)]
            assert all(e <= sizes[s] for s, e in zip(x.tree.source, x.tree.end)) and x.tree.level == 0


MS = 10**6


class Talk:
    """A stream in which either side says bytes at a time in milliseconds; answers what the analysis sees."""

    def __init__(self, client=700, server=90_000):
        self.stream, self.frame, self.next = flow.Stream(), 0, [client, server]

    def say(self, side, ms, n=0, at=None, ack=None, win=4000, syn=False, fin=False, rst=False, acks=True, scale=None):
        self.frame += 1
        seq = self.next[side] if at is None else at
        seen = self.stream.observe(side, self.frame, ms * MS, seq % 2**32, (self.next[1 - side] if ack is None else ack) % 2**32, n, win, syn, fin, rst, acks, scale)
        if at is None:
            self.next[side] = seq + n + syn + fin
        return seen

    def opened(self):
        assert self.say(0, 0, syn=True, acks=False).names() == self.say(1, 1, syn=True).names() == self.say(0, 2).names() == []
        return self


@pytest.mark.parametrize("client", [700, 2**32 - 30])
def test_sequence_analysis(client):
    new = lambda: Talk(client).opened()
    t = new()
    start = t.next[0]
    assert t.say(0, 20, 25).in_flight == 25 and t.say(0, 22, 25).in_flight == 50
    assert t.say(0, 500, 25, at=start).names() == ["retransmission"] and t.say(0, 501, 25, at=start + 25).names() == ["retransmission"]
    t.say(1, 520)
    assert t.say(0, 530, 25, at=start).names() == ["spurious_retransmission"]
    assert t.say(0, 540, 40, at=start + 30).names() == ["overlap"]

    t = new()
    start = t.next[0]
    assert t.say(0, 30, 8, at=start + 16).names() == ["lost_segment"] and t.say(0, 32, 8, at=start + 8).names() == ["out_of_order"]
    again = [t.say(1, 41 + i, ack=start) for i in range(3)]
    assert [(x.names(), x.ack_number, x.ack_frame) for x in again] == [(["duplicate_ack"], i, 2) for i in (1, 2, 3)]
    assert t.say(0, 50, 8, at=start).names() == ["fast_retransmission"] and t.say(0, 90, 8, at=start).names() == ["retransmission"]

    t = new()
    assert t.say(1, 5, win=0).names() == ["zero_window"] and t.say(1, 6, win=12).names() == []
    assert t.say(0, 7, 5).names() == [] and t.say(0, 8, 7).names() == ["window_full"]
    t.say(1, 9)
    assert t.say(0, 60_000, 1, at=t.next[0] - 1).names() == ["keep_alive"]
    assert t.say(1, 60_001, ack=t.next[0] + 77).names() == ["ack_lost_segment"]
    assert t.say(0, 60_002, rst=True, win=0).names() == []


def sequential(frames, capture="c"):
    """All state in one pass, as a single worker would keep it."""
    streams, ids, datagrams, out = {}, {}, {}, []
    for cap, number, link, ts, orig, raw in sorted(frames, key=lambda r: r[1]):
        whole = None
        probe = layers.frame(raw, link, number, ts, orig)
        t = probe.tree
        if "ip.frag_offset" in t.field and not any(f == "icmp" for f in t.field):
            i, flags = t.field.index("ip.frag_offset"), t.b[t.field.index("ip.flags.mf")]
            if t.u[i] or flags:
                key = (probe.src, probe.dst, t.u[t.field.index("ip.id")], t.u[t.field.index("ip.proto")])
                start = 14 + t.u[t.field.index("ip.hdr_len")]
                whole = datagrams.setdefault(key, flow.Fragments()).add(t.u[i], flags, raw[start : 14 + t.u[t.field.index("ip.len")]], number, ts)
                probe = layers.frame(raw, link, number, ts, orig, whole=whole)
        a, b, proto, fresh = stage._ends(probe)
        state = stream = None
        if a is not None:
            key = (*sorted([(a["addr"], a["v6"], a["port"]), (b["addr"], b["v6"], b["port"])]), proto)
            if key not in ids or fresh:
                ids[key] = len(streams)
                streams[ids[key]] = flow.Stream()
            stream, state = ids[key], streams[ids[key]]
        x = layers.frame(raw, link, number, ts, orig, stream=state, stream_id=stream, whole=whole)
        out.append((number, stream, x.protocol, x.info, x.protocols, list(zip(x.tree.field, x.tree.u, x.tree.source, x.tree.start, x.tree.end, x.tree.text))))
    return out


def mixed_frames():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 30\r\n\r\n0123456789abcdefghijABCDEFGHIJ"
    big = P.udp(b"F" * 40, 4000, 5000)
    f = [
        P.segment(flags=2, seq=100, dport=80), P.segment(flags=0x12, seq=900, ack=101, back=True, dport=80),
        P.segment(b"GET /a HTTP/1.1\r\n\r\n", seq=101, ack=901, dport=80), P.eth(P.ip(big[32:], 17, ident=7, flags=4)),
        P.segment(body[:20], seq=901, ack=120, back=True, dport=80), P.eth(P.ip(big[:16], 17, ident=7, flags=0x2000)),
        P.segment(body[20:50], seq=921, ack=120, back=True, dport=80), P.segment(HELLO[:4], seq=1, sport=50000, dport=443),
        P.eth(P.ip(big[16:32], 17, ident=7, flags=0x2002)), P.segment(body[50:], seq=951, ack=120, back=True, dport=80),
        P.segment(HELLO[4:], seq=5, sport=50000, dport=443), P.segment(flags=2, seq=7000, dport=80),
        P.eth(P.ip(b"\x03\x03\0\0\0\0\0\0" + P.ip(big, 17, ident=9), 1, P.IP_B, P.IP_A)), P.eth(ARP, 0x0806), b"",
        P.segment(b"GET /one HTTP/1.1\r\n\r\nGET /two HTTP/1.1\r\n\r\n", seq=7001, dport=80), P.segment(flags=0x11, seq=7041, dport=80),
    ]
    return P.rows(f)


def test_stage_equals_one_pass(spark):
    rows = mixed_frames()
    got = stage.dissect(spark.createDataFrame(rows, P.RAW).repartition(4)).collect()
    want = sequential(rows)
    assert len(got) == len(want)
    by = {r.number: r for r in got}
    for number, stream, protocol, info, protocols, nodes in want:
        r = by[number]
        assert (r.stream_id, r.protocol, r.info, r.protocols) == (stream, protocol, info, protocols), number
        assert [(n.field, n.u, n.source, n.start, n.end, n.text) for n in r.nodes] == nodes
    assert by[10].info == "HTTP/1.1 200 OK" and by[11].info == "Client Hello" and by[9].info == "4000 → 5000 Len=40"
    assert by[5].info == "[TCP segment of a reassembled PDU]" and by[12].stream_id != by[1].stream_id
    assert stage.dissect(spark.createDataFrame([], P.RAW)).count() == 0


def test_headers_agree_with_the_tree(spark, data):
    table = stage.as_raw(spark.read.parquet(f"{data}/fixture_frame.parquet"))
    raw = table.unionByName(spark.createDataFrame(P.rows([r for r, _, _ in INFO] + [f[5] for f in mixed_frames()], "made"), P.RAW))
    h = headers.headers(raw).where("not deep")
    j = h.join(stage.dissect_stateless(raw).select("capture_id", "number", "nodes"), ["capture_id", "number"])
    part = {"unsigned": "u", "enum": "u", "bool": "b", "mac": "a", "ipv4": "a", "ipv6": "a"}
    checks = [F.expr(f"sum(cast(not ({c} <=> get(filter(nodes, n -> n.field = '{f}'), 0).{part[FIELDS[f].kind]}) as int))").alias(c) for f, c in headers.PROMOTED.items() if not f.startswith("frame.")]
    checks += [F.expr(f"sum(cast(({c} is not null) <> exists(nodes, n -> n.field = '{p}') as int))").alias(f"has_{p}") for p, c in headers.PRESENT.items()]
    r = j.agg(*checks).first().asDict()
    assert {k: v for k, v in r.items() if v} == {}
