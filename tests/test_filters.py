"""The filter language: syntax, type rules, errors, and selection on frames, over the tree and over header columns."""

import packets as P
import pytest
from test_dissect import ARP, HELLO, mixed_frames, name
from pyspark.sql import functions as F

from tidewire.dissect import headers, stage
from tidewire.dissect.fields import FIELDS
from tidewire.filters import FilterError, compile_filter, flat_filter, parse
from tidewire.filters.compiler import displayed
from tidewire.filters.language import field_names, nearest, suggest, suggest_at


@pytest.fixture(scope="module")
def raw(spark):
    dns = P.eth(P.ip(P.udp(b"\x1a\x2b\x01\0\0\x01\0\0\0\0\0\0" + name("www.Example.com") + b"\0\x01\0\x01", 5000, 53), 17))
    more = [dns, P.eth(b"\0\x05\x08\0" + P.ip(P.udp(b"inside vlan", 9, 10), 17, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 200])), 0x8100), P.segment(HELLO, dport=443), P.eth(P.ip(b"x", 99, good=False))]
    frames = [r[5] for r in mixed_frames()] + more
    return spark.createDataFrame(P.rows(frames), P.RAW).cache()


@pytest.fixture(scope="module")
def frames(raw):
    return stage.dissect(raw).cache()


CASES = [
    ("udp", [9, 13, 18, 19], None), ("ip.fragments", [9], None), ("tcp.port == 443", [8, 11, 20], None), ("tcp.port != 443", [1, 2, 3, 5, 7, 8, 10, 11, 12, 16, 17, 20], None),
    ("http.request.uri == \"/two\"", [16], None), ("http.response.code == 200", [10], None), ('http.request.uri matches "^/(one|a)$"', [3, 16], None), ("http.segment", [5, 7], None), ("tls.segment", [8], None),
    ('tls.handshake.extensions_server_name contains "example"', [11, 20], None), ("arp.opcode == \"REQUEST\"", [14], None), ("eth.type == 0x0806", [14], None), ("ip.src == 192.168.0.0/16 && !tcp && !udp", [4, 6, 21], None),
    ("ip.addr == 10.0.0.128/25", [19], None), ("vlan.id == 5", [19], None), ("eth.dst[0] == 0x66", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18, 19, 20, 21], None), ("eth.src[1:2] == 11:22", None, None),
    ("_ws.checksum.bad", [13, 19, 21], None), ('_ws.expert.severity >= "Error"', [13, 15, 19, 21], None), ("_ws.malformed", [15], None), ("frame.number in {3, 5} || frame.number > 20", [3, 5, 21], None), ("tcp.flags.syn == true and tcp.flags.ack == 0", [1, 12], None),
    ('dns.qry.name == "www.Example.com"', [18], None), ('udp contains "vlan"', [19], None), ("udp contains 69:6e:73", [19], None), ("not (tcp or udp)", [4, 6, 14, 15, 21], None), ("tcp.stream == 0 && http", [3, 10], None), ("icmp.type == 3 && udp.dstport == 5000", [13], None),
    ("", list(range(1, 22)), None), ("tcp.len > 10 && tcp.len <= 20 && tcp.dstport == 80", [3], None), ("udp.payload[0:6] == 69:6e:73:69:64:65", [19], None), ("frame.time_epoch < \"1700000002\"", [1, 2], None), ("data.len == 1", [21], None),
]


@pytest.mark.parametrize("text,want", [(t, w) for t, w, _ in CASES if w is not None])
def test_selection(raw, frames, text, want):
    got = sorted(r.number for r in frames.where(compile_filter(text)).select("number").collect())
    assert got == want
    assert sorted(r.number for r in displayed(raw, text).select("number").collect()) == want


ERRORS = [
    ("ip.srx == 1.2.3.4", "did you mean ip.src", 0), ("ip[0:1] == 1", "slice", 2), ("tcp.port == ", "literal", 12), ("ip.src == ip.dst", "fields are not compared", 10), ("(tcp", "expected ')'", 4), ("tcp.port == \"a\"", "a number", 12),
    ('eth.type == "nope"', "names no value", 12), ("tcp.flags.syn > 1", "does not apply", 14), ("ip.src > 1.2.3.4", "does not apply", 7), ('"abc', "unterminated", 0), ('http.host matches "(?=a)"', "look-around", 18), ("tcp.port in {80", "expected '}'", 15),
    ("tcp && && udp", "expected a field", 7), ("ip.src == 1.2.3.4/40", "at most 32", 10), ("tcp.port == 99999999999999999999999", "too large", 12), ("@", "unexpected character", 0), ("eth.src[0:0] == 1", "length 0", 7), ("tcp == 1", "does not apply", 4),
    ("http.host contains 5", "a string", 19), ('http.host == "\\q"', "unknown escape", 14), ("eth.src == 00:11", "six bytes", 11), ("tcp udp", "unexpected", 4), ("!" * 70 + "tcp", "too deeply", 64), ('http.host matches "(a)\\\\1"', "back-ref", 18),
]


@pytest.mark.parametrize("text,part,column", ERRORS)
def test_errors(text, part, column):
    with pytest.raises(FilterError) as e:
        parse(text)
    assert part in e.value.message and e.value.column == column and 0 <= column <= len(text)


def test_every_field_compiles(frames):
    for f in FIELDS:
        assert parse(f).field.name == f
    some = [f for f in FIELDS if f.startswith(("tcp", "ip", "eth"))]
    assert frames.where(compile_filter(" || ".join(some))).count() == 20


def test_flat_equals_tree(raw, frames):
    h = headers.headers(raw).where("not deep")
    tree = {r.number: r for r in frames.select("number", *(compile_filter(t).alias(f"t{i}") for i, (t, _, _) in enumerate(CASES) if flat_filter(t) is not None)).collect()}
    flat = h.select("number", *(flat_filter(t).alias(f"t{i}") for i, (t, _, _) in enumerate(CASES) if flat_filter(t) is not None)).collect()
    for r in flat:
        for k, v in r.asDict().items():
            assert v == tree[r.number][k], (k, r.number)


def test_long_chains_and_completion(frames):
    text = " || ".join(f"tcp.srcport == {60000 + i}" for i in range(500))
    assert frames.where(compile_filter(text)).count() == 0
    assert field_names(parse("tcp.port == 1 || !ip.src")) == {"tcp.srcport", "tcp.dstport", "ip.src"}
    assert nearest("tcp.prot") == "tcp.port" and suggest("tcp.an")[0] == "tcp.analysis" and "udp.port" in suggest_at("udp.po == 1", 6)


def test_unsigned_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 2**63 - 1, -1, -(2**63))], "u bigint")
    n = [v % 2**64 for v in (0, 5, 2**63 - 1, -1, -(2**63))]
    from tidewire.filters.compiler import _value

    for lit in (0, 5, 2**63, 2**64 - 1, 2**63 - 1, -3):
        for op, f in (("==", int.__eq__), ("!=", int.__ne__), ("<", int.__lt__), ("<=", int.__le__), (">", int.__gt__), (">=", int.__ge__)):
            got = [r[0] for r in df.select(F.coalesce(_value(FIELDS["http.content_length"], op, F.col("u"), lit), F.lit(None))).collect()]
            assert got == [f(v, lit) for v in n], (op, lit)


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("a[$]b", ["a$b"], ["ab", "a"]), ("end$", ["the end"], ["end\n", "ends"]), ("(?m)end$", ["the end\nof", "end"], ["ends"]), ("(?m:end$)|x$", ["end\n.", "x"], ["x\n"]), (r"\$5", ["$5"], ["5"]),
        ("[[:digit:]]{2}$", ["a42"], ["4a"]), ("[]x]", ["]", "x"], ["["]), (r"\p{Lu}\d", ["A1"], ["a1"]), ("(?P<one_two>a)b", ["ab"], ["b"]), (r"\x{41}", ["A"], ["B"]), (r"[\]$]$", ["]", "a$"], ["$a"]),
    ],
)
def test_patterns_as_they_are_written(spark, pattern, yes, no):
    from tidewire.filters.language import _pattern

    df = spark.createDataFrame([(x,) for x in yes + no], "s string")
    got = [r[0] for r in df.where(F.rlike("s", F.lit("(?dU)" + _pattern(pattern, 0, 1)))).collect()]
    assert sorted(got) == sorted(yes)


@pytest.mark.parametrize("pattern", ["(", "[a", "a)", "*", "a\\", "(?=a)", r"(a)\1", "[b-a]"])
def test_patterns_that_are_refused(pattern):
    from tidewire.filters.language import FilterError, _pattern

    with pytest.raises(FilterError):
        _pattern(pattern, 0, 1)
