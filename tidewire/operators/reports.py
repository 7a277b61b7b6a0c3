"""Reports over frames: conversations, protocol hierarchy, traffic series, expert findings, colours, search, time columns.

Windows never span a capture where a capture may be large: running values go by blocks of frame numbers, and the blocks'
totals are few. Results name no order; the orders a report is shown in are given by the functions called *_order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.dissect import expert, labels, stage
from tidewire.dissect.headers import headers
from tidewire.filters.compiler import compile_filter, evaluated
from tidewire.filters.language import FilterError
from tidewire.functions.text import addr_text

BLOCK = 1 << 20
CHUNK_FRAMES, RING_FRAMES, RING_BYTES = 4096, 1_000_000, 2 << 30  # fixed values
MOST_BUCKETS, SAMPLE = 100_000, 32  # fixed values
INTERVALS = (0.001, 0.01, 0.1, 1.0, 10.0, 60.0, 600.0)
SERIES = (("All", ""), ("TCP", "tcp"), ("Problems", '_ws.expert.severity >= "Warning"'))

#: name, filter, of the default rules, first match first
COLOURS = (("Malformed", "_ws.malformed"), ("Bad checksum", "_ws.checksum.bad"), ("TCP problem", '_ws.expert.severity >= "Warning" && tcp'), ("Reset", "tcp.flags.reset == 1"), ("ARP", "arp"), ("ICMP", "icmp || icmpv6"), ("TLS", "tls"), ("HTTP", "http"), ("DNS", "dns"), ("DHCP", "dhcp"), ("UDP", "udp"), ("TCP", "tcp"))


def _end(addr: Column, port: Column | None = None) -> Column:
    return F.struct(addr.alias("addr"), (F.lit(None).cast("bigint") if port is None else port).alias("port"))


def packets(raw: DataFrame, layer: str) -> DataFrame:
    """capture_id, number, ts_ns, orig_len, src, dst of the frames that have the layer (eth, ip, tcp, udp), and for tcp and
    udp their stream_id. Ports are found behind IPv6 extension headers, in datagrams of several fragments (at the frame that
    completes one), behind any VLAN tags and in what an ICMP error quotes, with the frame's own addresses. Of eth and ip the
    outer headers count; IP behind more than two VLAN tags or LLC does not."""
    if layer in ("tcp", "udp"):
        f = stage.with_flows(raw, ("capture_id", "number", "ts_ns", "orig_len")).drop("whole")
        f = stage.with_streams(f.where("src_end is not null")).where(F.col("flow_proto") == {"tcp": 6, "udp": 17}[layer])
        return f.select("capture_id", "number", "ts_ns", "orig_len", *(_end(F.col(f"net_{s}"), F.col(f"{s}_end.port")).alias(s) for s in ("src", "dst")), "stream_id")
    h = headers(raw, ("eth_src", "eth_dst") if layer == "eth" else ("ip_src", "ip_dst", "ip6_src", "ip6_dst"))
    src, dst = (F.col("eth_src"), F.col("eth_dst")) if layer == "eth" else (F.coalesce("ip_src", "ip6_src"), F.coalesce("ip_dst", "ip6_dst"))
    return h.where(src.isNotNull()).select("capture_id", "number", "ts_ns", "orig_len", _end(src).alias("src"), _end(dst).alias("dst"))


def conversations(p: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per pair of ends (and the extra key columns): a, b with a <= b; packets and bytes sent by
    either; first_number; first and last time in capture order; duration_s (not negative) and bits per second, null for a
    duration of up to a microsecond. Bytes are lengths on the wire. The tcp and udp reports have stream_id as extra: without
    it, connections that reuse a pair of ports are one row."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    p = p.withColumns({"a": low, "b": high, "fwd": F.col("src") == low})
    n = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    out = p.groupBy("capture_id", "a", "b", *extra).agg(n(F.col("fwd"), 1).alias("packets_a"), n(~F.col("fwd"), 1).alias("packets_b"), n(F.col("fwd"), F.col("orig_len")).alias("bytes_a"), n(~F.col("fwd"), F.col("orig_len")).alias("bytes_b"), F.min("number").alias("first_number"), F.min_by("ts_ns", "number").alias("first_ns"), F.max_by("ts_ns", "number").alias("last_ns"))
    d = F.greatest((F.col("last_ns") - F.col("first_ns")) / 1e9, F.lit(0.0))
    return out.withColumn("duration_s", d).withColumn("bps", F.when(d > 1e-6, (F.col("bytes_a") + F.col("bytes_b")) * 8 / d))


def conversations_order(c: DataFrame, by: str = "bytes") -> DataFrame:
    key = {"bytes": F.col("bytes_a") + F.col("bytes_b"), "packets": F.col("packets_a") + F.col("packets_b"), "duration": F.col("duration_s"), "rate": F.col("bps")}[by]
    return c.orderBy(F.desc_nulls_last(key), "first_number")


def conversation_filter(row, layer: str) -> str:
    """The display filter that selects a conversation's frames."""
    from tidewire.dissect.tree import addr_text

    proto = {"eth": "eth", "ip": "ip" if len(row.a.addr) == 4 else "ipv6"}.get(layer, "ip" if len(row.a.addr) == 4 else "ipv6")
    parts = [f"{proto}.addr == {addr_text(bytes(e.addr))}" for e in (row.a, row.b)]
    return " && ".join(parts + [f"{layer}.port == {e.port}" for e in (row.a, row.b) if e.port is not None])


def hierarchy(frames: DataFrame) -> DataFrame:
    """capture_id, path (chain joined by :), depth, packets, bytes, end_packets, end_bytes, order (of the depth-first walk,
    siblings as first seen). frames: capture_id, number, orig_len, protocols."""
    f = frames.select("capture_id", "number", "orig_len", "protocols").where(F.size("protocols") > 0)
    x = f.select("capture_id", "number", "orig_len", F.size("protocols").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("protocols")), lambda i: F.slice("protocols", 1, i))).alias("chain"))
    last = F.size("chain") == F.col("n")
    g = x.groupBy("capture_id", "chain").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.sum(F.when(last, 1).otherwise(0)).alias("end_packets"), F.sum(F.when(last, F.col("orig_len")).otherwise(0)).alias("end_bytes"), F.min("number").alias("first"))
    # paths are few: each looks its ancestors' first frames up, which order the walk
    cols = ["chain", "packets", "bytes", "end_packets", "end_bytes", "first"]
    every = g.groupBy("capture_id").agg(F.collect_list(F.struct(*cols)).alias("all")).select("capture_id", "all", F.explode("all").alias("x"))
    up = F.filter("all", lambda y: y["chain"] == F.slice(F.col("x.chain"), 1, F.size(y["chain"])))
    order = F.transform(F.array_sort(F.transform(up, lambda y: F.struct(F.size(y["chain"]).alias("d"), y["first"].alias("first"), F.element_at(y["chain"], -1).alias("p")))), lambda s: F.struct(s["first"], s["p"]))
    return every.select("capture_id", F.array_join("x.chain", ":").alias("path"), F.size("x.chain").alias("depth"), *(f"x.{c}" for c in cols[1:5]), order.alias("order"))


def hierarchy_filter(path: str) -> str:
    return " && ".join(path.split(":"))


def totals(frames: DataFrame) -> DataFrame:
    """capture_id, packets, bytes, duration_s (first to last frame in capture order), bps."""
    g = frames.groupBy("capture_id").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.min_by("ts_ns", "number").alias("first_ns"), F.max_by("ts_ns", "number").alias("last_ns"))
    d = F.greatest((F.col("last_ns") - F.col("first_ns")) / 1e9, F.lit(0.0))
    return g.select("capture_id", "packets", "bytes", d.alias("duration_s"), F.when(d > 1e-6, F.col("bytes") * 8 / d).alias("bps"))


def series_predicates(series: Sequence[tuple[str, str]], build=compile_filter) -> tuple[list[tuple[str, Column]], dict[str, str]]:
    """Predicates of named filters, and the errors of those that do not compile; these select nothing."""
    out, errors = [], {}
    for name, text in series:
        try:
            out.append((name, build(text)))
        except FilterError as e:
            out.append((name, F.lit(False)))
            errors[name] = str(e)
    return out, errors


def io_graph(frames: DataFrame, series: Sequence[tuple[str, Column]], interval: float, unit: str = "packets", times: DataFrame | None = None) -> DataFrame:
    """capture_id, bucket, one DOUBLE column per series: sums over buckets of interval seconds since the first frame in
    capture order; all buckets up to the last frame's (at most MOST_BUCKETS) have a row. Frames before the start or past the
    last bucket do not count. unit: packets, bytes or bits (per second). times: the same frames' capture_id, number and ts_ns,
    from a cheaper source than frames."""
    step = max(interval, 1e-6)
    span = (frames if times is None else times).groupBy("capture_id").agg(F.min_by("ts_ns", "number").alias("start"), F.max_by("ts_ns", "number").alias("stop"))
    at = lambda t: F.floor(((F.col(t) - F.col("start")) / 1e9) / step)
    span = span.where("start is not null").withColumn("n", F.least(F.greatest(at("stop"), F.lit(0)) + 1, F.lit(MOST_BUCKETS)))
    value = {"packets": F.lit(1.0), "bytes": F.col("orig_len").cast("double"), "bits": F.col("orig_len") * 8 / step}[unit]
    b = frames.join(span, "capture_id").withColumn("bucket", at("ts_ns")).where("bucket >= 0 and bucket < n")
    sums = b.groupBy("capture_id", "bucket").agg(*(F.sum(F.when(p, value).otherwise(0.0)).alias(name) for name, p in series))
    grid = span.select("capture_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("bucket"))
    return grid.join(sums, ["capture_id", "bucket"], "left").fillna(0.0, [name for name, _ in series])


def io_graph_of(raw: DataFrame, series: Sequence[tuple[str, str]] = SERIES, interval: float = 1.0, unit: str = "packets") -> tuple[DataFrame, dict[str, str]]:
    """io_graph() of raw frames for named filters, and the errors of those that do not compile; these count nothing."""
    columns = [f"s{i}" for i in range(len(series))]
    f, errors = evaluated(raw, [(c, text) for c, (_, text) in zip(columns, series)])
    g = io_graph(f.select("capture_id", "number", "ts_ns", "orig_len", *columns), [(name, F.col(c)) for c, (name, _) in zip(columns, series)], interval, unit, raw)
    return g, {series[int(c[1:])][0]: e for c, e in errors.items()}


_NOT_FINDINGS = ("tcp.analysis.bytes_in_flight", "tcp.analysis.duplicate_ack_num", "tcp.analysis.duplicate_ack_frame")


def finding_records(frames: DataFrame) -> DataFrame:
    """capture_id, number, idx, field, severity, grp, summary: each finding with the expert record that follows it."""
    is_finding = lambda n: (n["field"].startswith("tcp.analysis.") & ~n["field"].isin(*_NOT_FINDINGS)) | n["field"].isin("_ws.checksum.bad", "_ws.malformed")
    x = frames.select("capture_id", "number", "nodes", F.explode(F.filter("nodes", is_finding)).alias("n"))
    after = lambda k: F.get(F.col("nodes"), F.col("n.idx") + k)
    has = after(1)["field"] == "_ws.expert"
    return x.select("capture_id", "number", F.col("n.idx").alias("idx"), F.col("n.field").alias("field"), F.when(has, after(2)["u"]).alias("severity"), F.when(has, after(3)["u"]).alias("grp"), F.coalesce(F.when(has, after(1)["text"]), F.col("n.text")).alias("summary"))


def findings(records: DataFrame) -> DataFrame:
    """field, summary, severity and grp of the first record, count, frames (the first SAMPLE numbers).

    One pass: each block of frame numbers keeps its first numbers, a thousand blocks theirs, and those of all meet, so no
    task sorts or holds all records of a finding."""
    key = ["capture_id", "field", "summary"]
    r = records.withColumn("block", F.expr(f"number div {BLOCK}"))
    w = Window.partitionBy(*key, "block").orderBy("number", "idx")
    r = r.withColumn("r", F.row_number().over(w))
    r = r.groupBy(*key, "block").agg(F.min(F.struct("number", "idx", "severity", "grp")).alias("s"), F.count("*").alias("count"), F.collect_list(F.when(F.col("r") <= SAMPLE, F.col("number"))).alias("frames"))
    for part in (F.expr("block div 1024"), F.lit(0)):
        r = r.withColumn("block", part).groupBy(*key, "block").agg(F.min("s").alias("s"), F.sum("count").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("frames"))), 1, SAMPLE).alias("frames"))
    return r.select(*key, "s.severity", "s.grp", "count", "frames")


def findings_of(raw: DataFrame) -> DataFrame:
    """findings() of dissect(raw), without trees of the frames whose headers tell their findings."""
    key = ["capture_id", "field", "summary"]
    r = expert.totals(raw).withColumn("s", F.struct("first", "severity", "grp"))
    for part in (F.pmod("first", F.lit(64)), F.lit(0)):
        r = r.groupBy(*key, part.alias("part")).agg(F.min("s").alias("s"), F.sum("count").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("frames"))), 1, SAMPLE).alias("frames")).withColumn("first", F.col("s.first"))
    return r.select(*key, "s.severity", "s.grp", "count", "frames")


def finding_filter(field: str) -> str:
    """The display filter that selects every frame with a finding."""
    return field


def findings_order(f: DataFrame) -> DataFrame:
    return f.orderBy(F.desc("severity"), F.desc("count"), "field")


def severity_counts(records: DataFrame, least: int = 1) -> DataFrame:
    """capture_id, errors, warnings, notes, chats; severities below `least` are left out."""
    n = lambda v: F.sum(F.when(F.col("severity") == v, 1).otherwise(0))
    return records.where(F.col("severity") >= least).groupBy("capture_id").agg(n(4).alias("errors"), n(3).alias("warnings"), n(2).alias("notes"), n(1).alias("chats"))


def severity_counts_of(raw: DataFrame, least: int = 1) -> DataFrame:
    """severity_counts() of dissect(raw), as findings_of()."""
    n = lambda v: F.sum(F.when(F.col("severity") == v, F.col("count")).otherwise(0))
    return expert.totals(raw).where(F.col("severity") >= least).groupBy("capture_id").agg(n(4).alias("errors"), n(3).alias("warnings"), n(2).alias("notes"), n(1).alias("chats"))


def colour(rules: Sequence[tuple[str, str]] = COLOURS, build=compile_filter) -> Column:
    """The first rule whose filter selects the frame, null if none does; rules that do not compile claim nothing."""
    pairs, _ = series_predicates(rules, build)
    whens = [(name, p) for name, p in pairs]
    return reduce(lambda acc, x: F.when(x[1], F.lit(x[0])).otherwise(acc), reversed(whens), F.lit(None).cast("string"))


def coloured(raw: DataFrame, rules: Sequence[tuple[str, str]] = COLOURS) -> DataFrame:
    """capture_id, number, rule: the first rule whose filter selects the frame, whatever the filter asks for; null if none does."""
    columns = [f"r{i}" for i in range(len(rules))]
    f, _ = evaluated(raw, [(c, text) for c, (_, text) in zip(columns, rules)])
    rule = reduce(lambda acc, x: F.when(F.col(x[0]), F.lit(x[1][0])).otherwise(acc), reversed(list(zip(columns, rules))), F.lit(None).cast("string"))
    return f.select("capture_id", "number", rule.alias("rule"))


def with_times(frames: DataFrame) -> DataFrame:
    """Adds since_start_ns (from the capture's first frame) and delta_ns (from the frame before, in the rows as they are: of
    displayed frames the one displayed before). Blocks of frames hand their last time on; no window spans a capture."""
    f = frames.withColumn("__block", F.expr(f"number div {BLOCK}"))
    ends = f.groupBy("capture_id", "__block").agg(F.max_by("ts_ns", "number").alias("end"), F.min_by("ts_ns", "number").alias("begin"))
    w = Window.partitionBy("capture_id").orderBy("__block")
    ends = ends.select("capture_id", "__block", F.lag("end").over(w).alias("__before"), F.first("begin").over(w).alias("__start"))
    f = f.join(ends, ["capture_id", "__block"])
    before = F.coalesce(F.lag("ts_ns").over(Window.partitionBy("capture_id", "__block").orderBy("number")), F.col("__before"))
    return f.withColumns({"since_start_ns": F.col("ts_ns") - F.col("__start"), "delta_ns": F.coalesce(F.col("ts_ns") - before, F.lit(0))}).drop("__block", "__before", "__start")


def time_text(ns: Column) -> Column:
    """Seconds with six digits, truncated; a minus sign in front of negative times."""
    us = F.call_function("div", F.abs(ns), F.lit(1000))
    return F.concat(F.when(ns < 0, "-").otherwise(""), F.call_function("div", us, F.lit(1_000_000)).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def utc_text(ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _chunks(frames: DataFrame, most_frames: int, most_bytes: int) -> DataFrame:
    """capture_id, __chunk, n, size, next, kept: chunks of frame numbers, and whether a bounded store still holds them."""
    c = frames.withColumn("__chunk", F.expr(f"(number - 1) div {CHUNK_FRAMES}")).groupBy("capture_id", "__chunk").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size"), (F.max("number") + 1).alias("next"))
    w = Window.partitionBy("capture_id").orderBy(F.desc("__chunk"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum("n").over(upto) <= most_frames) & (F.sum("size").over(upto) <= most_bytes)
    return c.withColumn("kept", (F.row_number().over(w) == 1) | fits)


def ring(frames: DataFrame, most_frames: int = RING_FRAMES, most_bytes: int = RING_BYTES) -> DataFrame:
    """The frames a bounded store still holds: whole chunks are dropped from the front until both limits hold; the last
    chunk stays. Numbers are contiguous from 1."""
    kept = _chunks(frames, most_frames, most_bytes).where("kept").select("capture_id", "__chunk")
    f = frames.withColumn("__chunk", F.expr(f"(number - 1) div {CHUNK_FRAMES}"))
    return f.join(kept, ["capture_id", "__chunk"], "left_semi").drop("__chunk")


def ring_stats(frames: DataFrame, most_frames: int = RING_FRAMES, most_bytes: int = RING_BYTES) -> DataFrame:
    """capture_id, frames, bytes (held by the bounded store), evicted_frames, evicted_bytes, next_number."""
    n = lambda c, kept: F.coalesce(F.sum(F.when(F.col("kept") == kept, F.col(c))), F.lit(0).cast("bigint"))
    return _chunks(frames, most_frames, most_bytes).groupBy("capture_id").agg(n("n", True).alias("frames"), n("size", True).alias("bytes"), n("n", False).alias("evicted_frames"), n("size", False).alias("evicted_bytes"), F.max("next").alias("next_number"))


def store_stats(frames: DataFrame) -> DataFrame:
    return frames.groupBy("capture_id").agg(F.count("*").alias("frames"), F.sum(F.length("bytes")).alias("bytes"), (F.max("number") + 1).alias("next_number"))


def find(hits: DataFrame, start: int, forward: bool = True) -> DataFrame:
    """capture_id, number: the next of the matching frames after (or before) `start`, going on at the other end."""
    n = F.col("number")
    if forward:
        best = F.coalesce(F.min(F.when(n > start, n)), F.min(n))
    else:
        best = F.coalesce(F.max(F.when(n < start, n)), F.max(n))
    return hits.groupBy("capture_id").agg(best.alias("number"))


SCOPES = ("list", "details", "bytes")


def _found(frames: DataFrame, needle: bytes, scope: str, fold: bool, text: bool) -> DataFrame:
    """Frames that hold the needle in the packet list, in the tree's lines or in their bytes."""
    if scope not in SCOPES:
        raise ValueError(f"a search is in one of {SCOPES}")
    if scope == "bytes":
        return frames.where(F.exists("sources", lambda s: F.contains(s, F.lit(needle))))
    low = (lambda c: F.lower(c)) if fold else (lambda c: c)
    if scope == "list":
        columns = [addr_text(F.col("src")), addr_text(F.col("dst")), F.col("protocol"), F.col("info")] if text else [F.col("info")]
        return frames.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.encode(low(c), "UTF-8"), F.lit(needle)), F.lit(False)) for c in columns)))
    return labels.with_lines(frames).where(F.exists("__lines", lambda x: F.contains(F.encode(low(x), "UTF-8"), F.lit(needle)))).drop("__lines")


def find_text(frames: DataFrame, text: str, scope: str = "list", fold: bool = True) -> DataFrame:
    """Frames that hold a text in one of the packet list's columns source, destination, protocol and info (`list`), in a line
    of their tree (`details`), or as its own UTF-8 bytes in theirs (`bytes`, where case counts). fold: case does not count."""
    fold = fold and scope != "bytes"
    return _found(frames, (text.lower() if fold else text).encode(), scope, fold, True)


def hex_needle(text: str) -> bytes:
    """Bytes of a search text; colons, dashes and white space between digits do not count."""
    digits = "".join(c for c in text if c not in ":- \t")
    if not digits or len(digits) % 2:
        raise ValueError("a search for bytes takes an even number of hexadecimal digits")
    return bytes.fromhex(digits)


def find_bytes(frames: DataFrame, needle: bytes, scope: str = "bytes") -> DataFrame:
    """Frames that hold bytes in their own bytes, in the packet list's info (`list`) or in a line of their tree (`details`)."""
    return _found(frames, needle, scope, False, False)


def exported(frames: DataFrame, what: str = "all", predicate: Column | None = None, number: int | None = None, marks: DataFrame | None = None, capture: str | None = None) -> DataFrame:
    """The frames of an export set: all, displayed (by predicate), selected (one number of a capture) or marked (capture_id and
    number in marks). A number alone selects nothing sure where there are several captures: capture then names one."""
    if what == "displayed":
        return frames.where(predicate)
    if what == "selected":
        one = F.col("number") == number
        return frames.where(one if capture is None else one & (F.col("capture_id") == capture))
    if what == "marked":
        return frames.join(marks.select("capture_id", "number").distinct(), ["capture_id", "number"], "left_semi")
    return frames


SEQUENCE_BLOCK = 1 << 20  # bytes of sequence space swept by one task


def follow(segments: DataFrame) -> DataFrame:
    """The bytes of streams in order. segments: capture_id, stream_id, side, number, seq, payload (BINARY).

    capture_id, stream_id, side, number, gap, bytes: what each segment adds; bytes seen before are dropped, the first seen
    win, and gap counts the bytes missing before it. Sequence numbers count from each side's first segment. Segments without
    seq (UDP) have no order but that of their numbers: each adds its whole payload and misses nothing. Empty payloads add
    nothing. A side of any length goes by blocks of sequence space, each of which knows how far the blocks before it reach.
    """
    side = ["capture_id", "stream_id", "side"]
    s = segments.where(F.length("payload") > 0).select(*side, "number", "seq", "payload")
    plain = s.where("seq is null").select(*side, "number", F.lit(0).cast("bigint").alias("gap"), F.col("payload").alias("bytes"))
    s = s.where("seq is not null")
    first = s.groupBy(*side).agg(F.min_by("seq", "number").alias("seq0"))
    half, wrap = F.lit(2**31), F.lit(2**32)
    s = s.join(first, side).withColumn("at", F.pmod(F.col("seq") - F.col("seq0") + half, wrap) - half)
    s = s.withColumn("end", F.col("at") + F.length("payload")).withColumn("block", F.shiftright("at", SEQUENCE_BLOCK.bit_length() - 1))
    reach = s.groupBy(*side, "block").agg(F.max("end").alias("reach"))
    reach = reach.select(*side, "block", F.max("reach").over(Window.partitionBy(*side).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy(*side, "block").orderBy("at", "number").rowsBetween(Window.unboundedPreceding, -1)
    s = s.join(reach, [*side, "block"]).withColumn("done", F.coalesce(F.greatest(F.max("end").over(w), "before"), F.col("at"))).where("end > done")
    skip = F.greatest(F.col("done") - F.col("at"), F.lit(0))
    new = s.select(*side, "number", F.greatest(F.col("at") - F.col("done"), F.lit(0)).alias("gap"), F.substring("payload", (skip + 1).cast("int"), F.lit(2**31 - 1)).alias("bytes"))
    return new.unionByName(plain)


def payloads(frames: DataFrame) -> DataFrame:
    """Segments for follow() from dissected frames: each frame's outermost transport payload."""
    pick = lambda name: F.get(F.filter("nodes", lambda n: n["field"] == name), F.lit(0))
    p = F.coalesce(pick("tcp.payload"), pick("udp.payload"))
    return frames.where(p.isNotNull()).select("capture_id", "stream_id", F.struct("src", F.coalesce(pick("tcp.srcport"), pick("udp.srcport"))["u"].alias("port")).alias("side"), "number", pick("tcp.seq")["u"].alias("seq"), F.substring(F.get("sources", p["source"]), p["start"] + 1, p["end"] - p["start"]).alias("payload"))


def transcript(segments: DataFrame) -> DataFrame:
    """follow() with direction: 0 for the side that sent the stream's first payload, 1 for the other."""
    first = segments.where(F.length("payload") > 0).groupBy("capture_id", "stream_id").agg(F.min_by("side", "number").alias("__first"))
    out = follow(segments).join(first, ["capture_id", "stream_id"])
    return out.withColumn("direction", (F.col("side") != F.col("__first")).cast("int")).drop("__first")


def transcript_order(t: DataFrame) -> DataFrame:
    """Both directions, interleaved by the frames that their runs come from."""
    return t.orderBy("capture_id", "stream_id", "number")


def transcript_totals(segments: DataFrame, t: DataFrame) -> DataFrame:
    """capture_id, stream_id, direction, frames and payload (as captured), bytes (as put together), missing."""
    got = t.groupBy("capture_id", "stream_id", "side", "direction").agg(F.sum(F.length("bytes")).cast("bigint").alias("bytes"), F.sum("gap").cast("bigint").alias("missing"))
    seen = segments.where(F.length("payload") > 0).groupBy("capture_id", "stream_id", "side").agg(F.count("*").alias("frames"), F.sum(F.length("payload")).cast("bigint").alias("payload"))
    return seen.join(got, ["capture_id", "stream_id", "side"]).drop("side")


def renumbered(frames: DataFrame, order: str = "number") -> DataFrame:
    """Numbers 1, 2, ... per capture in the given order, without gaps; counts per block, then ranks within blocks."""
    f = frames.withColumn("__block", F.expr(f"{order} div {BLOCK}"))
    n = f.groupBy("capture_id", "__block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("capture_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("capture_id", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("capture_id", "__block").orderBy(order))
    return f.withColumn("__rank", rank).join(n, ["capture_id", "__block"]).withColumn("number", F.col("__base") + F.col("__rank")).drop("__block", "__base", "__rank")


def row_at_or_after(frames: DataFrame, number: int) -> DataFrame:
    """capture_id, number of the first frame with at least this number."""
    return frames.where(F.col("number") >= number).groupBy("capture_id").agg(F.min("number").alias("number"))


def capture_counters(described: DataFrame) -> DataFrame:
    """capture_id, received, dropped (by the capture and by the system) over the interfaces of capture files."""
    i = described.select("capture_id", F.explode("interfaces").alias("i"))
    n = lambda c: F.coalesce(F.sum(f"i.{c}"), F.lit(0))
    return i.groupBy("capture_id").agg(n("received").alias("received"), n("dropped").alias("dropped"), n("os_dropped").alias("os_dropped"))
