"""Dissection of frames as a Spark job.

State is kept per flow, never per capture: fragments meet by datagram, frames by stream, each sorted by frame number and
swept with the state of one group at a time, so a group of any size needs bounded memory. Streams are numbered in the
order of their first frames by counts per block of frame numbers.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.dissect import flow, layers
from tidewire.dissect.headers import be, header_type, headers, read
from tidewire.dissect.layers import Options
from tidewire.dissect.tree import COLUMNS

RAW = ("capture_id", "number", "link_type", "ts_ns", "orig_len", "bytes")
NODE = "struct<idx:int,field:string,depth:int,source:int,start:int,end:int,u:bigint,b:boolean,s:string,a:binary,text:string>"
FRAME = f"capture_id string, number bigint, link_type int, ts_ns bigint, orig_len bigint, bytes binary, stream_id bigint, sources array<binary>, nodes array<{NODE}>, protocols array<string>, src binary, dst binary, protocol string, info string, expert struct<severity:int,grp:int,summary:string>"
BLOCK_FRAMES = 1 << 20
BATCH_FRAMES = 2000


def as_raw(df: DataFrame, capture: str = "fixture") -> DataFrame:
    """RAW columns of a table of frames; repetitions of a frame count once, and of rows that differ under one number the
    smallest (time, link type, length, bytes) counts. Null bytes are empty, a null number 0."""
    raw = df.select(F.col(capture).alias("capture_id"), "number", F.struct("ts_ns", "link_type", "orig_len", "bytes").alias("f"))
    raw = raw.groupBy("capture_id", "number").agg(F.min("f").alias("f"))
    return raw.select("capture_id", "number", "f.link_type", "f.ts_ns", "f.orig_len", "f.bytes")


def _node_array(trees: list, keep: frozenset[str] | None) -> pa.Array:
    """The trees' nodes; of those in keep only, if it is given."""
    if keep is None:
        sizes, flat = [len(t.field) for t in trees], {c: [v for t in trees for v in getattr(t, c)] for c in COLUMNS}
        at = [np.arange(n, dtype=np.int32) for n in sizes]
    else:
        at = [[i for i, f in enumerate(t.field) if f in keep] for t in trees]
        sizes, flat = [len(i) for i in at], {c: [getattr(t, c)[i] for t, own in zip(trees, at) for i in own] for c in COLUMNS}
    kinds = {"field": pa.string(), "depth": pa.int32(), "source": pa.int32(), "start": pa.int32(), "end": pa.int32(), "u": pa.int64(), "b": pa.bool_(), "s": pa.string(), "a": pa.binary(), "text": pa.string()}
    try:
        numbers = pa.array(flat["u"], pa.int64())
    except (OverflowError, pa.ArrowInvalid):  # numbers of the upper half are stored as negative ones
        numbers = pa.array([v if v is None or v < 1 << 63 else v - (1 << 64) for v in flat["u"]], pa.int64())
    idx = np.concatenate([np.asarray(i, np.int32) for i in at]) if at else np.zeros(0, np.int32)
    cols = [pa.array(idx), *(numbers if c == "u" else pa.array(flat[c], kinds[c]) for c in COLUMNS)]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays(cols, names=["idx", *COLUMNS]))


def _emit(rows: list[tuple], made: list[layers.Context], ids: list[int | None], keep: frozenset[str] | None) -> pa.RecordBatch:
    experts = [None if x.expert is None else {"severity": x.expert[0], "grp": x.expert[1], "summary": x.expert[2]} for x in made]
    cols = [
        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.binary()),
        pa.array(ids, pa.int64()), pa.array([[r[5] or b"", *x.sources] for r, x in zip(rows, made)], pa.list_(pa.binary())), _node_array([x.tree for x in made], keep), pa.array([x.protocols for x in made], pa.list_(pa.string())),
        pa.array([x.src for x in made], pa.binary()), pa.array([x.dst for x in made], pa.binary()), pa.array([x.protocol for x in made]), pa.array([x.info for x in made]), pa.array(experts, pa.struct([("severity", pa.int32()), ("grp", pa.int32()), ("summary", pa.string())])),
    ]
    names = ["capture_id", "number", "link_type", "ts_ns", "orig_len", "bytes", "stream_id", "sources", "nodes", "protocols", "src", "dst", "protocol", "info", "expert"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _link(v: int | None) -> int:
    return -1 if v is None else v


def dissect_stateless(raw: DataFrame, options: Options = Options(), keep: Iterable[str] | None = None) -> DataFrame:
    """FRAME rows without what needs other frames: stream ids, sequence analysis, messages that span segments. Reassembled
    datagrams are there if raw has the column `whole`. keep: the fields wanted as nodes, all by default."""
    keep = None if keep is None else frozenset(keep)
    columns = [*RAW, "whole"] if "whole" in raw.columns else list(RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees hold no cycles
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_FRAMES):
                rows = list(_rows(whole.slice(at, BATCH_FRAMES)))
                made = [layers.frame(r[5] or b"", _link(r[2]), r[1] or 0, r[3] or 0, r[4] or 0, options, whole=_whole(r[6]) if len(r) > 6 else None) for r in rows]
                yield _emit(rows, made, [None] * len(rows), keep)

    return raw.select(*columns).mapInArrow(run, FRAME)


def _whole(v: dict | None) -> tuple | None:
    return None if v is None else (v["state"], v["value"] if v["state"] == "whole" else v["why"], [(p["frame"], p["at"], p["size"]) for p in v["parts"] or []])


WHOLE = "struct<state:string,value:binary,why:string,parts:array<struct<frame:bigint,at:int,size:int>>>"
FLOW = "src_end struct<addr:binary,v6:boolean,port:bigint>, dst_end struct<addr:binary,v6:boolean,port:bigint>, flow_proto bigint, fresh boolean, net_src binary, net_dst binary"


def _ends(x: layers.Context) -> tuple:
    """Stream ends, protocol and freshness of a dissected frame, from its TCP or UDP nodes and the addresses above them."""
    t = x.tree
    for p, number in (("tcp", 6), ("udp", 17)):
        if f"{p}.dstport" in t.field:
            i = t.field.index(p)
            net = next((n for n in range(i, -1, -1) if t.field[n] in ("ip.dst", "ipv6.dst")), None)
            if net is None:
                break
            v6 = t.field[net] == "ipv6.dst"
            flags = t.u[t.field.index("tcp.flags")] if "tcp.flags" in t.field else 0
            ends = [{"addr": t.a[n] if v6 else t.a[n] + bytes(12), "v6": v6, "port": t.u[t.field.index(f"{p}.{side}port")]} for n, side in ((net - 1, "src"), (net, "dst"))]
            return *ends, number, p == "tcp" and flags & 0x12 == 2
    return None, None, None, None


def _flow(x: layers.Context) -> tuple:
    """FLOW of a dissected frame: net_src and net_dst are its outermost addresses."""
    ends, t = _ends(x), x.tree
    if ends[0] is None:
        return *ends, None, None
    outer = t.field.index("ip.dst" if "ip.dst" in t.field else "ipv6.dst")
    return *ends, t.a[outer - 1], t.a[outer]


_PART = pa.struct([("frame", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
_END = pa.struct([("addr", pa.binary()), ("v6", pa.bool_()), ("port", pa.int64())])
_FLOW_KINDS = (_END, _END, pa.int64(), pa.bool_(), pa.binary(), pa.binary())
FLOW_COLUMNS = ("src_end", "dst_end", "flow_proto", "fresh", "net_src", "net_dst")
_FRAGMENT = ("deep", "fragment", "ip_src", "ip_dst", "ip_id", "ip_proto", "ip_frag", "l3", "head", "l4_end")


def reassembled(flat: DataFrame) -> DataFrame:
    """RAW, whole and FLOW of the IPv4 fragments among the rows of headers(). Fragments meet their datagram, in order of
    number; whole is what reassembly says of each: STRUCT<state (whole, part, bad), value, why, parts>."""
    key = F.concat("ip_src", "ip_dst", be(F.col("ip_id"), 2), be(F.col("ip_proto"), 1))
    payload = F.expr("substring(bytes, cast(l3 + head + 1 as int), cast(greatest(l4_end - l3 - head, 0) as int))")
    f = flat.where("fragment").select(*RAW, key.alias("__key"), F.col("ip_frag").alias("__frag"), payload.alias("__payload"))
    f = f.repartition("capture_id", "__key").sortWithinPartitions("capture_id", "__key", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.struct([("state", pa.string()), ("value", pa.binary()), ("why", pa.string()), ("parts", pa.list_(_PART))]), *_FLOW_KINDS)
        at, state = None, flow.Fragments()
        for batch in batches:
            out = []
            for capture, number, link, ts, orig, raw, key, frag, payload in _rows(batch):
                if (capture, key) != at:
                    at, state = (capture, key), flow.Fragments()
                whole = state.add((frag & 0x1FFF) * 8, bool(frag & 0x2000), payload or b"", number or 0, ts or 0)
                kind, value, parts = whole
                # until the datagram is whole, no transport header can be read
                ends = _flow(layers.frame(raw or b"", _link(link), number or 0, ts or 0, orig or 0, whole=whole)) if kind == "whole" else (None,) * 6
                told = {"state": kind, "value": value if kind == "whole" else None, "why": value if kind == "bad" else None, "parts": [dict(zip(("frame", "at", "size"), p)) for p in parts] if kind == "whole" else []}
                out.append((told, *ends))
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(RAW)], *cols], names=[*RAW, "whole", *FLOW_COLUMNS])

    return f.mapInArrow(run, f"capture_id string, number bigint, link_type int, ts_ns bigint, orig_len bigint, bytes binary, whole {WHOLE}, {FLOW}")


def with_wholes(raw: DataFrame) -> DataFrame:
    """RAW and whole: what reassembly says of each IPv4 fragment, null for other frames."""
    flat = headers(raw.select(*RAW), _FRAGMENT)
    plain = flat.where(~F.col("fragment")).select(*RAW, F.lit(None).cast(WHOLE).alias("whole"))
    return plain.unionByName(reassembled(flat).select(*RAW, "whole"))


def deep_frames(flat: DataFrame) -> DataFrame:
    """RAW and whole of the frames that headers() cannot tell all of: fragments with their datagram, and nested headers."""
    nested = flat.where(F.col("deep") & ~F.col("fragment")).select(*RAW, F.lit(None).cast(WHOLE).alias("whole"))
    return nested.unionByName(reassembled(flat).select(*RAW, "whole"))


_PLAIN = ("deep", "fragment", "ip_src", "ip_dst", "ip6_src", "ip6_dst", "proto", "tcp_src", "tcp_dst", "udp_src", "udp_dst", "tcp_syn", "tcp_ackf")


def _with_headers(raw: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep (of RAW), header columns and FLOW of raw in one pass; FLOW is null but for nested headers, which are dissected."""
    at, link_at = RAW.index("bytes"), RAW.index("link_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = b.column(link_at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            got = read(b.column(at), link, set(_PLAIN))
            nested = np.flatnonzero(got["deep"].to_numpy(zero_copy_only=False) & ~got["fragment"].to_numpy(zero_copy_only=False))
            flows: list[list] = [[None] * b.num_rows for _ in FLOW_COLUMNS]
            if len(nested):
                for i, (_, number, link_type, ts, orig, raw_) in zip(nested.tolist(), _rows(b.take(pa.array(nested)))):
                    for column, v in zip(flows, _flow(layers.frame(raw_ or b"", _link(link_type), number or 0, ts or 0, orig or 0))):
                        column[i] = v
            yield pa.RecordBatch.from_arrays([*(b.column(RAW.index(c)) for c in keep), *(got[c] for c in _PLAIN), *(pa.array(v, k) for v, k in zip(flows, _FLOW_KINDS))], names=[*keep, *_PLAIN, *FLOW_COLUMNS])

    kinds = {f.name: f for f in raw.select(*RAW).schema.fields}
    end = T.StructType([T.StructField("addr", T.BinaryType()), T.StructField("v6", T.BooleanType()), T.StructField("port", T.LongType())])
    flow_types = (end, end, T.LongType(), T.BooleanType(), T.BinaryType(), T.BinaryType())
    return raw.select(*RAW).mapInArrow(run, T.StructType([*(kinds[c] for c in keep), *(T.StructField(c, header_type(c)) for c in _PLAIN), *map(T.StructField, FLOW_COLUMNS, flow_types)]))


def with_flows(raw: DataFrame, keep: tuple[str, ...] = RAW) -> DataFrame:
    """keep (of RAW), whole (of fragments), src_end, dst_end, flow_proto, fresh: the stream endpoints of each frame, as the
    frame's sender saw them; of an ICMP error those it quotes. net_src, net_dst: the frame's own addresses, of an ICMP error
    not the quoted ones. Null where there is no TCP or UDP header under an IP header. One pass over the frames, and one that
    looks for fragments only, which meet their datagram."""
    flat = _with_headers(raw, keep)
    pad = lambda v4, v6: F.coalesce(F.concat(F.col(v4), F.lit(bytes(12))), F.col(v6))
    end = lambda side: F.struct(pad(f"ip_{side}", f"ip6_{side}").alias("addr"), F.col(f"ip6_{side}").isNotNull().alias("v6"), F.coalesce(f"tcp_{side}", f"udp_{side}").alias("port"))
    has = F.coalesce("tcp_src", "udp_src").isNotNull()
    simple = {"src_end": F.when(has, end("src")), "dst_end": F.when(has, end("dst")), "flow_proto": F.when(has, F.col("proto")), "fresh": F.coalesce(F.col("tcp_syn") & ~F.col("tcp_ackf"), F.lit(False))}
    simple |= {f"net_{side}": F.when(has, F.coalesce(f"ip_{side}", f"ip6_{side}")) for side in ("src", "dst")}
    one = flat.where(~F.col("fragment")).select(*keep, F.lit(None).cast(WHOLE).alias("whole"), *(F.when(F.col("deep"), F.col(c)).otherwise(simple[c]).alias(c) for c in FLOW_COLUMNS))
    parts = reassembled(headers(raw.select(*RAW), _FRAGMENT)).select(*keep, "whole", *FLOW_COLUMNS)
    return one.unionByName(parts)


def _keyed(flows: DataFrame) -> DataFrame:
    has = F.col("src_end").isNotNull()
    return flows.withColumns({"lo": F.when(has, F.least("src_end", "dst_end")), "hi": F.when(has, F.greatest("src_end", "dst_end"))})


KEY = ("capture_id", "lo", "hi", "flow_proto")


def streams(keyed: DataFrame) -> DataFrame:
    """KEY, first_number, stream_id of every stream: one count per capture for TCP and UDP, by first frame. keyed: KEY, number,
    fresh. A key's first frame begins a stream, and so does each SYN without ACK after it; neither needs the frames of a key
    together, so a key of any number of frames is spread evenly."""
    k = keyed.where("lo is not null").select(*KEY, "number", "fresh")
    # fresh frames are kept as they are, the others only by their key's first
    begins = k.groupBy(*KEY, F.when(F.col("fresh"), F.col("number")).alias("at")).agg(F.min("number").alias("first_number"))
    first = F.min("first_number").over(Window.partitionBy(*KEY))
    begins = begins.withColumn("first", first).where((F.col("at").isNotNull()) | (F.col("first_number") == F.col("first"))).select(*KEY, "first_number")
    return _numbered(begins, KEY[1:])


def _numbered(begins: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """Adds stream_id: the rank of first_number in its capture, by counts per block of frame numbers."""
    s = begins.withColumn("block", F.expr(f"first_number div {BLOCK_FRAMES}"))
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("capture_id", "block").orderBy("first_number", *ties)))
    top = s.groupBy("capture_id", "block").agg(F.max("r").alias("n"))
    before = Window.partitionBy("capture_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = top.select("capture_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return s.join(base, ["capture_id", "block"]).select(*begins.columns, (F.col("base") + F.col("r") - 1).alias("stream_id"))


def with_streams(flows: DataFrame) -> DataFrame:
    """Adds lo, hi and stream_id, as streams() numbers them, for flows without bytes: their rows are shuffled by key once, for
    the streams and for the frames, and again by key and stream."""
    f = _keyed(flows)
    w = Window.partitionBy(*KEY).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    known = f.where("lo is not null").withColumn("__seen", F.count("*").over(w))
    known = known.withColumn("__gen", F.sum(F.when(F.col("fresh") & (F.col("__seen") > 1), 1).otherwise(0)).over(w)).drop("__seen")
    s = _numbered(known.groupBy(*KEY, "__gen").agg(F.min("number").alias("first_number")), (*KEY[1:], "__gen"))
    got = known.join(s.drop("first_number"), [*KEY, "__gen"]).select(*f.columns, "stream_id")
    return got.unionByName(f.where("lo is null").withColumn("stream_id", F.lit(None).cast("bigint")))


def dissect(raw: DataFrame, options: Options = Options(), keep: Iterable[str] | None = None) -> DataFrame:
    """FRAME rows, complete: with stream ids, sequence analysis, reassembled datagrams and messages that span segments.

    raw: RAW columns, one row per frame; number orders the frames of a capture. Null or empty bytes give a frame without
    layers, a null link type is unknown data. No order is promised; sort by number where it matters. keep: the fields wanted
    as nodes, all by default.
    """
    keep = None if keep is None else frozenset(keep)
    f = _keyed(with_flows(raw)).select(*RAW, "whole", "lo", "hi", "flow_proto", F.lit(None).cast("bigint").alias("__begun"))
    begun = streams(_keyed(with_flows(raw, ("capture_id", "number")))).select(*KEY, F.col("first_number").alias("number"), F.col("stream_id").alias("__begun"))
    # a stream's row comes before its first frame: the bytes are shuffled once, to the task that sweeps their key
    spread = F.when(F.col("lo").isNull(), F.pmod(F.xxhash64("number"), F.lit(4096)))
    f = f.unionByName(begun, allowMissingColumns=True).withColumn("__spread", spread)
    at = ["capture_id", "lo", "hi", "flow_proto", "__spread"]
    f = f.repartition(*at).sortWithinPartitions(*at, "number", F.desc_nulls_last("__begun"))
    f = f.select(*RAW, "whole", "__begun", F.col("lo").isNotNull().alias("__flow"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees hold no cycles
        begun, state = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_FRAMES):
                rows, made, ids = [], [], []
                for r in _rows(whole.slice(lo, BATCH_FRAMES)):
                    if r[7] is not None:
                        begun, state = r[7], flow.Stream()
                        continue
                    stream_id = begun if r[8] else None
                    rows.append(r)
                    made.append(layers.frame(r[5] or b"", _link(r[2]), r[1] or 0, r[3] or 0, r[4] or 0, options, state if r[8] else None, stream_id, _whole(r[6])))
                    ids.append(stream_id)
                if rows:
                    yield _emit(rows, made, ids, keep)

    return f.mapInArrow(run, FRAME)


def fields(frames: DataFrame) -> DataFrame:
    """One row per node: capture_id, number and the node's columns."""
    return frames.select("capture_id", "number", F.explode("nodes").alias("n")).select("capture_id", "number", "n.*")
