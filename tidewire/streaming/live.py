"""Captures that keep arriving, with Structured Streaming: rotated capture files become frames, and reports keep state per flow.

Backpressure is the source's maxFilesPerTrigger; nothing is dropped. A capture's frames are taken in order of number within
a batch, and a file is one batch's, so a flow sees its frames as in one pass. Idle flows end by event time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.dissect import flow, layers, stage
from tidewire.dissect.headers import headers
from tidewire.sources.capture import from_binary

IDLE_MS = 300_000  # fixed value
FILE = "path string, modificationTime timestamp, length bigint, content binary"
ANALYSIS = "capture_id string, number bigint, sender string, generation bigint, findings array<string>, in_flight bigint, duplicate_number bigint, duplicate_frame bigint"

NUMBERS = ("sender", "seq", "ack", "size", "win", "flags", "options")
FIELDS = ("tcp.seq", "tcp.ack", "tcp.len", "tcp.window_size_value", "tcp.flags", "tcp.hdr_len")
NESTED = "capture_id string, number bigint, ts_ns bigint, sender string, peer string, seq bigint, ack bigint, size bigint, win bigint, flags bigint, options binary"
NESTED_COLUMNS = tuple(c.split()[0] for c in NESTED.split(", "))


def frames(spark: SparkSession, folder: str, files_per_batch: int = 16, one_capture: str | None = None) -> DataFrame:
    """A stream of RAW columns from a folder into which capture files are moved. Rotated files of one capture take one
    capture_id (one_capture); their numbers must then run on, so they are offset by the files' order elsewhere."""
    raw = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).load(folder)
    out = from_binary(raw)
    return out if one_capture is None else out.withColumn("capture_id", F.lit(one_capture))


def traffic(raw: DataFrame, interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """capture_id, start, packets, bytes per window of event time; frames later than the watermark are left out."""
    t = raw.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("ts", late)
    return t.groupBy("capture_id", F.window("ts", interval).alias("w")).agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes")).select("capture_id", F.col("w.start").alias("start"), "packets", "bytes")


def talkers(raw: DataFrame) -> DataFrame:
    """Packets and bytes per IP pair so far (update mode)."""
    h = headers(raw, ("ip_src", "ip_dst", "ip6_src", "ip6_dst"))
    a, b = F.coalesce("ip_src", "ip6_src"), F.coalesce("ip_dst", "ip6_dst")
    h = h.where(a.isNotNull()).select("capture_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "orig_len")
    return h.groupBy("capture_id", F.hex("a").alias("a"), F.hex("b").alias("b")).agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"))


def segments(raw: DataFrame) -> DataFrame:
    """capture_id, number, ts, ts_ns, a and b (the stream's ends as text, sorted), sender and the TCP header's numbers. TCP
    behind nested headers is dissected for it; TCP in IPv4 fragments is left out, as datagrams are not put together here."""
    every = headers(raw)
    h = every.where("not deep and tcp_hdr is not null")
    end = lambda s: F.concat_ws("/", F.hex(F.coalesce(f"ip_{s}", f"ip6_{s}")), F.lpad(F.col(f"tcp_{s}").cast("string"), 5, "0"))
    opts = F.expr("substring(bytes, cast(l4 + 21 as int), cast(greatest(tcp_hdr - 20, 0) as int))")
    plain = h.select("capture_id", "number", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), "ts_ns", F.least(end("src"), end("dst")).alias("a"), F.greatest(end("src"), end("dst")).alias("b"), end("src").alias("sender"), F.col("tcp_seq").alias("seq"), F.col("tcp_ack").alias("ack"), F.col("tcp_len").alias("size"), F.col("tcp_window").alias("win"), F.col("tcp_flags").alias("flags"), opts.alias("options"))
    deep = every.where("deep and not fragment").select(*stage.RAW).mapInArrow(_nested, NESTED)
    return plain.unionByName(deep.select("capture_id", "number", F.timestamp_micros(F.expr("ts_ns div 1000")).alias("ts"), "ts_ns", F.least("sender", "peer").alias("a"), F.greatest("sender", "peer").alias("b"), *NUMBERS))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NESTED of the frames that have a TCP header of their own, not one quoted by an ICMP error."""
    schema = pa.schema([(c, pa.binary() if c == "options" else pa.string() if c in ("capture_id", "sender", "peer") else pa.int64()) for c in NESTED_COLUMNS])
    for batch in batches:
        out = []
        for capture, number, link, ts, orig, raw in zip(*(c.to_pylist() for c in batch.columns)):
            x = layers.frame(raw or b"", -1 if link is None else link, number or 0, ts or 0, orig or 0)
            t, (src, dst, proto, _) = x.tree, stage._ends(x)
            if proto != 6 or "icmp" in t.field or not all(f in t.field for f in FIELDS):
                continue
            src, dst = (f"{e['addr'][: 16 if e['v6'] else 4].hex().upper()}/{e['port']:05}" for e in (src, dst))
            start, values = t.start[t.field.index("tcp.srcport")], [t.u[t.field.index(f)] for f in FIELDS]
            out.append((capture, number, ts, src, dst, *values[:5], raw[start + 20 : start + max(values[5], 20)]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)


def _observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    from tidewire.dissect.layers import window_scale

    if state.hasTimedOut:
        state.remove()
        return
    generation, stream = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, flow.Stream())  # noqa: S301
    known, out, last = state.exists, [], 0
    for r in pd.concat(list(batches)).sort_values("number").itertuples():
        if r.flags & 0x12 == 2 and known:
            generation, stream = generation + 1, flow.Stream()
        known, last = True, max(last, r.ts_ns // 10**6)
        syn = bool(r.flags & 2)
        seen = stream.observe(stream.side_of(r.sender), r.number, r.ts_ns, r.seq, r.ack, r.size, r.win, syn, bool(r.flags & 1), bool(r.flags & 4), bool(r.flags & 16), window_scale(bytes(r.options)) if syn else None)
        out.append((key[0], r.number, r.sender, generation, seen.names(), seen.in_flight, seen.ack_number, seen.ack_frame))
    state.update((generation, pickle.dumps(stream)))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame(out, columns=["capture_id", "number", "sender", "generation", "findings", "in_flight", "duplicate_number", "duplicate_frame"])


def analysis(raw: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Sequence analysis of TCP streams as frames arrive: a row per segment with its findings. State is one stream's two
    sides; it goes when the stream was idle for five minutes of event time."""
    s = segments(raw).withWatermark("ts", late)
    return s.groupBy("capture_id", "a", "b").applyInPandasWithState(_observe, ANALYSIS, "generation bigint, stream binary", "append", GroupStateTimeout.EventTimeTimeout)
