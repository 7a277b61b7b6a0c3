"""Analysis of TCP segments that are already rows: the state machine of frames, without frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.dissect import flow

SEGMENT = ("capture_id", "stream", "generation", "frame", "ts_us", "side", "seq", "ack", "size", "win", "syn", "fin", "rst", "acks", "scale")
OUT = "capture_id string, stream string, generation bigint, frame bigint, finding string, severity int, in_flight bigint"


def generations(s: DataFrame, key: list[str]) -> DataFrame:
    """Adds generation: how many SYNs without ACK came on the known key before or at the row, in order of frame."""
    w = Window.partitionBy(*key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("frame")))
    return s.withColumn("generation", F.sum(F.when(F.col("syn") & ~F.col("acks") & (F.col("__n") > 1), 1).otherwise(0)).over(w)).drop("__n")


def analyse(segments: DataFrame) -> DataFrame:
    """OUT: a row per finding. segments: SEGMENT columns; stream a text that tells a capture's streams apart, ts_us null
    for no clock (counts as the stream's last time), null numbers count as 0, null flags as false.

    Segments are spread by stream, sorted by frame, and swept with the state of one stream at a time: memory does not grow
    with a stream's length."""
    s = segments.select(*SEGMENT).repartition("capture_id", "stream").sortWithinPartitions("capture_id", "stream", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, clock = None, None, 0
        for b in batches:
            out: list[tuple] = []
            for capture, stream, generation, frame, us, side, seq, ack, size, win, syn, fin, rst, acks, scale in zip(*(c.to_pylist() for c in b.columns)):
                if (capture, stream, generation) != at:
                    at, state, clock = (capture, stream, generation), flow.Stream(), us or 0
                clock = clock if us is None else us
                seen = state.observe(state.side_of(side), frame, clock * 1000, seq or 0, ack or 0, size or 0, win or 0, bool(syn), bool(fin), bool(rst), bool(acks), scale)
                out += [(*at, frame, n, flow.FINDINGS[n][0], seen.in_flight) for n in seen.names()]
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["capture_id", "stream", "generation", "frame", "finding", "severity", "in_flight"])

    return s.mapInArrow(run, OUT)
