"""Generated traffic: n frames of TCP over IPv4 in 64 flows, a millisecond apart, with right checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewire.dissect.layers import ones_sum

FLOWS, MOST_PAYLOAD, START_NS = 64, 1400, 1_700_000_000 * 10**9


def _sum(b: bytes) -> bytes:
    return ones_sum(b).to_bytes(2, "little")  # ones_sum adds native words


def frame(i: int) -> bytes:
    flow, size = i % FLOWS, i % MOST_PAYLOAD
    payload = bytes((i + k) & 0xFF for k in range(size))
    src, dst = bytes([10, 0, flow // 256, flow % 256]), bytes([10, 1, 0, 1])
    tcp = (40000 + flow).to_bytes(2, "big") + (7000).to_bytes(2, "big") + (i * MOST_PAYLOAD % 2**32).to_bytes(4, "big") + bytes(4) + b"\x50\x18\x20\x00"
    segment = tcp + bytes(4) + payload
    pseudo = src + dst + b"\x00\x06" + len(segment).to_bytes(2, "big")
    segment = tcp + _sum(pseudo + segment) + bytes(2) + payload
    head = b"\x45\x00" + (20 + len(segment)).to_bytes(2, "big") + (i & 0xFFFF).to_bytes(2, "big") + b"\x40\x00\x40\x06"
    ip = head + _sum(head + bytes(2) + src + dst) + src + dst
    return b"\x02\x00\x00\x00\x00\x01\x02\x00\x00\x00\x00\x02\x08\x00" + ip + segment


def synthetic(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """RAW columns, number 1 .. n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            raw = [frame(i) for i in ids]
            sizes = pa.array(map(len, raw), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(["synthetic"] * len(ids)), pa.array([i + 1 for i in ids], pa.int64()), pa.array([1] * len(ids), pa.int32()), pa.array([START_NS + i * 1_000_000 for i in ids], pa.int64()), sizes, pa.array(raw, pa.binary())], names=["capture_id", "number", "link_type", "ts_ns", "orig_len", "bytes"])

    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.mapInArrow(run, "capture_id string, number bigint, link_type int, ts_ns bigint, orig_len bigint, bytes binary")
