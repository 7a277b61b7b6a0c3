"""Queries over the segment and endpoint tables, and over captures made on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.dissect import stage
from tidewire.functions.addresses import KEY, canonical_endpoint, stream_key
from tidewire.functions.times import epoch_us
from tidewire.operators import reports, streams
from tidewire.plans.problems import _K, _SEG
from tidewire.sources.synthetic import synthetic
from tidewire.sources.tables import table


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with canonical keys; repetitions count once, and of rows that differ under one number the smallest counts."""
    t = table(spark, folder, "stream_segment")
    us = epoch_us(t, "ts")
    s = t.select(F.col("fixture").alias("capture_id"), "frame", F.when(us != 0, us).alias("ts_us"), *stream_key(F.col("lo"), F.col("hi"), F.col("proto")), "seq", "ack", F.col("payload_len").alias("size"), "win", F.coalesce("syn", F.lit(False)).alias("syn"), F.coalesce("fin", F.lit(False)).alias("fin"), F.coalesce("rst", F.lit(False)).alias("rst"), F.coalesce("ack_flag", F.lit(False)).alias("acks"), F.col("window_scale").alias("scale"), F.xxhash64(F.when(F.col("from_lo"), canonical_endpoint(F.col("lo"))).otherwise(canonical_endpoint(F.col("hi")))).alias("side"))
    rest = [c for c in s.columns if c not in ("capture_id", "frame")]
    return s.groupBy("capture_id", "frame").agg(F.min(F.struct(*rest)).alias("s")).select("capture_id", "frame", "s.*")


def _stream() -> Column:
    """128 bits that tell a stream's whole key."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.hex(c) if c.endswith("addr") else F.col(c).cast("string"), F.lit("-")) for c in KEY)).cast("binary"))


def segment_findings(spark: SparkSession, folder: str) -> DataFrame:
    """TCP findings of stream_segment: finding, severity, segments, streams. The sender is told by its canonical endpoint, as
    a stream's rows hold one address in several forms."""
    s = _segments(spark, folder).where("proto = 6")
    g = streams.generations(s, ["capture_id", *KEY])
    f = streams.analyse(g.withColumn("stream", _stream()))
    return f.groupBy("finding", "severity").agg(F.count("*").alias("segments"), F.count_distinct("capture_id", "stream", "generation").alias("streams"))


def segment_generations(spark: SparkSession, folder: str) -> DataFrame:
    """Streams per fixture and protocol: a SYN without ACK on known endpoints begins a new one."""
    g = streams.generations(_segments(spark, folder), ["capture_id", *KEY])
    return g.groupBy(F.col("capture_id").alias("fixture"), *KEY, "generation").agg(F.count("*").alias("segments")).groupBy("fixture", "proto").agg(F.count("*").alias("streams"), F.sum("segments").alias("segments"))


def segment_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Segments and payload per fixture, key and generation."""
    g = streams.generations(_segments(spark, folder), ["capture_id", *KEY])
    out = g.groupBy(F.col("capture_id").alias("fixture"), *KEY, "generation").agg(F.count("*").alias("segments"), F.sum("size").alias("payload"), F.min("frame").alias("first_frame"))
    return out.withColumns({c: F.hex(c) for c in ("lo_addr", "hi_addr")})


def synthetic_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The generator's flows, as conversations."""
    c = reports.conversations(reports.packets(synthetic(spark, 6400), "tcp"), ["stream_id"])
    return c.select(F.greatest("a.port", "b.port").alias("port"), (F.col("packets_a") + F.col("packets_b")).alias("packets"), (F.col("bytes_a") + F.col("bytes_b")).alias("bytes"), "first_number")


def interface_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Frames per interface, by link type where it is known and else by the fixture's first interface."""
    f = stage.as_raw(table(spark, folder, "fixture_frame"))
    i = table(spark, folder, "fixture_iface").groupBy("fixture").agg(F.min_by(F.struct("iface_id", "link_type", "iface_name", "snaplen", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("dropped", F.lit(0)).alias("dropped")), "iface_id").alias("i"))
    j = f.join(i, f.capture_id == i.fixture, "left")
    return j.groupBy("capture_id", "i.iface_id", F.coalesce("link_type", "i.link_type").alias("link_type"), "i.received", "i.dropped").agg(F.count("*").alias("frames"), F.sum("orig_len").alias("bytes"))


#: the keyed rows of _SEG over distinct segments, with flags and generations
_GEN = f"""{_SEG.replace('FROM stream_segment)', 'FROM (SELECT DISTINCT ON (fixture, frame) * FROM stream_segment))').replace('SELECT fixture, frame, CASE', 'SELECT fixture, frame, coalesce(syn, false) AS syn, coalesce(ack_flag, false) AS acks, CASE').replace('SELECT fixture, frame, us', 'SELECT fixture, frame, syn, acks, us')},
n AS (SELECT *, row_number() OVER (PARTITION BY fixture, {_K} ORDER BY frame) AS r FROM keyed),
g AS (SELECT *, sum(CASE WHEN syn AND NOT acks AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fixture, {_K} ORDER BY frame ROWS UNBOUNDED PRECEDING) AS generation FROM n)"""

QUERIES = {f.__name__: f for f in (segment_findings, segment_generations, segment_conversations, synthetic_conversations, interface_statistics)}
ORACLE = {
    "segment_generations": f"WITH {_GEN} SELECT fixture, proto, count(*) AS streams, CAST(sum(c) AS BIGINT) AS segments FROM (SELECT fixture, {_K}, generation, count(*) AS c FROM g GROUP BY ALL) GROUP BY fixture, proto",
    "segment_conversations": f"WITH {_GEN} SELECT fixture, {_K}, CAST(generation AS BIGINT) AS generation, count(*) AS segments, CAST(sum(payload_len) AS BIGINT) AS payload, min(frame) AS first_frame FROM g GROUP BY fixture, {_K}, generation",
    "synthetic_conversations": "SELECT CAST(40000 + i % 64 AS BIGINT) AS port, count(*) AS packets, CAST(sum(54 + i % 1400) AS BIGINT) AS bytes, min(i) + 1 AS first_number FROM range(6400) t(i) GROUP BY i % 64",
    "interface_statistics": """WITH f AS (SELECT DISTINCT fixture, number, link_type, orig_len FROM fixture_frame), i AS (SELECT fixture, arg_min({'iface_id': iface_id, 'link_type': link_type, 'received': coalesce(received, 0), 'dropped': coalesce(dropped, 0)}, iface_id) AS i FROM fixture_iface GROUP BY fixture)
SELECT f.fixture AS capture_id, i.i.iface_id AS iface_id, coalesce(f.link_type, i.i.link_type) AS link_type, i.i.received AS received, i.i.dropped AS dropped, count(*) AS frames, CAST(sum(orig_len) AS BIGINT) AS bytes FROM f LEFT JOIN i ON f.fixture = i.fixture GROUP BY ALL""",
}
