"""Capture files as a Spark data source, batch and streaming, and saving frames as capture files.

    spark.dataSource.register(CaptureSource)
    spark.read.format("capture").load("captures/*.pcap*")        # RAW columns and iface_id
    spark.readStream.format("binaryFile")...                     # see streaming.live
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.sources import formats

SCHEMA = "capture_id string, number bigint, iface_id int, link_type int, ts_ns bigint, orig_len bigint, caplen bigint, bytes binary"
INFO = "capture_id string, format string, truncated_at bigint, warnings array<string>, interfaces array<struct<iface_id:int,link_type:int,snaplen:bigint,name:string,description:string,ts_offset:bigint,received:bigint,dropped:bigint,filter_accepted:bigint,os_dropped:bigint>>"
BATCH = 4096


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path


def files(path: str) -> list[str]:
    path = _local(path)
    return sorted(f for f in (glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(f))


def record_batches(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """A file's frames, numbered from 1 in file order."""
    c = formats.read(data)
    for at in range(0, len(c.packets), BATCH):
        part = c.packets[at : at + BATCH]
        cols = [[name] * len(part), range(at + 1, at + 1 + len(part)), [p[0] for p in part], [c.interfaces[p[0]].link_type for p in part], [p[1] for p in part], [p[2] or len(p[3]) for p in part], [len(p[3]) for p in part], [p[3] for p in part]]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["capture_id", "number", "iface_id", "link_type", "ts_ns", "orig_len", "caplen", "bytes"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = files(options["path"])
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        """A file each: its records form a chain."""
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            yield from record_batches(partition.value, f.read())


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Frames of capture files on a shared file system; capture_id is the file."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").load(path)


def from_binary(df: DataFrame) -> DataFrame:
    """Frames of a `binaryFile` DataFrame (path, content): any store Spark reads, also as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from record_batches(name, data)

    return df.select("path", "content").mapInArrow(run, SCHEMA)


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: format, truncated_at, warnings and the interfaces with their statistics. A file that cannot be
    read has its error as the only warning and no format."""
    paths = spark.createDataFrame([(p,) for p in files(path)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                with open(p, "rb") as f:
                    try:
                        c = formats.read(f.read())
                    except formats.CaptureError as e:
                        out.append({"capture_id": p, "format": None, "truncated_at": None, "warnings": [str(e)], "interfaces": []})
                        continue
                ifaces = [{"iface_id": i, "link_type": x.link_type, "snaplen": x.snaplen, "name": x.name, "description": x.description, "ts_offset": x.ts_offset, "received": x.received, "dropped": x.dropped, "filter_accepted": x.filter_accepted, "os_dropped": x.os_dropped} for i, x in enumerate(c.interfaces)]
                out.append({"capture_id": p, "format": c.format, "truncated_at": c.truncated_at, "warnings": c.warnings, "interfaces": ifaces})
            s, i, l = pa.string(), pa.int32(), pa.int64()
            iface = pa.struct([("iface_id", i), ("link_type", i), ("snaplen", l), ("name", s), ("description", s), ("ts_offset", l), ("received", l), ("dropped", l), ("filter_accepted", l), ("os_dropped", l)])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("capture_id", s), ("format", s), ("truncated_at", l), ("warnings", pa.list_(s)), ("interfaces", pa.list_(iface))]))

    return paths.repartition(max(paths.count(), 1)).mapInArrow(run, INFO)


_EXTENSIONS = r"\.(pcap|pcapng|cap)$"


def file_names(captures: DataFrame) -> DataFrame:
    """capture_id, file: the last part of each capture_id without a capture file's extension, made unlike by a hash of the
    whole capture_id where several captures share it (compared without case)."""
    plain = F.regexp_replace(F.element_at(F.split(F.coalesce("capture_id", F.lit("")), "[/\\\\]"), -1), f"(?i){_EXTENSIONS}", "")
    c = captures.select("capture_id").distinct().withColumn("file", F.when(plain.isin("", ".", ".."), F.lit("capture")).otherwise(plain))
    many = c.groupBy(F.lower("file").alias("same")).agg(F.count("*").alias("n")).where("n > 1")
    c = c.join(many, F.lower("file") == F.col("same"), "left")
    return c.select("capture_id", F.when(F.col("n").isNotNull(), F.concat_ws("-", "file", F.substring(F.sha2(F.coalesce("capture_id", F.lit("")), 256), 1, 12))).otherwise(F.col("file")).alias("file"))


def save(frames: DataFrame, folder: str, kind: str = "pcapng", interfaces: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Writes each capture_id to its own file in a shared folder; a row per file: capture_id, path, frames, bytes, format,
    precision, notes. Files are named by file_names(); one that is there already is an error unless overwrite is set.

    Each file is written by one task, sorted by number, from a stream of sorted rows. pcap takes one link type: that of the
    first frame; frames of others are left out and noted. Its times are microseconds unless one of them needs nanoseconds.
    pcapng has an interface per link type, first seen first; interfaces (link_type, name, description, snaplen) names them.
    """
    os.makedirs(_local(folder), exist_ok=True)
    first = frames.groupBy("capture_id").agg(F.min_by("link_type", "number").alias("first_link"), F.max(F.pmod("ts_ns", F.lit(1000)) != 0).alias("nanos"))
    links = frames.groupBy("capture_id", "link_type").agg(F.min("number").alias("n")).groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "link_type"))), lambda x: x["link_type"]).alias("links"))
    known = {} if interfaces is None else {r.link_type: (r.name, r.description, r.snaplen) for r in interfaces.select("link_type", "name", "description", "snaplen").dropDuplicates(["link_type"]).collect()}
    target = _local(folder)
    names = file_names(frames)
    if not overwrite and (there := sorted(os.listdir(target))):
        lost = names.where(F.concat("file", F.lit(f".{kind}")).isin(there)).take(1)
        if lost:
            raise FileExistsError(os.path.join(target, f"{lost[0].file}.{kind}"))
    same = lambda other, columns: f.join(other.withColumnRenamed("capture_id", "__c"), F.col("capture_id").eqNullSafe(F.col("__c"))).select(*f.columns, *columns)
    f = frames.select("capture_id", "number", "link_type", "ts_ns", "orig_len", "bytes")
    for other, columns in ((first, ("first_link", "nanos")), (links, ("links",)), (names, ("file",))):
        f = same(other, columns)
    f = f.repartition("capture_id").sortWithinPartitions("capture_id", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, report, done = (), None, None, []
        attempt = TaskContext.get().taskAttemptId()

        def finish() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, report["path"])  # a repeated task leaves one whole file
                done.append(report)

        for b in batches:
            for capture, _, link, ts, orig, raw, first_link, nanos, all_links, name in zip(*(c.to_pylist() for c in b.columns)):
                if (capture,) != at:
                    finish()
                    at, path = (capture,), os.path.join(target, f"{name}.{kind}")
                    out = open(f"{path}.{attempt}.part", "wb")  # noqa: SIM115
                    report = {"capture_id": capture, "path": path, "frames": 0, "bytes": 0, "format": kind, "precision": "nanoseconds" if nanos or kind == "pcapng" else "microseconds", "notes": []}
                    out.write(formats.pcap_header(first_link or 0, nanos) if kind == "pcap" else formats.pcapng_header(all_links, known))
                    skipped = 0
                raw = raw or b""
                if kind == "pcap" and link != first_link:
                    skipped += 1
                    report["notes"] = [f"{skipped} frames of other link types were left out"]
                    continue
                out.write(formats.pcap_record(ts or 0, orig or 0, raw, nanos) if kind == "pcap" else formats.pcapng_record(all_links.index(link), ts or 0, orig or 0, raw))
                report["frames"] += 1
                report["bytes"] += len(raw)
        finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("capture_id", pa.string()), ("path", pa.string()), ("frames", pa.int64()), ("bytes", pa.int64()), ("format", pa.string()), ("precision", pa.string()), ("notes", pa.list_(pa.string()))]))

    report = "capture_id string, path string, frames bigint, bytes bigint, format string, precision string, notes array<string>"
    return frames.sparkSession.createDataFrame(f.mapInArrow(run, report).collect(), report)  # a row per file
