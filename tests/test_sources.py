"""Capture files: round trips, error policies, and frames arriving as a stream."""

import os
import shutil
import struct

import packets as P
import pytest
from pyspark.sql import functions as F
from test_dissect import mixed_frames

from tidewire.dissect import layers
from tidewire.sources import capture, formats
from tidewire.sources.synthetic import frame, synthetic
from tidewire.streaming import live


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(mixed_frames(), P.RAW)


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_round_trip(spark, raw, tmp_path, kind):
    df = raw.withColumn("ts_ns", F.col("ts_ns") + 123_456_789).withColumn("orig_len", F.col("orig_len") + 5)
    report = capture.save(df, str(tmp_path), kind).collect()
    assert [(r.frames, r.format, r.precision, r.notes) for r in report] == [(17, kind, "nanoseconds", [])]
    back = capture.load(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r.number, r.ts_ns, r.orig_len, bytes(r.bytes), r.link_type) for r in back] == [(r.number, r.ts_ns, r.orig_len, bytes(r.bytes), 1) for r in df.orderBy("number").collect()]
    d = capture.describe(spark, str(tmp_path)).first()
    assert d.format == kind and d.warnings == [] and d.interfaces[0].link_type == 1


def test_mixed_links_and_precision(spark, tmp_path):
    rows = [("m", 1, 1, 1000, 4, b"abcd"), ("m", 2, 0, 2000, 4, b"efgh"), ("m", 3, 1, 3000, 4, b"ijkl")]
    df = spark.createDataFrame(rows, P.RAW)
    r = capture.save(df, str(tmp_path / "a"), "pcap").first()
    assert (r.frames, r.precision, r.notes) == (2, "microseconds", ["1 frames of other link types were left out"])
    names = spark.createDataFrame([(0, "lo0", "loopback", 99), (0, "lo0", "loopback", 99)], "link_type int, name string, description string, snaplen long")
    capture.save(df, str(tmp_path / "b"), "pcapng", names)
    back = capture.load(spark, str(tmp_path / "b")).orderBy("number").collect()
    assert [r.link_type for r in back] == [1, 0, 1]
    d = capture.describe(spark, str(tmp_path / "b")).first()
    assert d.interfaces[1].name == "lo0" and d.interfaces[1].snaplen == 99 and "mixes link types" in d.warnings[0]


def test_pcap_policies():
    whole = formats.pcap_header(1, False) + formats.pcap_record(5_000_000_000, 3, b"abc", False)
    assert formats.read(whole).packets == [(0, 5_000_000_000, 3, b"abc")]
    cut = formats.read(whole + formats.pcap_record(6 * 10**9, 3, b"abc", False)[:-1])
    assert len(cut.packets) == 1 and cut.truncated_at == len(whole) and "middle of a record" in cut.warnings[0]
    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 3600, 0, 99, 1) + struct.pack(">IIII", 1, 2_000_000_000, 1, 1) + b"x"
    assert formats.read(big).packets == [(0, 3601 * 10**9 + 999_999_999, 1, b"x")]
    with pytest.raises(formats.CaptureError):
        formats.read(formats.pcap_header(1, False) + struct.pack("<IIII", 0, 0, 9, 4) + bytes(9))
    for head, part in ((b"", "empty"), (b"\x1f\x8b\x08\0", "gzip"), (b"\x34\xcd\xb2\xa1", "modified"), (b"abcd", "neither")):
        with pytest.raises(formats.CaptureError, match=part):
            formats.read(head)
    assert formats.pcap_record(-5, 1, b"abc", False)[:16] == struct.pack("<IIII", 0, 0, 3, 3)


def test_pcapng_policies():
    b = formats._block
    section = formats.pcapng_header([])
    iface = lambda *o: b(1, struct.pack("<HHI", 1, 0, 4) + b"".join(o))
    packet = lambda i, t, raw: b(6, struct.pack("<IIIII", i, t >> 32, t & 0xFFFFFFFF, len(raw), len(raw)) + raw + bytes(-len(raw) % 4))
    data = section + iface(formats._option(9, b"\x03"), formats._option(14, struct.pack("<q", 10))) + packet(0, 1500, b"abc") + b(3, struct.pack("<I", 9) + b"abcd") + packet(7, 1000, b"x") + b(5, struct.pack("<III", 0, 0, 0) + formats._option(5, struct.pack("<Q", 4))) + b(99, b"skip")
    c = formats.read(data + b"tail")
    assert c.packets == [(0, 11_500_000_000, 3, b"abc"), (0, 0, 9, b"abcd"), (0, 11 * 10**9, 1, b"x")]
    assert c.interfaces[0].dropped == 4 and len(c.warnings) == 2
    two = formats.read(section + iface() + packet(0, 10**6, b"a") + section + b(1, struct.pack("<HHI", 101, 0, 4)) + packet(0, 10**6, b"b"))
    assert [two.interfaces[p[0]].link_type for p in two.packets] == [1, 101]
    base2 = formats.read(section + iface(formats._option(9, b"\x8a")) + packet(0, 1536, b"a"))
    assert base2.packets[0][1] == 1_500_000_000
    with pytest.raises(formats.CaptureError):
        formats.read(data[:-5] + b"\0\0\0\0\0")
    with pytest.raises(formats.CaptureError):
        formats.read(section + iface() + b(6, struct.pack("<IIIII", 0, 0, 0, 99, 99)))


def test_saved_captures_keep_their_names_apart(spark, raw, tmp_path):
    ids = ["d/cap.1.pcap", "d/cap.2.pcap", "e/cap.1.pcap", "E\\CAP.1", None]
    df = raw.where("number <= 2").drop("capture_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "capture_id string"))
    report = {r.capture_id: r for r in capture.save(df, str(tmp_path), "pcap").collect()}
    assert set(report) == set(ids) and len({r.path for r in report.values()}) == 5 and report["d/cap.2.pcap"].path.endswith("cap.2.pcap")
    assert all(len(formats.read(open(r.path, "rb").read()).packets) == 2 == r.frames for r in report.values())
    with pytest.raises(FileExistsError):
        capture.save(df, str(tmp_path), "pcap")
    assert len(capture.save(df, str(tmp_path), "pcap", overwrite=True).collect()) == 5


def test_unreadable_file_is_described(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"\x1f\x8b....")
    d = capture.describe(spark, str(tmp_path)).first()
    assert d.format is None and "gzip" in d.warnings[0]


def test_synthetic(spark):
    rows = synthetic(spark, 200, 3).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, 201)) and rows[1].ts_ns - rows[0].ts_ns == 1_000_000
    for i in (0, 1, 63, 1399, 2801):
        x = layers.frame(frame(i), 1, 1, 0, 0)
        assert x.expert is None and x.info.endswith(f"Len={i % 1400}")


def test_stream_equals_batch(spark, raw, tmp_path):
    import pyspark.sql.types as T  # noqa: F401

    made = tmp_path / "made"
    capture.save(raw.where("number <= 8").withColumn("capture_id", F.lit("one")), str(made), "pcapng")
    capture.save(raw.withColumn("capture_id", F.lit("two")), str(made), "pcapng")
    arriving = tmp_path / "in"
    arriving.mkdir()
    q = live.analysis(live.frames(spark, str(arriving))).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    for f in sorted(os.listdir(made)):
        shutil.copy(made / f, arriving / f)
        run = q.start() if f.startswith("one") else None
        if run:
            run.awaitTermination()
    t = live.traffic(live.frames(spark, str(arriving)), "5 seconds").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    t.awaitTermination()
    assert {r.packets for r in spark.table("windows").collect()} <= {3, 5, 2} and sum(r.packets for r in spark.table("windows").collect()) == 25
    got = spark.table("seen").collect()
    assert {r.number for r in got} == {1, 2, 3, 5, 7, 8} and all(r.generation == 0 for r in got)
    assert {r.number: r.in_flight for r in got}[3] == 19
    u = live.talkers(live.frames(spark, str(arriving))).writeStream.format("memory").queryName("talk").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    u.awaitTermination()
    assert sum(r.packets for r in spark.table("talk").collect()) == 23
