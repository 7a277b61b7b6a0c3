"""The general problems' operators against brute force, and their queries against SQL."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import difference, views
from tidewire.functions.addresses import canonical_addr, canonical_v6, stream_key
from tidewire.functions.times import floor_div
from tidewire.operators import grid, sessions, skew
from tidewire.plans import problems

T0 = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("name", sorted(problems.ORACLE))
def test_sql(spark, data, name):
    assert difference(problems.QUERIES[name](spark, data), views(data), problems.ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_addresses(spark):
    v4 = bytes([10, 1, 2, 3])
    forms = [(v4 + bytes(12), False), (bytes(12) + v4, False), (bytes(10) + b"\xff\xff" + v4, True), (v4 + bytes(12), None), (bytes(12) + v4, None)]
    others = [(bytes(12) + v4, True), (bytes.fromhex("20010db8") + bytes(12), True), (None, None), (b"\1\2", False), (bytes(16), False)]
    df = spark.createDataFrame(forms + others, "addr binary, v6 boolean")
    got = [(r[0] and bytes(r[0]), r[1]) for r in df.select(canonical_addr(F.col("addr"), F.col("v6")), canonical_v6(F.col("addr"), F.col("v6"))).collect()]
    assert got[:5] == [(v4 + bytes(12), False)] * 5
    assert got[5:] == [(bytes(12) + v4, True), (others[1][0], True), (None, False), (b"\1\2", False), (bytes(16), False)]


def test_stream_key_is_symmetric(spark):
    end = "struct<addr:binary,v6:boolean,port:int>"
    a, b = (bytes([9]) + bytes(15), False, -1), (bytes(12) + bytes([9, 0, 0, 0]), False, 80)
    df = spark.createDataFrame([(a, b, 6), (b, a, 6), (None, a, 6), (a, None, 6)], f"lo {end}, hi {end}, proto int")
    rows = [tuple(r) for r in df.select(*stream_key(F.col("lo"), F.col("hi"), F.col("proto"))).collect()]
    assert rows[0] == rows[1] and rows[0][2] == 80 and rows[0][5] == 65535
    assert rows[2] == rows[3] and rows[2][0] is None


def test_floor_div(spark):
    pairs = [(-7, 3), (-6, 3), (0, 3), (7, 3), (-1, 10**12), (2**62, 7)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert [r[0] for r in df.select(floor_div(F.col("a"), F.col("b"))).collect()] == [a // b for a, b in pairs]


def pchip(xs, ys, x):
    """Monotone cubic through all of xs, by the definition."""
    n = len(xs)
    h = [xs[i + 1] - xs[i] for i in range(n - 1)]
    s = [(ys[i + 1] - ys[i]) / h[i] for i in range(n - 1)]

    def edge(h0, h1, s0, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        sign = lambda v: (v > 0) - (v < 0)
        return 0.0 if sign(d) != sign(s0) else 3 * s0 if sign(s0) != sign(s1) and abs(d) > 3 * abs(s0) else d

    if n == 2:
        d = [s[0], s[0]]
    else:
        d = [edge(h[0], h[1], s[0], s[1])]
        for i in range(1, n - 1):
            w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            d.append(0.0 if s[i - 1] * s[i] <= 0 else (w0 + w1) / (w0 / s[i - 1] + w1 / s[i]))
        d.append(edge(h[-1], h[-2], s[-1], s[-2]))
    i = max(k for k in range(n - 1) if xs[k] <= x)
    u = (x - xs[i]) / h[i]
    return ys[i] * (1 + 2 * u) * (1 - u) ** 2 + h[i] * d[i] * u * (1 - u) ** 2 + ys[i + 1] * u * u * (3 - 2 * u) + h[i] * d[i + 1] * u * u * (u - 1)


def brute_series(points, buckets, step, max_gap):
    at = {}
    for t, v in points:
        at.setdefault(t, []).append(v)
    read = sorted((t, sum(v) / len(v)) for t, v in at.items())
    segments, by = [], {}
    for t, v in read:
        b = t // step
        by.setdefault(b, []).append(v)
        if segments and b - segments[-1][-1][0] // step - 1 <= max_gap:
            segments[-1].append((t, v))
        else:
            segments.append([(t, v)])
    out = {}
    for b in range(buckets):
        if b in by:
            out[b] = (len(by[b]), sum(by[b]) / len(by[b]), "read")
            continue
        mid = b * step + step // 2
        inside = [s for s in segments if s[0][0] < mid < s[-1][0]]
        out[b] = (0, pchip([t / 1e6 for t, _ in inside[0]], [v for _, v in inside[0]], mid / 1e6), "filled") if inside else (0, None, "absent")
    return out


def test_series_against_brute_force(spark):
    r = random.Random(11)
    lines, graphs, want = [], [], {}
    for g in range(12):
        step, buckets = r.choice([1000, 1_000_000, 60_000_000]), r.choice([1, 30, 200])
        graphs += [(g, step / 1e6, T0, buckets, ["a", "b", "c"], "clash")] * r.choice([1, 2])
        for line in range(3):
            points = []
            for _ in range(r.choice([0, 1, 2, 8, 40])):
                off, vals = r.randrange(-3 * step, (buckets + 3) * step), [r.choice([None, math.nan, r.uniform(-5, 5), r.uniform(-5, 5)]) for _ in range(r.randint(1, 4))]
                for _ in range(r.choice([1, 1, 2])):
                    lines.append((g, line, T0 + dt.timedelta(microseconds=off), vals, "clash"))
                    points += [(off + i * step, v) for i, v in enumerate(vals) if v is not None and v == v]
            for b, x in brute_series(points, buckets, step, 5).items():
                want[g, line, b] = x
    lines += [(0, 0, None, [1.0], None), (0, 0, T0, None, None), (0, 9, T0, [1.0], None), (99, 0, T0, [1.0], None), (None, None, T0, [1.0], None)]
    graphs += [(50, 1.0, None, 0, ["a"], None), (51, 1.0, T0, 0, ["a"], None), (52, 1.0, T0, 3, [], None), (53, 1.0, T0, 2, ["a"], None)]
    want |= {(53, 0, 0): (0, None, "absent"), (53, 0, 1): (0, None, "absent")}
    l = spark.createDataFrame(lines, "graph_id bigint, line_no int, ts timestamp_ntz, points array<double>, value string")
    g = spark.createDataFrame(graphs, "graph_id bigint, graph_interval double, graph_start timestamp_ntz, buckets bigint, series array<string>, status string")
    for shard in (1, 7, 2048):
        rows = grid.regular_series(l, g, max_gap=5, shard_buckets=shard).collect()
        got = {(x.graph_id, x.line_no, x.bucket): (x.n_readings, x.value, x.status) for x in rows}
        assert len(rows) == len(want) and got.keys() == want.keys()
        for k, (n, v, s) in want.items():
            assert got[k][0] == n and got[k][2] == s, k
            assert (v is None) == (got[k][1] is None) and (v is None or math.isclose(v, got[k][1], rel_tol=1e-6, abs_tol=1e-6)), (k, v, got[k])
    assert grid.regular_series(l.where("false"), g.where("false")).count() == 0


def test_series_passes_through_readings(spark):
    at = [(0.0, 0.0), (0.9, 10.0), (2.0, 10.0), (2.9, 0.0)]
    lines = spark.createDataFrame([(1, 0, T0 + dt.timedelta(seconds=t), [v]) for t, v in at], "graph_id bigint, line_no int, ts timestamp_ntz, points array<double>")
    graphs = spark.createDataFrame([(1, 1.0, T0, 3, ["a"])], "graph_id bigint, graph_interval double, graph_start timestamp_ntz, buckets bigint, series array<string>")
    got = {r.bucket: (r.status, r.value) for r in grid.regular_series(lines, graphs).collect()}
    assert got == {0: ("read", 5.0), 1: ("filled", 10.0), 2: ("read", 5.0)}


def test_series_of_long_fragments(spark, monkeypatch):
    """A fragment longer than a row takes, over several shards, and again shifted by half a step."""
    monkeypatch.setattr(grid, "READINGS_A_ROW", 7)
    values = [float(i % 13) for i in range(500)]
    lines = spark.createDataFrame([(1, 0, T0 + dt.timedelta(seconds=3), values), (1, 0, T0 + dt.timedelta(seconds=3.5), values), (1, 0, T0, [])], "graph_id bigint, line_no int, ts timestamp_ntz, points array<double>")
    graphs = spark.createDataFrame([(1, 1.0, T0, 600, ["a"])], "graph_id bigint, graph_interval double, graph_start timestamp_ntz, buckets bigint, series array<string>")
    got = {r.bucket: (r.n_readings, r.value, r.status) for r in grid.regular_series(lines, graphs, shard_buckets=64).collect()}
    assert got == {b: (2, values[b - 3], "read") if 3 <= b < 503 else (0, None, "absent") for b in range(600)}


def test_series_of_one_hot_shard(spark, monkeypatch):
    """One shard's rows from many tasks, more than are held at a time."""
    n = 200_000
    lines = spark.range(n, numPartitions=8).select(F.lit(1).alias("graph_id"), F.lit(0).alias("line_no"), F.timestamp_micros(F.lit(1_577_836_800_000_000) + F.pmod("id", F.lit(900)) * 2_000_000 + F.pmod("id", F.lit(7)) * 1000).alias("ts"), F.array(F.lit(2.0)).alias("points"))
    graphs = spark.createDataFrame([(1, 1.0, T0, 1800, ["a"])], "graph_id int, graph_interval double, graph_start timestamp_ntz, buckets bigint, series array<string>")
    monkeypatch.setattr(grid, "HELD", 3000)
    rows = grid.regular_series(lines, graphs).groupBy("status").agg(F.count("*"), F.sum("n_readings"), F.min("value"), F.max("value")).collect()
    assert {tuple(r) for r in rows} == {("read", 900, 6300, 2.0, 2.0), ("filled", 899, 0, 2.0, 2.0), ("absent", 1, 0, None, None)}


def test_weighted_statistics(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", None]), r.choice([None, r.randrange(3), r.randrange(5000)]), "clash") for _ in range(4000)] + [("null", None, None)]
    df = spark.createDataFrame(rows, "k string, v bigint, n string")
    freq = skew.value_frequencies(df, ["k"], "v")
    stats = {x.k: x for x in skew.key_statistics(freq, ["k"], "v").collect()}
    pct = {(x.k, x.fraction): x.v for x in skew.key_percentiles(freq, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    for k in {x[0] for x in rows}:
        v = sorted(x[1] for x in rows if x[0] == k and x[1] is not None)
        s = stats[k]
        assert (s.rows, s.total, s.distinct_values) == (sum(x[0] == k for x in rows), sum(v) if v else None, len(set(v)))
        assert (s.mode, s.mode_rows) == (min(set(v), key=lambda x: (-v.count(x), x)), max(map(v.count, set(v)))) if v else s.mode is None
        for f in (0.0, 0.5, 0.9, 1.0):
            assert pct.get((k, f)) == (v[max(math.ceil(f * len(v)), 1) - 1] if v else None)
    assert [x.k for x in skew.hot_keys(freq, ["k"], 0.6).collect()] == ["hot"]
    none = skew.value_frequencies(df.where("false"), ["k"], "v")
    assert skew.key_statistics(none, ["k"], "v").count() == skew.key_percentiles(none, ["k"], "v", [0.5]).count() == skew.hot_keys(none, ["k"], 0.1).count() == 0


def test_sessions_against_brute_force(spark):
    r, gap = random.Random(4), 100
    rows = [(r.choice(["x", "y", None]), r.choice([None, r.randrange(-2000, 6000)]), r.choice([None, r.randrange(300)]), "clash") for _ in range(900)]
    rows += rows[:40] + [("z", 0, 1, ""), ("z", 100, 2, ""), ("z", 201, 3, ""), ("z", 201, 3, "")]
    df = spark.createDataFrame(rows, "k string, us bigint, frame bigint, session string")
    want = []
    for k in {x[0] for x in rows}:
        e = sorted((x for x in rows if x[0] == k and x[1] is not None), key=lambda x: x[1])
        run = []
        for x in [*e, None]:
            if run and (x is None or x[1] - run[-1][1] > gap):
                want.append((k, run[0][1], run[-1][1], run[-1][1] - run[0][1], len(run), len({(y[1], y[2]) for y in run if y[2] is not None})))
                run = []
            run.append(x)
    order = lambda x: (x[0] or "", x[1])
    for shard in (50, 1000, 10**9):
        got = [tuple(x) for x in sessions.sessions(df, ["k"], "us", "frame", gap, shard).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    assert ("z", 0, 100, 100, 2, 2) in want
    assert sessions.sessions(df.where("false"), ["k"], "us", "frame", gap).count() == 0
