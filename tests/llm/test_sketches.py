import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import heavylight, setsketch


def test_estimates_and_merging(spark):
    df = spark.range(60000).select((F.col("id") % 3).alias("g"), (F.col("id") % 20000).alias("item"), F.lit(1).alias("level"), F.lit(2).alias("register"))
    a = setsketch.registers(df.where("item < 12000"), ["g"], F.col("item"))
    b = setsketch.registers(df.where("item >= 9000"), ["g"], F.col("item"))
    whole = setsketch.registers(df, ["g"], F.col("item"))
    union = setsketch.merged(a.unionByName(b), ["g"])
    key = lambda d: sorted((r.g, r.register, r.level) for r in d.collect())
    assert key(union) == key(whole)
    for r in setsketch.estimates(whole, ["g"]).collect():
        assert r.rows == 20000 and abs(r.estimate - 20000) < 4 * setsketch.relative_error() * 20000
        assert abs(r.error / r.estimate / setsketch.relative_error() - 1) < 0.2


def test_small_sets_nulls_and_nothing(spark):
    rows = [("a", i % 7) for i in range(100)] + [("a", None), ("b", None), (None, 1)]
    df = spark.createDataFrame(rows, "g string, item int")
    got = {r.g: (r.rows, r.estimate) for r in setsketch.estimates(setsketch.registers(df, ["g"], F.col("item")), ["g"]).collect()}
    assert set(got) == {"a", None} and got["a"][0] == 100 and abs(got["a"][1] - 7) < 0.6 and abs(got[None][1] - 1) < 0.1
    assert setsketch.estimates(setsketch.registers(df.where("false"), ["g"], F.col("item")), ["g"]).count() == 0


def test_overlap(spark):
    one = setsketch.registers(spark.range(30000), [], F.col("id")).withColumnRenamed("level", "level_1")
    two = setsketch.registers(spark.range(20000, 60000), [], F.col("id")).withColumnRenamed("level", "level_2")
    pairs = one.select("register", "level_1").join(two.select("register", "level_2"), "register", "full_outer").withColumn("k", F.lit(1))
    r = setsketch.overlaps(pairs, ["k"]).first()
    assert abs(r.jaccard - 1 / 6) < 4 * r.jaccard_error and 0 < r.jaccard_error < 0.05
    assert abs(r.union_size - 60000) < 6000


def _pairs(spark, n, first, second, shared):
    """n pairs of sets of first and second items, of which shared are in both."""
    every = spark.range(n * (first + second - shared)).select(F.expr(f"id div {first + second - shared}").alias("k"), F.expr(f"id % {first + second - shared}").alias("i"), "id")
    one = setsketch.registers(every.where(F.col("i") < first), ["k"], F.col("id")).select("k", "register", F.col("level").alias("level_1"))
    two = setsketch.registers(every.where(F.col("i") >= first - shared), ["k"], F.col("id")).select("k", "register", F.col("level").alias("level_2"))
    return one.join(two, ["k", "register"], "full_outer")


def test_errors_are_stated_rightly_over_many_pairs(spark):
    """The spread of the estimates over 120 pairs is what their stated errors say, and so is the share beyond two errors."""
    for first, second, shared in ((14_000, 14_000, 8_000), (3_000, 9_000, 600), (400, 300, 150)):
        rows = setsketch.overlaps(_pairs(spark, 120, first, second, shared), ["k"]).collect()
        union = first + second - shared
        for name, true, error in (("size_1", first, "size_1_error"), ("size_2", second, "size_2_error"), ("union_size", union, "union_error"), ("intersection", shared, "intersection_error"), ("jaccard", shared / union, "jaccard_error")):
            off = np.array([(getattr(r, name) - true) / getattr(r, error) for r in rows])
            assert len(off) == 120 and abs(off.mean()) < 0.4, (name, first, off.mean())
            assert 0.8 < off.std() < 1.25, (name, first, off.std())
            assert (np.abs(off) > 2).mean() < 0.11, (name, first)


def test_overlap_at_the_limits(spark):
    """Equal sets, sets without a common item, a set in another, an empty set."""
    for first, second, shared in ((5000, 5000, 5000), (5000, 4000, 0), (6000, 1000, 1000), (3, 3, 1)):
        r = setsketch.overlaps(_pairs(spark, 1, first, second, shared), ["k"]).first()
        assert abs(r.intersection - shared) <= 3.5 * max(r.intersection_error, 0.3), (first, r)
        assert abs(r.union_size - (first + second - shared)) <= 3.5 * max(r.union_error, 0.3), (first, r)
        assert 0 <= r.jaccard <= 1
    only = spark.createDataFrame([(1, 5, 9, None), (2, 5, 0, None)], "k int, register int, level_1 int, level_2 int")
    got = {r.k: r for r in setsketch.overlaps(only, ["k"]).collect()}
    assert got[1].size_2 < 0.01 and got[1].intersection < 0.01 and got[1].size_1 > 0.9 and got[2].union_size == got[2].jaccard == 0
    assert setsketch.overlaps(only.where("false"), ["k"]).count() == 0


def test_rolled(spark):
    df = spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (2, "x", "p")], "b int, f string, item string")
    regs = setsketch.registers(df, ["b", "f"], F.col("item"))
    key = ["grouping_set", "b", "f"]
    got = setsketch.estimates(setsketch.rolled(regs, ["b", "f"], [["b", "f"], ["b"]]), key).collect()
    assert sorted((r.b, r.f, r.rows, round(r.estimate)) for r in got) == [(1, "*", 2, 2), (1, "x", 1, 1), (1, "y", 1, 1), (2, "*", 1, 1), (2, "x", 1, 1)]
    star = setsketch.registers(spark.createDataFrame([(1, "*", "p"), (1, "y", "q")], "b int, f string, item string"), ["b", "f"], F.col("item"))
    got = setsketch.estimates(setsketch.rolled(star, ["b", "f"], [["b", "f"], ["b"]]), key).collect()
    assert sorted((r.grouping_set, r.f, r.rows) for r in got) == [(0, "*", 1), (0, "y", 1), (1, "*", 2)]


def test_sketch_bounds():
    r = np.random.default_rng(1)
    v = r.zipf(1.2, 200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = heavylight.Sketch(buckets=16, slots=2, width=512)
    for part in np.array_split(v, 7):
        s.add(*np.unique(part, return_counts=True))
    true = dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True))))
    assert s.n.sum() + s.light[0].sum() == len(v) and s.light[0].sum() == s.light[1].sum()
    b, i = np.nonzero(s.n)
    for k, n in zip(s.key[b, i], s.n[b, i]):
        p = s.places(np.array([k]))[:, 0]
        assert n <= true[int(k)] <= n + min(s.light[0, p[0]], s.light[1, p[1]])
    assert int(max(true, key=true.get)) in s.key


def test_frequent(spark):
    rows = [("hot", 7)] * 4000 + [(f"v{i % 3000}", i % 500) for i in range(9000)] + [(None, None)] * 50 + [("tie1", 8)] * 300 + [("tie2", 9)] * 300
    df = spark.createDataFrame(rows, "a string, b int").withColumn("kind", F.lit("clash")).withColumn("key", F.lit(1)).repartition(5)
    got = heavylight.frequent(df, [F.col("a"), F.col("b")], ["a", "b"], 0.02)
    by = {(r.kind, r.value): r for r in got.collect()}
    want = {("a", "hot"): 4000, ("a", "tie1"): 300, ("a", "tie2"): 300, ("b", "7"): 4018, ("b", "8"): 318, ("b", "9"): 318}
    assert {k: by[k].rows for k in want} == want
    assert all(r.at_least <= r.rows <= r.at_most and r.total == 13600 for r in by.values())
    assert {k for k, r in by.items() if r.rows >= 0.02 * r.total} == set(want)
    assert heavylight.frequent(df.where("false"), [F.col("a")], ["a"], 0.02).count() == 0


def test_frequent_at_any_share(spark, monkeypatch):
    """More values reach the share than there are counters: what the sketch cannot rule out is counted exactly."""
    df = spark.range(60_000, numPartitions=4).select(F.concat(F.lit("v"), F.col("id") % 20_000).alias("a"))
    got = heavylight.frequent(df, [F.col("a")], ["a"], 4e-5).collect()
    assert len({r.value for r in got}) == 20_000 and {r.rows for r in got} == {3}
    for name, n in (("BUCKETS", 16), ("MOST_BUCKETS", 16), ("WIDTH", 64), ("MOST_WIDTH", 64)):
        monkeypatch.setattr(heavylight, name, n)
    half = df.where("id % 3 < 2 or id % 20000 < 900")
    got = heavylight.frequent(half, [F.col("a")], ["a"], 2.5 / 60_000).collect()
    by = {r.value: r for r in got}
    n = half.groupBy("a").count().where(f"count >= {2.5 / 60_000} * {got[0].total}").collect()
    assert all(by[r.a].rows == r["count"] and by[r.a].at_least <= r["count"] <= by[r.a].at_most for r in n) and len(n) > 900


def test_frequent_over_unlike_partitions(spark):
    """A value that is hot in one partition only, after others filled its bucket, and values that never keep a counter."""
    df = spark.range(400_000, numPartitions=8).select(F.when((F.spark_partition_id() == 5) & (F.col("id") % 3 > 0), F.lit("late")).otherwise(F.concat(F.lit("x"), F.col("id") % 90_000)).alias("a"))
    true = df.where("a = 'late'").count()
    got = {r.value: r for r in heavylight.frequent(df, [F.col("a")], ["a"], 0.05).collect()}
    assert got["late"].rows == true and got["late"].at_least <= true <= got["late"].at_most and abs(got["late"].estimate - true) < 0.01 * true
