import random

import tiktoken
from pyspark.sql import functions as F

from tidewire.llm import mixture, queries, tokens


def sized(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    return df.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 4))


def test_shares_limits_and_nesting(spark):
    rows = [(i, "big", 10 + i % 5) for i in range(3000)] + [(10000 + i, "tiny", 7) for i in range(20)] + [(20000 + i, None, 9) for i in range(50)] + [(30000 + i, "other", 3) for i in range(40)]
    size = sized(spark, rows)
    targets = spark.createDataFrame([("BIG ", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.1, 5), (" big", 0.3, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    total = sum(r[2] for r in rows)
    plan = mixture.plan(mixture.histogram(size), targets)
    p = {r.source: r for r in plan.collect()}
    assert set(p) == {"big", "tiny", "none"} and all(r.total == total for r in p.values())
    assert {k: r.short for k, r in p.items()} == {"big": False, "tiny": True, "none": True} and p["tiny"].whole == 3
    limits = mixture.thresholds(size, plan)
    used = mixture.mixed(size, limits)
    got = {r.doc_id: r.repeats for r in used.collect()}
    assert all(got[10000 + i] == 3 for i in range(20)) and not any(k >= 20000 for k in got)
    big = sum(r[2] * got.get(r[0], 0) for r in rows if r[1] == "big")
    assert 0.3 * total - 15 <= big <= 0.3 * total
    more = mixture.plan(mixture.histogram(size), targets, F.lit(float(total) * 1.5))
    wider = {r.doc_id: r.repeats for r in mixture.mixed(size, mixture.thresholds(size, more)).collect()}
    assert all(wider.get(k, 0) >= n for k, n in got.items())
    s = {r.source: r for r in mixture.shares(used, limits).collect()}
    assert s["big"].used == big and s["none"].used == 0 and abs(sum(r.share for r in s.values()) - 1) < 1e-9


def brute(rows, weights, bits=36):
    """Thresholds, repeats and shares by sorting a source's records by hash."""
    total, used, limits = sum(n for _, _, n, _ in rows), {}, {}
    for source, (weight, most) in weights.items():
        own = sorted((h, n, k) for k, s, n, h in rows if s == source)
        size = sum(n for _, n, _ in own)
        short = most * size < weight * total
        whole = most if short else int(weight * total // size) if size else 0
        left, bound = (0 if short else weight * total - whole * size), 0
        if left > 0:
            upto = 0
            for h, n, _ in own:
                upto += n
                if upto > left:
                    bound = h >> (60 - bits) << (60 - bits)
                    break
        limits[source] = (short, bound)
        for h, n, k in own:
            used[k] = min(whole + (h < bound), most)
    return limits, {k: r for k, r in used.items() if r}


def test_thresholds_against_sorting(spark):
    r = random.Random(5)
    plain = [(i, r.choice(["a", "a", "a", "b", "c", "d"]), r.choice([0, 1, 5, 40, 3000])) for i in range(5000)] + [(90_000, "e", 7)] * 3
    size = sized(spark, plain)
    rows = [(x.doc_id, x.source, x.tokens, x.h) for x in size.collect()]
    weights = {"a": (0.2, 1), "b": (0.45, 3), "c": (0.3, 1), "d": (0.05, 9), "e": (1e-6, 100)}
    targets = spark.createDataFrame([(k, *w) for k, w in weights.items()], "source string, weight double, max_repeats int")
    limits = mixture.thresholds(size, mixture.plan(mixture.histogram(size), targets))
    want, used = brute(rows, weights)
    assert {x.source: (x.short, x.threshold) for x in limits.collect()} == want and {s for s, _ in want.values()} == {True, False}
    assert {x.doc_id: x.repeats for x in mixture.mixed(size, limits).collect()} == used


def test_mixture_of_the_tables(spark, data):
    """Sizes by a second tokenizer library, thresholds by sorting."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    encoder = tiktoken.Encoding("check", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=tokens.load_ranks(tokens.VOCABULARY), special_tokens={})
    rows = [(x.doc_id, x.source.strip(" ").lower() if x.source is not None else None, len(encoder.encode_ordinary(x.text or "")), x.h) for x in docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 4)).collect()]
    weights = {x.source.strip().lower(): (x.weight, x.max_repeats) for x in spark.read.parquet(f"{data}/mix_target.parquet").collect()}
    want, used = brute(rows, weights)
    assert {x.source for x in queries.p7_found(spark, data).collect()} == {k for k, (short, _) in want.items() if short}
    assert {x.doc_id: x.repeats for x in queries.p7_mix(spark, data).collect()} == used
    size = {k: n for k, _, n, _ in rows}
    source = {k: s for k, s, _, _ in rows}
    every = sum(n * size[k] for k, n in used.items())
    for x in queries.p7_shares(spark, data).collect():
        assert x.used == sum(n * size[k] for k, n in used.items() if source[k] == x.source)
        assert abs(x.share - x.used / every) < 1e-12


def test_whole_repeats_and_nothing(spark):
    size = sized(spark, [(1, "a", 10), (2, "a", 10), (3, "b", 60)])
    targets = spark.createDataFrame([("a", 0.5, 4)], "source string, weight double, max_repeats int")
    got = mixture.mixed(size, mixture.thresholds(size, mixture.plan(mixture.histogram(size), targets))).collect()
    assert {r.doc_id: r.repeats for r in got} == {1: 2, 2: 2}
    none = size.where("false")
    plan = mixture.plan(mixture.histogram(none), targets)
    assert plan.first().total == 0 and mixture.mixed(none, mixture.thresholds(none, plan)).count() == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world", " Src", "x"), (2, "", "src", "y"), (3, None, None, None)], "doc_id bigint, text string, source string, tokens string")
    got = {r.doc_id: (r.source, r.tokens) for r in mixture.sizes(docs).collect()}
    assert got == {1: ("src", 2), 2: ("src", 0), 3: (None, 0)}
