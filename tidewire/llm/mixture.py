"""Mixing sources to target weights by hash thresholds.

Sizes are summed by source and hash bucket. A source's budget is met by whole repeats and, for the rest, by the records
whose hash lies below a threshold: the bucket in which the budget ends is split again, and again, while everything below
it is taken whole. Nothing is sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import tokens
from tidewire.session import cut

STEP_BITS, STEPS = 12, 3  # the threshold is found to 36 of 60 bits; the records of one such bucket stay out


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", vocabulary: str = tokens.VOCABULARY, written: bool = True) -> DataFrame:
    """key, source (lower case, trimmed, null as it is), tokens, h: a written table, so texts are encoded once. Unwritten it
    suits a single use."""
    n = tokens.count(docs, text, [key, source], vocabulary)
    h = F.shiftrightunsigned(F.xxhash64(F.col(key)), 4)
    n = n.select(key, source_key(F.col(source)).alias("source"), "tokens", h.alias("h"))
    return cut(n) if written else n


def histogram(size: DataFrame) -> DataFrame:
    """source, bucket (the STEP_BITS highest bits of the hash), n (tokens): a written table of at most 2^STEP_BITS rows a
    source. Rows combine where they lie, so that a source of any number of records is spread evenly."""
    return cut(size.groupBy("source", F.shiftright("h", 60 - STEP_BITS).alias("bucket")).agg(F.sum("tokens").alias("n")))


def _upto() -> Column:
    return F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most 2^STEP_BITS rows


def plan(hist: DataFrame, targets: DataFrame, budget: Column | None = None) -> DataFrame:
    """source, weight, max_repeats, size, total, target, short, whole (full repeats), rest (tokens of the partial one), bucket
    and left (the hash bucket in which the partial repeat ends, null if there is none, and its tokens in that bucket).

    target is weight x budget, by default of the size of all records, those without a source or target included. A source's
    tokens are summed up along its buckets; short: max_repeats times the sum behind the last bucket stays below the target, so
    that no threshold meets it; then whole is max_repeats and rest 0. A repeated target row counts once; of rows that differ
    the largest (weight, max_repeats) counts. Null weights and max_repeats count as 0."""
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    t = targets.select(source_key(F.col("source")).alias("source"), F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).alias("t")).where("source is not null").groupBy("source").agg(F.max("t").alias("t")).select("source", "t.*")
    steps = t.join(hist.where("source is not null").withColumn("upto", _upto()), "source", "left")
    most = F.coalesce(F.max("upto").over(Window.partitionBy("source")), F.lit(0).cast("bigint"))
    steps = steps.withColumns({"size": most, "total": total.scalar()})
    steps = steps.withColumn("target", F.col("weight") * (F.col("total") if budget is None else budget))
    steps = steps.withColumn("short", F.col("max_repeats") * F.col("size") < F.col("target"))
    whole = F.when(F.col("short"), F.col("max_repeats").cast("bigint")).when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0).cast("bigint"))
    steps = steps.withColumn("whole", whole)
    steps = steps.withColumn("rest", F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("target") - F.col("whole") * F.col("size")))
    edge = F.min(F.when((F.col("rest") > 0) & (F.col("upto") > F.col("rest")), F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")))).alias("e")
    p = steps.groupBy("source", "weight", "max_repeats", "size", "total", "target", "short", "whole", "rest").agg(edge)
    return p.select(*(c for c in p.columns if c != "e"), "e.bucket", "e.left")


def thresholds(size: DataFrame, planned: DataFrame) -> DataFrame:
    """planned and threshold: the records of the source with h below it are repeated once more. Only the records of each
    source's boundary bucket are summed again, by finer buckets, STEPS - 1 times."""
    edge = planned.where("bucket is not null").select("source", "left", F.col("bucket").alias("prefix"))
    s = size.select("source", "tokens", "h")
    for k in range(2, STEPS + 1):
        shift = 60 - STEP_BITS * k
        e = edge.select("source", "left", "prefix")
        inside = s.join(e, "source").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        finer = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("n"))
        over = finer.withColumn("upto", _upto()).where("upto > left")
        first = over.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n", "left")).alias("x"))
        edge = cut(first.select("source", (F.col("x.left") - F.col("x.upto") + F.col("x.n")).alias("left"), F.col("x.bucket").alias("prefix")))
    bound = edge.select("source", F.shiftleft("prefix", 60 - STEP_BITS * STEPS).alias("threshold"))
    return planned.join(bound, "source", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("bigint")))


def mixed(size: DataFrame, limits: DataFrame) -> DataFrame:
    """The records used: their columns and repeats (1 .. max_repeats). Records whose source has no target are not used."""
    r = size.join(limits.select("source", "whole", "threshold", "max_repeats"), "source")
    r = r.withColumn("repeats", F.least(F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.col("max_repeats").cast("bigint")))
    return r.where("repeats > 0").drop("whole", "threshold", "max_repeats")


def shares(used: DataFrame, limits: DataFrame) -> DataFrame:
    """source, weight, size, target, short, records, used (tokens with repeats), share (of all tokens used)."""
    by = cut(used.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("repeats")).alias("used")))
    total = by.agg(F.sum("used").alias("n"))
    out = limits.join(by, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("records", "used")})
    return out.select("source", "weight", "size", "target", "short", "records", "used", (F.col("used") / total.scalar()).alias("share"))
