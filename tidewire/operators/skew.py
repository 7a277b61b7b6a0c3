"""Per-key results where a few keys hold most rows: rows are compressed to (key, value, frequency) before they meet by key.

The first aggregation combines on the map side, so a key of any number of rows leaves each task as at most one row per
distinct value; everything after works on weighted values and is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, freq (rows). Null keys and null values are values like any other."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("freq"))


def key_statistics(freq: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, rows, total, distinct_values, mode, mode_rows from value_frequencies.

    total is the sum of the non-null values (null if there are none); distinct_values and the mode leave out null; of
    equally frequent values the smallest is the mode. Empty input gives no rows.
    """
    v, n = F.col(value), F.col("freq")
    best = F.max(F.when(v.isNotNull(), F.struct(n.alias("n"), (-v).alias("v"))))
    out = freq.groupBy(*keys).agg(F.sum("freq").alias("rows"), F.sum(v * n).alias("total"), F.count(v).alias("distinct_values"), best.alias("best"))
    return out.select(*keys, "rows", "total", "distinct_values", (-F.col("best.v")).alias("mode"), F.col("best.n").alias("mode_rows"))


def key_percentiles(freq: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], low_bits: int = 10) -> DataFrame:
    """keys, fraction, value: the smallest value that at least ceil(fraction * rows) of the key's non-null rows do not exceed.

    Integer values. Weights are first summed by the value's upper bits, cumulated per key, and only the one block that
    holds a percentile is cumulated value by value; no task holds all values of a key.
    """
    f = freq.where(F.col(value).isNotNull()).withColumn("block", F.shiftright(F.col(value), low_bits))
    blocks = f.groupBy(*keys, "block").agg(F.sum("freq").alias("n"))
    w = Window.partitionBy(*keys).orderBy("block")
    blocks = blocks.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    wanted = blocks.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions))))
    wanted = wanted.withColumn("rank", F.greatest(F.ceil(F.col("fraction") * F.col("all")), F.lit(1)))
    hit = wanted.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("block").alias("__block"), "fraction", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("block") == F.col("__block")]
    # only values of blocks that hold a percentile are cumulated, once for each percentile of theirs
    fine = f.join(hit, cond).select(*keys, "block", value, "freq", "fraction", "rank")
    fine = fine.withColumn("upto", F.sum("freq").over(Window.partitionBy(*keys, "block", "fraction").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return fine.where("upto >= rank").groupBy(*keys, "fraction").agg(F.min(value).alias(value))


def hot_keys(freq: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """keys, rows of the keys with at least this share of all rows. The threshold is a scalar subquery over the compressed rows."""
    by = freq.groupBy(*keys).agg(F.sum("freq").alias("rows"))
    total = freq.agg(F.sum("freq").alias("n"))
    return by.where(F.col("rows") >= share * total.scalar())
