"""Sessions by inactivity gaps, as a sweep line.

Each event adds one at its time and takes one away at its time plus the gap; where the running sum falls to zero the
session ends. Events are swept in time shards first, and the shards' sessions, as intervals, once more per key: a key of
any number of rows is thus spread over its shards, and the second sweep sees at most a row per shard and gap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import floor_div


def _sweep(intervals: DataFrame, part: Sequence[str], gap_us: int) -> DataFrame:
    """intervals: part, start_us, end_us, rows, frames. Adds session: how often the sum was back at zero before the row."""
    plus = F.struct(F.col("start_us").alias("at"), F.lit(1).alias("delta"))
    minus = F.struct((F.col("end_us") + F.lit(gap_us)).alias("at"), F.lit(-1).alias("delta"))
    d = intervals.select("*", F.explode(F.array(plus, minus)).alias("d"))
    # at equal times the additions come first: a step of exactly the gap keeps the session open
    w = Window.partitionBy(*part).orderBy("d.at", F.desc("d.delta")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("open", F.sum("d.delta").over(w))
    d = d.withColumn("closed", F.sum(F.when(F.col("open") == 0, 1).otherwise(0)).over(w))
    return d.where("d.delta = 1").withColumn("session", F.col("closed")).drop("d", "open", "closed")


def sessions(events: DataFrame, keys: Sequence[str], time_us: str, item: str, gap_us: int, shard_us: int = 900 * 1_000_000, once_a_session: bool = False) -> DataFrame:
    """keys, start_us, end_us, duration_us, rows, items: the longest runs of a key's events in which no step exceeds gap_us.

    events: keys, time_us BIGINT, item (the distinct thing counted; an item repeated at one time counts once, and with
    once_a_session also one repeated at several times of a session; a null item counts as no item). Rows with a null time are left out; null keys are keys. Empty input gives no rows. Columns named
    prev, at, s, again, n, over, shard, session, rows, frames are not read from the input.
    """
    e = events.select(*keys, F.col(time_us).alias("start_us"), F.col(item).alias("item")).where("start_us is not null")
    e = e.withColumn("shard", floor_div(F.col("start_us"), F.lit(shard_us).cast("bigint")))
    counts = F.count("item")
    if once_a_session:
        # the time before of an item: up to the gap it is surely of the same session, else its session is looked up
        spread = [*keys, "item", F.when(F.col("item").isNull(), F.col("shard"))]
        e = e.repartition(*spread).groupBy(*keys, "shard", "start_us", "item").agg(F.count("*").alias("rows"))
        e = e.withColumn("prev", F.when(F.col("item").isNotNull(), F.lag("start_us").over(Window.partitionBy(*spread).orderBy("start_us"))))
        pairs = e.where(F.col("start_us") - F.col("prev") > gap_us).groupBy(*keys, "prev", "start_us").agg(F.count("*").alias("n"))
        counts = F.count(F.when(F.col("prev").isNull() | (F.col("start_us") - F.col("prev") > gap_us), F.col("item")))
        e = e.repartition(*keys, "shard")
    else:
        e = e.repartition(*keys, "shard").groupBy(*keys, "shard", "start_us", "item").agg(F.count("*").alias("rows"))
    e = e.groupBy(*keys, "shard", "start_us").agg(F.sum("rows").alias("rows"), counts.alias("frames")).withColumn("end_us", F.col("start_us"))
    total = [F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("rows").alias("rows"), F.sum("frames").alias("frames")]
    part = _sweep(e, [*keys, "shard"], gap_us).groupBy(*keys, "shard", "session").agg(*total).drop("session")
    whole = _sweep(part, keys, gap_us).groupBy(*keys, "session").agg(*total)
    if once_a_session:
        both = whole.select(*keys, F.col("start_us").alias("at"), F.struct("start_us", "end_us", "rows", "frames").alias("s"), F.lit(None).cast("bigint").alias("again"), F.lit(0).cast("bigint").alias("n"))
        both = both.unionByName(pairs.select(*keys, F.col("prev").alias("at"), F.col("start_us").alias("again"), "n"), allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy("at", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("s", F.last("s", ignorenulls=True).over(w))
        over = F.sum(F.when(F.col("again") <= F.col("s.end_us"), F.col("n")).otherwise(0)).alias("over")
        whole = both.groupBy(*keys, "s").agg(over).select(*keys, "s.start_us", "s.end_us", "s.rows", (F.col("s.frames") - F.col("over")).alias("frames"))
    return whole.select(*keys, "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "rows", F.col("frames").alias("items"))
