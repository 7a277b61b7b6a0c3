"""The most frequent values of columns with billions of rows, in bounded memory.

Each task keeps, per column, buckets of a few exact counters and an array of compact counters. A value that meets its own
counter adds to it; one that finds a full bucket votes against it and is counted in the array, until the votes outweigh
the bucket's weakest counter: then that value's count moves to the array and the newcomer takes its place. Tasks merge
by bucket: equal values add up, each bucket keeps its highest counts, the others join the array. A value's exact counters
bound its rows from below, and with its array counters from above; a value without an exact counter has at most the rows of
its array counters. Buckets and array grow with 1/share up to a fixed size, so a task's memory is bounded whatever the data;
values that the sketch cannot rule out are counted exactly, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import cut

BUCKETS, MOST_BUCKETS, SLOTS = 1 << 11, 1 << 17, 4
WIDTH, MOST_WIDTH = 1 << 14, 1 << 20
BUCKETS_A_SHARE, WIDTH_A_SHARE = 8, 64  # buckets and counters for every value that can reach the share
OUTVOTED = 8  # votes against, as a multiple of the weakest counter, that evict it
BUFFER_ROWS = 1 << 20
PLACE_BITS, BUCKET_BITS = (0, 40), 20  # where in a hash the positions in the array's rows and the bucket begin


def dimensions(share: float) -> tuple[int, int]:
    """Buckets and width, powers of two: at most MOST_BUCKETS x SLOTS x 16 + MOST_WIDTH x 16 bytes, 24 MB."""
    fit = lambda least, most, wanted: min(max(least, 1 << int(np.ceil(np.log2(max(wanted, 1))))), most)
    return fit(BUCKETS, MOST_BUCKETS, BUCKETS_A_SHARE / share), fit(WIDTH, MOST_WIDTH, WIDTH_A_SHARE / share)


class Sketch:
    """One column of one task. Values are 64-bit hashes; bucket and positions come from different bits of them."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, width: int = WIDTH):
        self.width = width
        self.key, self.n = np.zeros((buckets, slots), np.uint64), np.zeros((buckets, slots), np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros((2, width), np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Positions in the two rows of the array."""
        return np.stack([keys >> np.uint64(b) & np.uint64(self.width - 1) for b in PLACE_BITS]).astype(np.int64)

    def to_light(self, keys: np.ndarray, n: np.ndarray) -> None:
        for row, at in zip(self.light, self.places(keys)):
            np.add.at(row, at, n)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Distinct keys with their rows."""
        at = (keys >> np.uint64(BUCKET_BITS) & np.uint64(len(self.key) - 1)).astype(np.int64)
        hit = (self.key[at] == keys[:, None]) & (self.n[at] > 0)
        own = hit.any(1)
        self.n[at[own], hit[own].argmax(1)] += n[own]
        keys, n, at = keys[~own], n[~own], at[~own]
        order = np.lexsort((-n, at))
        keys, n, at = keys[order], n[order], at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(at)])
        # the newcomers of a bucket come one after another, those of all buckets side by side
        while len(first):
            b, k, c = at[first], keys[first], n[first]
            slot = self.n[b].argmin(1)
            weakest = self.n[b, slot]
            self.against[b] += np.where(weakest > 0, c, 0)
            take = (weakest == 0) | (self.against[b] >= OUTVOTED * weakest)
            out = take & (weakest > 0)
            self.to_light(self.key[b[out], slot[out]], weakest[out])
            self.to_light(k[~take], c[~take])
            self.key[b[take], slot[take]], self.n[b[take], slot[take]] = k[take], c[take]
            self.against[b[out]] = 0
            size -= 1
            first, size = first[size > 0] + 1, size[size > 0]

    def rows(self) -> tuple[np.ndarray, ...]:
        """heavy, place, key, light_1, light_2, n of the exact counters, then of the array's counters that are not zero."""
        b, s = np.nonzero(self.n)
        k = self.key[b, s]
        p1, p2 = self.places(k)
        r, at = np.nonzero(self.light)
        zero = np.zeros(len(r), np.int64)
        return tuple(np.concatenate(x) for x in ((np.ones(len(b), bool), np.zeros(len(r), bool)), (b, r * self.width + at), (k.view(np.int64), zero), (p1, zero), (p2 + self.width, zero), (self.n[b, s], self.light[r, at])))


_SCHEMA = "kind int, heavy boolean, place bigint, key bigint, light_1 bigint, light_2 bigint, n bigint"


def partials(df: DataFrame, values: Sequence[Column], buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """The rows of the sketches of every input partition; kind is the index in values. Nulls are not counted."""
    hashed = df.select(*(F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{i}") for i, v in enumerate(values)))
    columns = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Sketch(buckets, SLOTS, width) for _ in range(columns)]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            for i, s in enumerate(sketches):
                parts = [b.column(i).drop_null().to_numpy(zero_copy_only=False) for b in held]
                keys, n = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
                s.add(keys, n)
            held.clear()

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                flush()
                rows = 0
        if held:
            flush()
        for i, s in enumerate(sketches):
            cols = s.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), i, np.int32)), *map(pa.array, cols)], names=["kind", "heavy", "place", "key", "light_1", "light_2", "n"])

    return hashed.mapInArrow(run, _SCHEMA)


def merged(parts: DataFrame, width: int = WIDTH, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kind, key, at_least, at_most) of the values that kept a counter, at most buckets x slots per kind; (kind, place, n)
    of the array; (kind, total), the exact number of rows counted."""
    p = cut(parts.groupBy("kind", "heavy", "place", "key", "light_1", "light_2").agg(F.sum("n").alias("n")))
    heavy = p.where("heavy").withColumn("r", F.row_number().over(Window.partitionBy("kind", "place").orderBy(F.desc("n"), "key")))
    keep = heavy.where(F.col("r") <= slots)
    moved = heavy.where(F.col("r") > slots).select("kind", F.explode(F.array("light_1", "light_2")).alias("place"), "n")
    light = p.where("not heavy").select("kind", "place", "n").unionByName(moved).groupBy("kind", "place").agg(F.sum("n").alias("n"))
    at = lambda c: light.select(F.col("kind").alias("kind"), F.col("place").alias(c), F.col("n").alias(f"{c}_n"))
    known = keep.join(at("light_1"), ["kind", "light_1"], "left").join(at("light_2"), ["kind", "light_2"], "left")
    more = F.least(F.coalesce("light_1_n", F.lit(0)), F.coalesce("light_2_n", F.lit(0)))
    known = known.select("kind", "key", F.col("n").alias("at_least"), (F.col("n") + more).alias("at_most"))
    # each row is in one exact counter or in either row of the array
    total = p.where(F.col("heavy") | (F.col("place") < width)).groupBy("kind").agg(F.sum("n").alias("total"))
    return known, light, total


def frequent(df: DataFrame, values: Sequence[Column], names: Sequence[str], share: float) -> DataFrame:
    """kind STRING (of names), value STRING, rows, estimate, at_least, at_most, total: every value with at least this share of
    its column's rows that are not null, and some below it; total is the number of those rows.

    estimate, at_least and at_most are the sketch's; estimate is the middle of the bounds. rows is the exact count of one more
    pass over the column, which also turns hashes back into values. It counts the values that kept a counter and may reach
    the share (at most MOST_BUCKETS x SLOTS a column, broadcast), and any value both of whose array counters reach the share (at most
    1/share counters in either row of the array), so nothing that reaches the share is missed at any share.
    Ties are all kept; an empty table or a column of nulls gives no rows."""
    buckets, width = dimensions(share)
    known, light, total = merged(partials(df, values, buckets, width), width)
    total = F.broadcast(total)  # one row per kind
    asked = known.join(total, "kind").where(F.col("at_most") >= share * F.col("total")).select("kind", "key", "at_least", "at_most")
    hot = light.join(total, "kind").where(F.col("n") >= share * F.col("total"))
    beside = lambda i: F.broadcast(hot.where(F.expr(f"place div {width} = {i}")).select("kind", (F.col("place") - i * width).alias(f"place_{i}"), F.col("n").alias(f"most_{i}")))
    one = lambda i, v: F.struct(F.lit(i).alias("kind"), F.xxhash64(v).alias("key"), v.cast("string").alias("value"))
    rows = df.select(F.explode(F.array(*(one(i, v) for i, v in enumerate(values)))).alias("x")).select("x.*").where("value is not null")
    rows = rows.withColumns({f"place_{i}": F.shiftrightunsigned("key", b).bitwiseAND(F.lit(width - 1)) for i, b in enumerate(PLACE_BITS)})
    rows = rows.join(F.broadcast(asked), ["kind", "key"], "left").join(beside(0), ["kind", "place_0"], "left").join(beside(1), ["kind", "place_1"], "left")
    rows = rows.where("at_least is not null or (most_0 is not null and most_1 is not null)")
    low, high = F.coalesce("at_least", F.lit(0)), F.coalesce("at_most", F.least("most_0", "most_1"))
    exact = rows.groupBy("kind", "value", low.alias("at_least"), high.alias("at_most")).agg(F.count("*").alias("rows")).join(total, "kind")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1)
    return exact.select(name.alias("kind"), "value", "rows", F.expr("(at_least + at_most) div 2").alias("estimate"), "at_least", "at_most", "total")
