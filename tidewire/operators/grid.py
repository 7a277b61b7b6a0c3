"""Irregular readings onto a regular grid.

Each task combines the readings it holds by line, time shard and instant, so what is shuffled are a shard's distinct
instants, once. A shard also gets the readings of a few buckets on either side of it (the halo): a gap of more than max_gap
buckets ends a segment, so no reading farther away can shape a gap of the shard, and every gap is filled by the monotone
cubic through the readings (Fritsch-Carlson slopes, the interior slopes weighted by the interval lengths) exactly as over
the whole line. Every shard of every line has a row of its own in the shuffle, which gives the buckets that nobody read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.times import epoch_us

LINE = ("graph_id", "line_no")
STATUS = ("absent", "read", "filled")
HELD = 1 << 19  # readings and buckets worked on side by side
SHARDS_A_ROW = 4096
READINGS_A_ROW = 512  # longer fragments and shards come in several rows, as Arrow batches are counted in rows


def grids(graphs: DataFrame) -> DataFrame:
    """One row per usable graph: graph_id, start_us, step_us, buckets, n_lines. Of rows that share a graph_id the largest
    (buckets, start, interval, lines) counts; graphs without a start, buckets or a positive interval have no grid."""
    step = F.round(F.col("graph_interval") * 1e6).cast("bigint")
    g = graphs.select("graph_id", F.struct(F.col("buckets").cast("bigint").alias("buckets"), epoch_us(graphs, "graph_start").alias("start_us"), step.alias("step_us"), F.size("series").cast("bigint").alias("n_lines")).alias("g"))
    g = g.where("graph_id is not null and g.buckets > 0 and g.start_us is not null and g.step_us > 0 and g.n_lines > 0")
    return g.groupBy("graph_id").agg(F.max("g").alias("g")).select("graph_id", "g.*")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _lists(column: pa.ListArray, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths; null lists are empty, null values NaN."""
    sizes = column.value_lengths().fill_null(0)
    return _numbers(column.flatten().cast(kind)), _numbers(sizes).astype(np.int64)


def _expand(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each of sum(sizes) rows, and the row's place within its owner."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _combined(batch: pa.RecordBatch, shard: int, halo: int) -> pa.RecordBatch:
    """A row or more per line and shard of the batch: its instants with the sums and numbers of their readings.

    batch: graph_id, line_no, at (us since the graph's start), step_us, buckets, points."""
    graph = batch.column(0).dictionary_encode()
    key, line, at, step, buckets = _numbers(graph.indices), *(_numbers(batch.column(i)) for i in range(1, 5))
    v, sizes = _lists(batch.column(5), pa.float64())
    row, i = _expand(sizes)
    b = np.floor_divide(at, step)[row] + i
    use = ~np.isnan(v) & (b >= -halo) & (b < buckets[row] + halo)
    row, i, b, v = row[use], i[use], b[use], v[use]
    t = at[row] + i * step[row]
    last = (buckets[row] - 1) // shard
    low, high = (np.clip(np.floor_divide(b + side, shard), 0, last) for side in (-halo, halo))
    of, k = _expand(high - low + 1)
    row, t, v, s = row[of], t[of], v[of], low[of] + k
    order = np.lexsort((t, s, line[row], key[row]))
    row, t, v, s = row[order], t[order], v[order], s[order]
    first = _runs(key[row], line[row], s, t)
    n = np.diff(np.r_[first, len(t)])
    v = np.add.reduceat(v, first) if len(first) else v
    row, t, s = row[first], t[first], s[first]
    head = _runs(key[row], line[row], s)
    group, place = _expand(np.diff(np.r_[head, len(t)]))
    head = _runs(group, place // READINGS_A_ROW)
    bounds = pa.array(np.r_[head, len(t)].astype(np.int32))
    own = row[head]
    cols = [graph.dictionary.take(pa.array(key[own])), pa.array(line[own]), pa.array(s[head]), pa.array(step[own]), pa.array(buckets[own])]
    return pa.RecordBatch.from_arrays([*cols, *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (t, v, n))], names=_SHARD)


_SHARD = ["graph_id", "line_no", "shard", "step_us", "buckets", "t", "total", "n"]


def _inner(h0: np.ndarray, h1: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Slope at the reading between the intervals 0 and 1: zero at an extremum, else the weighted harmonic mean."""
    return np.where(s0 * s1 <= 0, 0.0, 3 * (h0 + h1) / ((2 * h1 + h0) / s0 + (h1 + 2 * h0) / s1))


def _edge(h0: np.ndarray, h1: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Slope at the outer end of interval 0, with 1 the next one inwards."""
    d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
    capped = np.where((np.sign(s0) != np.sign(s1)) & (np.abs(d) > 3 * np.abs(s0)), 3 * s0, d)
    return np.where(np.sign(d) != np.sign(s0), 0.0, capped)


def _slopes(h: np.ndarray, s: np.ndarray, near: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes at the left and right reading of the intervals gap; h, s, near: of every interval between two instants."""
    one = np.r_[h, 1.0, 1.0], np.r_[s, 0.0, 0.0], np.r_[near, False, False]
    (h1, s1, _), (h0, s0, has0), (h2, s2, has2) = (tuple(x[gap + k] for x in one) for k in (0, -1, 1))
    left = np.where(has0, _inner(h0, h1, s0, s1), np.where(has2, _edge(h1, h2, s1, s2), s1))
    right = np.where(has2, _inner(h1, h2, s1, s2), np.where(has0, _edge(h1, h0, s1, s0), s1))
    return left, right


def _joined(shards: pa.Table) -> pa.Table:
    """The rows of one shard as one row."""
    t, total, n = (_numbers(shards.column(i).combine_chunks().flatten()) for i in (5, 6, 7))
    order = np.argsort(t, kind="stable")
    first = _runs(t[order])
    if not len(first):
        return shards.slice(0, 1)
    lists = (t[order][first], np.add.reduceat(total[order], first), np.add.reduceat(n[order], first))
    bounds = pa.array(np.array([0, len(first)], np.int32))
    return pa.table([*(shards.column(i).slice(0, 1) for i in range(5)), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists)], names=_SHARD)


@np.errstate(all="ignore")
def _filled(shards: pa.Table, shard: int, max_gap: int) -> pa.RecordBatch:
    """A row for every bucket of the shards; rows of one shard stand together."""
    col = lambda i: shards.column(i).combine_chunks()
    graph = col(0).dictionary_encode()
    key, line, s, step, buckets = _numbers(graph.indices), *(_numbers(col(i)) for i in range(1, 5))
    head = _runs(key, line, s)
    group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(key)]))
    key, line, step, low = key[head], line[head], step[head], s[head] * shard
    size = np.minimum(low + shard, buckets[head]) - low
    base = np.cumsum(size) - size
    t, sizes = _lists(col(5), pa.int64())
    total, n = _lists(col(6), pa.float64())[0], _lists(col(7), pa.int64())[0]
    g = np.repeat(group, sizes)
    order = np.lexsort((t, g))
    g, t, total, n = g[order], t[order], total[order], n[order]
    first = _runs(g, t)
    g, t = g[first], t[first]
    v = np.add.reduceat(total, first) / np.add.reduceat(n, first) if len(first) else total
    b = np.floor_divide(t, step[g])

    every = int(size.sum())
    inside = (b >= low[g]) & (b < low[g] + size[g])
    at = base[g[inside]] + b[inside] - low[g[inside]]
    count = np.bincount(at, minlength=every)
    value = np.bincount(at, v[inside], every) / count
    status = (count > 0).astype(np.int8)

    between = np.diff(b) - 1 if len(b) else np.zeros(0, np.int64)
    near = (np.diff(g) == 0) & (between <= max_gap) if len(g) else np.zeros(0, bool)
    h = np.diff(t) / 1e6
    gap = np.flatnonzero(near & (between > 0))
    left, right = _slopes(h, np.diff(v) / h, near, gap)
    k, i = _expand(between[gap])
    q = gap[k]
    own, hole = g[q], b[q] + 1 + i
    keep = (hole >= low[own]) & (hole < low[own] + size[own])
    k, q, own, hole = k[keep], q[keep], own[keep], hole[keep]
    u = (hole * step[own] + step[own] // 2 - t[q]) / 1e6 / h[q]
    curve = v[q] * (1 + 2 * u) * (1 - u) ** 2 + v[q + 1] * u * u * (3 - 2 * u) + h[q] * u * (1 - u) * (left[k] * (1 - u) - right[k] * u)
    sure = np.isfinite(curve)
    place = (base[own] + hole - low[own])[sure]
    value[place], status[place] = curve[sure], 2

    of, i = _expand(size)
    cols = [graph.dictionary.take(pa.array(key[of])), pa.array(line[of]), pa.array(low[of] + i), pa.array(count), pa.array(value, mask=status == 0), pa.array(STATUS).take(pa.array(status))]
    return pa.RecordBatch.from_arrays(cols, names=["graph_id", "line_no", "bucket", "n_readings", "value", "status"])


def regular_series(lines: DataFrame, graphs: DataFrame, max_gap: int = 5, shard_buckets: int = 2048) -> DataFrame:
    """graph_id, line_no, bucket, n_readings, value, status: one row for each bucket 0 .. buckets-1 of each line.

    status `read`: the bucket has readings (n_readings instants; several readings of one instant count as their mean) and
    value is the mean of the instants. `filled`: no reading, but the gap between the buckets around it spans at most max_gap
    buckets; value is the cubic through the readings at the middle of the bucket. `absent`: value is null (a longer gap,
    before the first or after the last reading, no readings, infinite neighbours).
    Readings outside the grid are no rows but do shape and bound the gaps at its ends. Readings that are null or NaN,
    fragments without ts or points, and lines outside the graph's series are no readings. Empty tables give no rows; extra
    columns are ignored; null graph_id or line_no are no line.
    """
    grid, halo = grids(graphs), 2 * max_gap + 2
    f = lines.select("graph_id", F.col("line_no").cast("bigint").alias("line_no"), epoch_us(lines, "ts").alias("ts_us"), "points").where("ts_us is not null and points is not null")
    f = f.join(grid, "graph_id").where("line_no >= 0 and line_no < n_lines")
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.size("points") - 1, F.lit(0)), F.lit(READINGS_A_ROW)))
    f = f.select(*LINE, (F.col("ts_us") - F.col("start_us")).alias("at"), "step_us", "buckets", "points", part.alias("off"))
    f = f.select(*LINE, (F.col("at") + F.col("off") * F.col("step_us")).alias("at"), "step_us", "buckets", F.slice("points", F.col("off") + 1, F.lit(READINGS_A_ROW)).alias("points"))
    key = grid.schema["graph_id"]
    long, many = T.LongType(), lambda k: T.ArrayType(k)
    shards = T.StructType([key, *(T.StructField(c, long) for c in _SHARD[1:5]), T.StructField("t", many(long)), T.StructField("total", many(T.DoubleType())), T.StructField("n", many(long))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _combined(b, shard_buckets, halo)

    zero = F.lit(0).cast("bigint")
    top = F.call_function("div", F.col("buckets") - 1, F.lit(shard_buckets).cast("bigint"))
    every = grid.select("graph_id", F.explode(F.sequence(zero, F.col("n_lines") - 1)).alias("line_no"), "step_us", "buckets", top.alias("top"))
    every = every.select("*", F.explode(F.sequence(zero, F.col("top"), F.lit(SHARDS_A_ROW).cast("bigint"))).alias("low"))
    every = every.select("*", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + SHARDS_A_ROW - 1, F.col("top")))).alias("shard"))
    every = every.select(*LINE, "shard", "step_us", "buckets", *(F.array().cast(shards[c].dataType).alias(c) for c in _SHARD[5:]))
    parts = f.mapInArrow(combine, shards).unionByName(every)
    parts = parts.repartition(*LINE, "shard").sortWithinPartitions(*LINE, "shard")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, HELD
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                size += len(part.column(5).flatten()) + shard_buckets * part.num_rows
                if size >= most:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    codes = [whole.column(i).combine_chunks().dictionary_encode().indices.to_numpy() for i in range(3)]
                    cut = int(_runs(*codes)[-1])
                    if cut:
                        yield _filled(whole.slice(0, cut), shard_buckets, max_gap)
                    held = _joined(whole.slice(cut)).to_batches()  # a shard's distinct instants are all that is held
                    size = sum(len(b.column(5).flatten()) + shard_buckets * b.num_rows for b in held)
                    most = max(HELD, 2 * size)
        if held:
            yield _filled(pa.Table.from_batches(held), shard_buckets, max_gap)

    out = T.StructType([key, T.StructField("line_no", long), T.StructField("bucket", long), T.StructField("n_readings", long), T.StructField("value", T.DoubleType()), T.StructField("status", T.StringType())])
    return parts.mapInArrow(fill, out)
