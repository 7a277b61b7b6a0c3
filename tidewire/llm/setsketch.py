"""Distinct counts over huge identifier sets by registers on a logarithmic scale.

An identifier's hash names one of m registers and, by a uniform variate u, the level 1 + floor(-log_base(u)); a register
keeps the highest level. A set's registers are rows (group, register, level): partial results merge by maximum, coarser
groups are maxima over finer ones, and no group ever holds more than m rows. With identifiers arriving as a Poisson
stream of rate r per register, P(level <= k) = exp(-r base^-k) holds exactly, empty registers (k = 0) included; all
estimates maximise that likelihood, of one set or of two sets jointly. The smaller the base, the more two sets' registers
tell about their intersection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_M = 10
BASE = 1.1


def relative_error(log_m: int = LOG_M, base: float = BASE) -> float:
    """Standard error of a large set's estimate, relative to it."""
    return float(np.sqrt(((base + 1) / (base - 1) * np.log(base) - 1) / 2**log_m))


def _levels(log_m: int, base: float) -> int:
    """The highest level that 64 - log_m bits can give."""
    return int((65 - log_m) * np.log(2) / np.log(base)) + 2


def registers(df: DataFrame, groups: Sequence[str], item: Column, log_m: int = LOG_M, base: float = BASE) -> DataFrame:
    """groups, register, level, rows: the registers of each group's distinct items that are not null. rows counts the
    input rows behind each register. Null groups are groups. Empty input gives no rows."""
    h = F.xxhash64(item)
    u = (F.shiftrightunsigned(h, log_m).cast("double") + 0.5) / float(2 ** (64 - log_m))
    level = (1 + F.floor(-F.log(u) / float(np.log(base)))).cast("smallint")
    hashed = df.where(item.isNotNull()).select(*groups, h.bitwiseAND(F.lit(2**log_m - 1)).cast("int").alias("register"), level.alias("level"))
    return hashed.groupBy(*groups, "register").agg(F.max("level").alias("level"), F.count("*").alias("rows"))


def merged(regs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Registers of unions: rows of equal groups and register join by maximum. Also for registers from several writers."""
    return regs.groupBy(*groups, "register").agg(F.max("level").alias("level"), F.sum("rows").alias("rows"))


def rolled(regs: DataFrame, groups: Sequence[str], sets: Sequence[Sequence[str]], other: str = "*") -> DataFrame:
    """Registers of each grouping set (its index is grouping_set), from those of the finest groups; string columns not
    grouped by are `other`. A group that is itself named `other` differs from the union by its grouping_set."""
    one = lambda k, s: F.struct(F.lit(k).alias("grouping_set"), *(F.col(g) if g in s else F.lit(other).alias(g) for g in groups))
    out = regs.select("register", "level", "rows", F.explode(F.array(*(one(k, s) for k, s in enumerate(sets)))).alias("g"))
    return merged(out.select("g.*", "register", "level", "rows"), ("grouping_set", *groups))


def _rates(hist: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates that maximise the likelihood of level counts (sets x levels), and their standard errors."""
    d = z[:-1] - z[1:]  # of level k >= 1
    lo, hi = np.full(len(hist), -40.0), np.full(len(hist), np.log(2.0) * 70)
    for _ in range(70):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            score = -hist[:, 0] * z[0] + (hist[:, 1:] * (d / np.expm1(np.exp(mid)[:, None] * d) - z[1:])).sum(1)
        lo, hi = np.where(score > 0, mid, lo), np.where(score > 0, hi, mid)
    rate = np.exp((lo + hi) / 2)
    x = np.minimum(rate[:, None] * d / 2, 300)
    info = (hist[:, 1:] * (d / 2 / np.sinh(np.maximum(x, 1e-12))) ** 2).sum(1)
    return rate, 1 / np.sqrt(np.maximum(info, 1e-300))


def estimates(regs: DataFrame, groups: Sequence[str], log_m: int = LOG_M, base: float = BASE) -> DataFrame:
    """groups, rows, estimate DOUBLE, error DOUBLE (one standard error): a group's number of distinct items."""
    m, z = 2**log_m, float(base) ** -np.arange(_levels(log_m, base) + 1.0)
    per = regs.groupBy(*groups, "level").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    per = per.groupBy(*groups).agg(F.sum("rows").alias("rows"), F.collect_list(F.struct("level", "n")).alias("__levels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                hist = np.zeros((batch.num_rows, len(z)))
                for i, levels in enumerate(batch.column(len(groups) + 1).to_pylist()):
                    for x in levels:
                        hist[i, x["level"]] = x["n"]
                hist[:, 0] = m - hist[:, 1:].sum(1)
                rate, error = _rates(hist, z)
                error = np.sqrt(np.maximum(error**2 - rate / m, 0))  # the set's size is fixed: it isn't the Poisson number drawn
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(groups) + 1)), pa.array(m * rate), pa.array(m * error)], names=schema.names)

    schema = T.StructType([*(per.schema[g] for g in groups), T.StructField("rows", T.LongType()), T.StructField("estimate", T.DoubleType()), T.StructField("error", T.DoubleType())])
    return per.mapInArrow(run, schema)


def _tables(a: np.ndarray, b: np.ndarray, x: np.ndarray, z: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(levels i and j) of a register in two sets and its gradient, for rates a, b, x of the items that only the first, only
    the second and both sets hold; i, j: levels, of any shape; the gradient's last axis is (a, b, x).

    The sets' levels are max(A, X) and max(B, X) of independent levels. Where i < j, B made the second level and the first is
    that of rate a + x; where i = j, X made both, or X stayed below and A and B made them."""
    below = np.r_[np.inf, z[:-1]]

    def step(rate, k):
        """P(level = k) of one rate, and its derivative by the rate."""
        hi, lo = np.exp(-rate * z[k]), np.where(k > 0, np.exp(-rate * np.where(k > 0, below[k], 0)), 0.0)
        p = np.where(k > 0, hi * -np.expm1(-rate * np.where(k > 0, below[k] - z[k], 1.0)), hi)
        return p, -z[k] * hi + np.where(k > 0, below[k], 0) * lo

    def upto(rate, k):
        """P(level < k) and its derivative."""
        lo = np.where(k > 0, np.exp(-rate * np.where(k > 0, below[k], 0)), 0.0)
        return lo, -np.where(k > 0, below[k], 0) * lo

    (pa_, da), (pb, db), (px, dx) = (step(r, k) for r, k in ((a, i), (b, j), (x, i)))
    (pu, du), (pv, dv) = step(a + x, i), step(b + x, j)
    fa, fda = np.exp(-a * z[i]), -z[i] * np.exp(-a * z[i])
    fb, fdb = np.exp(-b * z[j]), -z[j] * np.exp(-b * z[j])
    lx, dlx = upto(x, i)
    p = np.where(i < j, pu * pb, np.where(i > j, pv * pa_, fa * fb * px + lx * pa_ * pb))
    ga = np.where(i < j, du * pb, np.where(i > j, pv * da, fda * fb * px + lx * da * pb))
    gb = np.where(i < j, pu * db, np.where(i > j, dv * pa_, fa * fdb * px + lx * pa_ * db))
    gx = np.where(i < j, du * pb, np.where(i > j, dv * pa_, fa * fb * dx + dlx * pa_ * pb))
    return np.maximum(p, 1e-300), np.stack([ga, gb, gx], -1)


@dataclass
class Joint:
    """Estimates of two sets and their standard errors."""

    only_first: float
    only_second: float
    both: float
    covariance: np.ndarray  # of the three

    def error(self, gradient: Sequence[float]) -> float:
        g = np.array(gradient, float)
        return float(np.sqrt(max(g @ self.covariance @ g, 0.0)))


def joint(i: np.ndarray, j: np.ndarray, n: np.ndarray, m: int, z: np.ndarray) -> Joint:
    """The three sizes (only the first, only the second, both) that together maximise the likelihood of two sets' registers:
    n registers have the levels i and j. Covariances come from the expected information of all pairs of levels, with all three
    sizes unknown."""
    i, j, n = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(n, float)
    hist = np.zeros((2, len(z)))
    np.add.at(hist[0], i, n)
    np.add.at(hist[1], j, n)
    r1, r2 = np.maximum(_rates(hist, z)[0], 1e-12)
    least = 1e-9 * max(r1, r2, 1e-6)

    def value(r: np.ndarray) -> float:
        return float((n * np.log(_tables(*r, z, i, j)[0])).sum())

    # to begin with, the best of some shares of the smaller set
    starts = [np.maximum([r1 - f * min(r1, r2), r2 - f * min(r1, r2), f * min(r1, r2)], least) for f in (0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99)]
    at = max(starts, key=value)
    best = value(at)
    for _ in range(60):
        p, g = _tables(*at, z, i, j)
        score = (n[:, None] * g / p[:, None]).sum(0)
        free = (at > least * 1.5) | (score > 0)  # sizes at zero that want to be smaller stay there
        info = np.einsum("k,ka,kb->ab", n / p**2, g, g)
        step = np.zeros(3)
        if free.any():
            own = info[np.ix_(free, free)]
            step[free] = np.linalg.solve(own + 1e-12 * np.diag(np.diag(own)) + 1e-300 * np.eye(free.sum()), score[free])
        size, moved = 1.0, False
        while size > 1e-6:
            new = np.maximum(at + size * step, least)
            got = value(new)
            if got > best:
                moved = got - best > 1e-10 * abs(best)
                at, best = new, got
                break
            size /= 2
        if not moved:
            break
    top = min(int(np.log(max(at.sum(), 1e-3) * 1e9) / np.log(z[0] / z[1])) + 2, len(z))
    every = np.arange(max(top, 2))
    p, g = _tables(*at, z, every[:, None], every[None, :])
    info = m * np.einsum("ijk,ijl->kl", g / p[..., None], g)
    scale = 1 / np.sqrt(np.maximum(np.diag(info), 1e-300))
    cov = np.linalg.pinv(info * scale[:, None] * scale[None, :], rcond=1e-12, hermitian=True) * scale[:, None] * scale[None, :]
    cov = m * m * cov - np.diag(m * at)  # the sizes are fixed, not the Poisson numbers that the rates stand for
    at = np.where(at <= least * 1.5, 0.0, at)
    return Joint(*(m * at).tolist(), cov)


OVERLAP = ("size_1", "size_1_error", "size_2", "size_2_error", "union_size", "union_error", "intersection", "intersection_error", "jaccard", "jaccard_error")


def overlaps(pairs: DataFrame, keys: Sequence[str], log_m: int = LOG_M, base: float = BASE) -> DataFrame:
    """keys and OVERLAP, all DOUBLE: sizes of two sets, their union, intersection and Jaccard index, each with one standard
    error.

    pairs: keys, register, level_1, level_2 (null: the register is empty). What only the first, only the second and both sets
    hold is estimated together, so each error counts that the other sizes are unknown, too. Two empty sets have sizes and
    Jaccard index 0."""
    m, top = 2**log_m, _levels(log_m, base)
    z = float(base) ** -np.arange(top + 1.0)
    a, b = F.coalesce("level_1", F.lit(0)).cast("int"), F.coalesce("level_2", F.lit(0)).cast("int")
    per = pairs.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))
    per = per.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "n")).alias("__levels"))  # at most m cells

    def row(levels: list[dict]) -> tuple:
        cells = [(x["a"], x["b"], x["n"]) for x in levels if x["a"] or x["b"]]
        if not cells:
            return (0.0,) * len(OVERLAP)
        cells.append((0, 0, m - sum(n for _, _, n in cells)))
        e = joint(*zip(*cells), m, z)
        f, s, x = e.only_first, e.only_second, e.both
        u = f + s + x
        return (f + x, e.error((1, 0, 1)), s + x, e.error((0, 1, 1)), u, e.error((1, 1, 1)), x, e.error((0, 0, 1)), x / u, e.error((-x / u**2, -x / u**2, (f + s) / u**2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(row, batch.column(len(keys)).to_pylist()))) or [()] * len(OVERLAP)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *(pa.array(c, pa.float64()) for c in cols)], names=schema.names)

    schema = T.StructType([*(per.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in OVERLAP)])
    return per.mapInArrow(run, schema)
