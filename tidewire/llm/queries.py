"""Queries of the training-data problems over the tables of a folder, and SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.addresses import canonical_addr, unsigned_port
from tidewire.functions.times import epoch_us, floor_div
from tidewire.llm import heavylight, mixture, setsketch, subjects, tokens
from tidewire.plans.problems import CANON
from tidewire.sources.tables import table

DAY_US = 86400 * 1_000_000
GROUPS = ("bucket", "fixture", "proto")
SETS = (GROUPS, ("bucket", "fixture"), ("bucket", "proto"), ("bucket",))
LEAST_ROWS, LEAST_RATIO = 400, 0.5
SHARE = 0.01


def _registers(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "stream_endpoint")
    e = e.select(floor_div(epoch_us(e, "ts"), F.lit(DAY_US)).alias("bucket"), "fixture", F.col("proto").cast("string").alias("proto"), canonical_addr(F.col("addr"), F.col("v6")).alias("a"))
    return setsketch.registers(e.where("bucket is not null"), GROUPS, F.col("a"))


def p1_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, fixture, proto, rows, estimate, error of every group and combination of groups; grouping_set is 0 where all
    three are grouped by, and tells a fixture named * from all fixtures."""
    return setsketch.estimates(setsketch.rolled(_registers(spark, folder), GROUPS, SETS), ("grouping_set", *GROUPS))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    d = p1_distinct(spark, folder)
    return d.where((F.col("rows") >= LEAST_ROWS) & (F.col("estimate") >= LEAST_RATIO * F.col("rows"))).select(*GROUPS)


def p1_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that a fixture saw on a day and on the next: sizes, union, intersection and Jaccard with their errors."""
    r = setsketch.merged(_registers(spark, folder), ("bucket", "fixture")).drop("rows")
    a = r.withColumnRenamed("level", "level_1")
    b = r.select((F.col("bucket") - 1).alias("bucket"), "fixture", "register", F.col("level").alias("level_2"))
    both = a.join(b, ["bucket", "fixture", "register"], "full_outer")
    o = setsketch.overlaps(both, ("bucket", "fixture"))
    return o.where("size_1 > 0.5 and size_2 > 0.5")


def p2_frequent(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "stream_endpoint")
    return heavylight.frequent(e, [F.hex(canonical_addr(F.col("addr"), F.col("v6"))), unsigned_port(F.col("port"))], ["addr", "port"], SHARE)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    f = p2_frequent(spark, folder)
    return f.where(F.col("rows") >= SHARE * F.col("total")).select("kind", F.col("value").alias("item"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), "text", ["doc_id"])


def p6_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids, offsets: where in the text's UTF-8 bytes each token begins."""
    return tokens.encode(table(spark, folder, "documents"), "text", ["doc_id"], offsets=True)


def _limits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    size = mixture.sizes(table(spark, folder, "documents"))
    return size, mixture.thresholds(size, mixture.plan(mixture.histogram(size), table(spark, folder, "mix_target")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources whose target no hash threshold meets within their repeats."""
    hist = mixture.histogram(mixture.sizes(table(spark, folder, "documents"), written=False))
    return mixture.plan(hist, table(spark, folder, "mix_target")).where("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, tokens, repeats of the documents in the mixture."""
    return mixture.mixed(*_limits(spark, folder)).select("doc_id", "source", "tokens", "repeats")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    size, limits = _limits(spark, folder)
    return mixture.shares(mixture.mixed(size, limits), limits)


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, spoken, subjects, shares of every document."""
    docs = table(spark, folder, "documents")
    return subjects.classify(docs, subjects.fitted(docs, table(spark, folder, "subject_label"), table(spark, folder, "subject_area")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_subjects(spark, folder).select("doc_id", F.explode("subjects").alias("subject"))


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(p8_subjects(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_distinct, p1_overlap, p2_found, p2_frequent, p6_ids, p6_offsets, p7_found, p7_mix, p7_shares, p8_found, p8_subjects, p8_composition)}

_PORT = "CASE WHEN port < 0 THEN port + 65536 ELSE port END"
ORACLE = {
    "p1_found": f"""
WITH e AS (SELECT epoch_us(ts) // {DAY_US} AS bucket, fixture, CAST(proto AS VARCHAR) AS proto, {CANON.format(a='addr', v='v6')} AS a FROM stream_endpoint WHERE ts IS NOT NULL AND addr IS NOT NULL)
SELECT bucket, CASE WHEN grouping(fixture) = 1 THEN '*' ELSE fixture END AS fixture, CASE WHEN grouping(proto) = 1 THEN '*' ELSE proto END AS proto
FROM e GROUP BY GROUPING SETS ((bucket, fixture, proto), (bucket, fixture), (bucket, proto), (bucket))
HAVING count(*) >= {LEAST_ROWS} AND count(DISTINCT a) >= {LEAST_RATIO} * count(*)""",
    "p2_found": f"""
SELECT 'addr' AS kind, a AS item FROM (SELECT {CANON.format(a='addr', v='v6')} AS a FROM stream_endpoint WHERE addr IS NOT NULL) GROUP BY a HAVING count(*) >= {SHARE} * (SELECT count(addr) FROM stream_endpoint)
UNION ALL
SELECT 'port', CAST(p AS VARCHAR) FROM (SELECT {_PORT} AS p FROM stream_endpoint WHERE port IS NOT NULL) GROUP BY p HAVING count(*) >= {SHARE} * (SELECT count(port) FROM stream_endpoint)""",
}
