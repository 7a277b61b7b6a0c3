"""Queries of the general data problems over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.addresses import KEY, stream_key
from tidewire.functions.times import epoch_us
from tidewire.operators import grid, sessions, skew
from tidewire.sources.tables import table

GAP_US = 300 * 1_000_000
HOT_SHARE = 0.02
FRACTIONS = (0.5, 0.9, 0.99)


def _series(spark: SparkSession, folder: str) -> DataFrame:
    return grid.regular_series(table(spark, folder, "io_line"), table(spark, folder, "io_graph"))


def p3_series(spark: SparkSession, folder: str) -> DataFrame:
    """Every bucket with its value, to six digits, and status."""
    return _series(spark, folder).withColumn("value", F.round("value", 6) + 0.0)  # no negative zero


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The buckets whose value was not read but filled or is absent."""
    return _series(spark, folder).where("status <> 'read'").select("graph_id", "line_no", "bucket")


def _plain(df: DataFrame) -> DataFrame:
    """Stream keys as the result tables have them: hex addresses, no v6."""
    return df.withColumns({c: F.hex(c) for c in ("lo_addr", "hi_addr")}).drop("lo_v6", "hi_v6")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    seg = table(spark, folder, "stream_segment")
    return skew.value_frequencies(seg.select(*stream_key(F.col("lo"), F.col("hi"), F.col("proto")), "payload_len"), KEY, "payload_len")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(skew.hot_keys(_payloads(spark, folder), KEY, HOT_SHARE)).drop("rows")


def p4_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = skew.key_statistics(_payloads(spark, folder), KEY, "payload_len")
    return _plain(stats.withColumnRenamed("total", "payload_total"))


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(skew.key_percentiles(_payloads(spark, folder), KEY, "payload_len", FRACTIONS))


def _sessions(spark: SparkSession, folder: str, once_a_session: bool = False) -> DataFrame:
    seg = table(spark, folder, "stream_segment")
    us = epoch_us(seg, "ts")
    e = seg.select("fixture", *stream_key(F.col("lo"), F.col("hi"), F.col("proto")), F.when(us != 0, us).alias("us"), "frame")
    return _plain(sessions.sessions(e, ["fixture", *KEY], "us", "frame", GAP_US, once_a_session=once_a_session))


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder, once_a_session=True).withColumnRenamed("items", "frames")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).drop("duration_us", "rows", "items")


QUERIES = {f.__name__: f for f in (p3_found, p3_series, p4_found, p4_stats, p4_percentiles, p5_found, p5_sessions)}

#: hex of a canonical address; {a}: BLOB, {v}: BOOLEAN
CANON = "(CASE WHEN hex({a}) LIKE '00000000000000000000FFFF%' OR (NOT coalesce({v}, false) AND hex({a}) LIKE '000000000000000000000000%') THEN substr(hex({a}), 25, 8) || repeat('0', 24) ELSE hex({a}) END)"


def _end(side: str) -> str:
    a, v, p = f"{side}.addr", f"{side}.v6", f"{side}.port"
    return f"{{'addr': {CANON.format(a=a, v=v)}, 'v6': coalesce({v}, false) AND hex({a}) NOT LIKE '00000000000000000000FFFF%', 'port': CAST(CASE WHEN {p} < 0 THEN {p} + 65536 ELSE {p} END AS BIGINT)}}"


_SEG = f"""
ends AS (SELECT *, {_end('lo')} AS a, {_end('hi')} AS b FROM stream_segment),
seg AS (SELECT fixture, frame, CASE WHEN ts <> TIMESTAMP '1970-01-01' THEN epoch_us(ts) END AS us, payload_len, least(a, b) AS l, greatest(a, b) AS h, CAST(proto AS BIGINT) AS proto FROM ends),
keyed AS (SELECT fixture, frame, us, payload_len, l.addr AS lo_addr, l.v6 AS lo_v6, l.port AS lo_port, h.addr AS hi_addr, h.v6 AS hi_v6, h.port AS hi_port, proto FROM seg)"""
_K = "lo_addr, lo_v6, lo_port, hi_addr, hi_v6, hi_port, proto"
_OUT = "lo_addr, lo_port, hi_addr, hi_port, proto"
_RUNS = f"""
steps AS (SELECT *, us - lag(us) OVER (PARTITION BY fixture, {_K} ORDER BY us) AS step FROM keyed WHERE us IS NOT NULL),
runs AS (SELECT *, sum(CASE WHEN step <= {GAP_US} THEN 0 ELSE 1 END) OVER (PARTITION BY fixture, {_K} ORDER BY us) AS run FROM steps),
sess AS (SELECT fixture, {_K}, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS rows, count(DISTINCT frame) AS frames FROM runs GROUP BY fixture, {_K}, run)"""

_READINGS = """
g AS (SELECT DISTINCT graph_id, graph_start, buckets, CAST(round(graph_interval * 1e6) AS BIGINT) AS step, len(series) AS n FROM io_graph WHERE graph_start IS NOT NULL AND buckets > 0),
f AS (SELECT l.graph_id, CAST(l.line_no AS BIGINT) AS line_no, epoch_us(l.ts) - epoch_us(g.graph_start) AS d, g.step, g.buckets, l.points FROM io_line l JOIN g USING (graph_id) WHERE l.ts IS NOT NULL AND l.line_no BETWEEN 0 AND g.n - 1),
p AS (SELECT graph_id, line_no, d, step, buckets, unnest(points) AS v, unnest(range(len(points))) AS i FROM f),
r AS (SELECT graph_id, line_no, step, buckets, d + i * step AS t, CAST(floor((d + i * step) / step) AS BIGINT) AS b, avg(v) AS v FROM p WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY graph_id, line_no, step, buckets, d + i * step),
every AS (SELECT graph_id, line_no, unnest(range(buckets)) AS bucket FROM (SELECT graph_id, buckets, unnest(range(n)) AS line_no FROM g))"""

_MAX_GAP = 5
_HARMONIC = "CASE WHEN {a} * {b} <= 0 THEN 0 ELSE 3 * ({h} + {k}) / ((2 * {k} + {h}) / {a} + ({k} + 2 * {h}) / {b}) END"
_OUTER = "CASE WHEN sign({d}) <> sign({a}) THEN 0 WHEN sign({a}) <> sign({b}) AND abs({d}) > 3 * abs({a}) THEN 3 * {a} ELSE {d} END"


def _slope(h: str, a: str, inward: str, b_in: str, beside: str, b_out: str) -> str:
    """Slope at one end of the gap: between it and the interval beside it, else at the outer end of the line's segment."""
    d = f"(((2 * {h} + {inward}) * {a} - {h} * {b_in}) / ({h} + {inward}))"
    return f"CASE WHEN {beside} IS NOT NULL THEN {_HARMONIC.format(a=b_out, b=a, h=beside, k=h)} WHEN {inward} IS NOT NULL THEN {_OUTER.format(d=d, a=a, b=b_in)} ELSE {a} END"


ORACLE = {
    "p3_series": f"""
WITH {_READINGS},
w AS (SELECT *, lag(t) OVER w AS t0, lag(b) OVER w AS b0, lag(v) OVER w AS v0, lead(t) OVER w AS t2, lead(b) OVER w AS b2, lead(v) OVER w AS v2, lead(t, 2) OVER w AS t3, lead(b, 2) OVER w AS b3, lead(v, 2) OVER w AS v3 FROM r WINDOW w AS (PARTITION BY graph_id, line_no ORDER BY t)),
k AS (SELECT *, (t2 - t) / 1e6 AS h1, CASE WHEN b - b0 - 1 <= {_MAX_GAP} THEN (t - t0) / 1e6 END AS h0, CASE WHEN b3 - b2 - 1 <= {_MAX_GAP} THEN (t3 - t2) / 1e6 END AS h2 FROM w WHERE b2 - b - 1 BETWEEN 1 AND {_MAX_GAP}),
s AS (SELECT *, (v - v0) / h0 AS s0, (v2 - v) / h1 AS s1, (v3 - v2) / h2 AS s2 FROM k),
c AS (SELECT *, {_slope('h1', 's1', 'h2', 's2', 'h0', 's0')} AS l, {_slope('h1', 's1', 'h0', 's0', 'h2', 's2')} AS q FROM s),
x AS (SELECT *, unnest(range(b + 1, b2)) AS bucket FROM c),
u AS (SELECT *, (bucket * step + step // 2 - t) / 1e6 / h1 AS u FROM x),
filled AS (SELECT graph_id, line_no, bucket, v * (1 + 2 * u) * (1 - u) * (1 - u) + v2 * u * u * (3 - 2 * u) + h1 * u * (1 - u) * (l * (1 - u) - q * u) AS value FROM u),
seen AS (SELECT graph_id, line_no, b AS bucket, count(*) AS n, avg(v) AS value FROM r GROUP BY graph_id, line_no, b)
SELECT e.graph_id, CAST(e.line_no AS BIGINT) AS line_no, CAST(e.bucket AS BIGINT) AS bucket, coalesce(seen.n, 0) AS n_readings, round(coalesce(seen.value, filled.value), 6) + 0.0 AS value, CASE WHEN seen.n > 0 THEN 'read' WHEN filled.value IS NOT NULL THEN 'filled' ELSE 'absent' END AS status
FROM every e LEFT JOIN seen ON (e.graph_id, e.line_no, e.bucket) = (seen.graph_id, seen.line_no, seen.bucket) LEFT JOIN filled ON (e.graph_id, e.line_no, e.bucket) = (filled.graph_id, filled.line_no, filled.bucket)""",
    "p3_found": """
WITH g AS (SELECT DISTINCT graph_id, graph_start, buckets, CAST(round(graph_interval * 1e6) AS BIGINT) AS step, len(series) AS n FROM io_graph WHERE graph_start IS NOT NULL AND buckets > 0),
f AS (SELECT l.graph_id, CAST(l.line_no AS BIGINT) AS line_no, epoch_us(l.ts) - epoch_us(g.graph_start) AS d, g.step, l.points FROM io_line l JOIN g USING (graph_id) WHERE l.ts IS NOT NULL),
p AS (SELECT graph_id, line_no, d, step, unnest(points) AS v, unnest(range(len(points))) AS i FROM f),
seen AS (SELECT DISTINCT graph_id, line_no, CAST(floor((d + i * step) / step) AS BIGINT) AS bucket FROM p WHERE v IS NOT NULL AND NOT isnan(v)),
every AS (SELECT graph_id, line_no, unnest(range(buckets)) AS bucket FROM (SELECT graph_id, buckets, unnest(range(n)) AS line_no FROM g))
SELECT graph_id, CAST(line_no AS BIGINT) AS line_no, CAST(bucket AS BIGINT) AS bucket FROM every ANTI JOIN seen USING (graph_id, line_no, bucket)""",
    "p4_found": f"WITH {_SEG} SELECT {_OUT} FROM keyed GROUP BY {_K} HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM keyed)",
    "p4_stats": f"""WITH {_SEG},
freq AS (SELECT {_K}, payload_len, count(*) AS n FROM keyed WHERE payload_len IS NOT NULL GROUP BY {_K}, payload_len),
mode AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, payload_len) AS r FROM freq),
stat AS (SELECT {_K}, count(*) AS rows, CAST(sum(payload_len) AS BIGINT) AS payload_total, count(DISTINCT payload_len) AS distinct_values FROM keyed GROUP BY {_K})
SELECT s.lo_addr, s.lo_port, s.hi_addr, s.hi_port, s.proto, s.rows, s.payload_total, s.distinct_values, m.payload_len AS mode, m.n AS mode_rows FROM stat s LEFT JOIN mode m
ON m.r = 1 AND {' AND '.join(f's.{k} IS NOT DISTINCT FROM m.{k}' for k in _K.split(', '))}""",
    "p4_percentiles": f"""WITH {_SEG},
ranked AS (SELECT {_K}, payload_len, row_number() OVER (PARTITION BY {_K} ORDER BY payload_len) AS r, count(*) OVER (PARTITION BY {_K}) AS n FROM keyed WHERE payload_len IS NOT NULL)
SELECT {_OUT}, f.fraction, payload_len FROM ranked JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in FRACTIONS)}) f(fraction) ON r = greatest(CAST(ceil(f.fraction * n) AS BIGINT), 1)""",
    "p5_found": f"WITH {_SEG}, {_RUNS} SELECT fixture, {_OUT}, start_us, end_us FROM sess",
    "p5_sessions": f"WITH {_SEG}, {_RUNS} SELECT fixture, {_OUT}, start_us, end_us, duration_us, rows, frames FROM sess",
}
