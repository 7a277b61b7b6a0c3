"""Timestamps as microseconds since 1970-01-01 UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC = {"UTC", "Etc/UTC", "Z", "GMT", "+00:00", "+00", "UCT", "Zulu"}


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp column. A column without a zone is read as UTC whatever the session's zone is."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType) and df.sparkSession.conf.get("spark.sql.session.timeZone") not in _UTC:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b on BIGINT, exact, also for negative a; b > 0."""
    return F.call_function("div", a - F.pmod(a, b), b)
