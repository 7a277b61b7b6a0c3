"""Addresses and stream keys in canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO12 = bytes(12)
MAPPED = bytes(10) + b"\xff\xff"


def is_mapped(addr: Column) -> Column:
    """An IPv4 address in the last four bytes behind ::ffff."""
    return (F.length(addr) == 16) & (F.substring(addr, 1, 12) == F.lit(MAPPED))


def canonical_addr(addr: Column, v6: Column) -> Column:
    """16 bytes: IPv4 in the first four with zeros behind, however the writer placed it. Null stays null; other lengths stay as they are."""
    shifted = is_mapped(addr) | (~F.coalesce(v6, F.lit(False)) & (F.length(addr) == 16) & (F.substring(addr, 1, 12) == F.lit(ZERO12)))
    return F.when(shifted, F.concat(F.substring(addr, 13, 4), F.lit(ZERO12))).otherwise(addr)


def canonical_v6(addr: Column, v6: Column) -> Column:
    return F.coalesce(v6, F.lit(False)) & ~F.coalesce(is_mapped(addr), F.lit(False))


def unsigned_port(port: Column) -> Column:
    """0..65535; a negative port was stored as signed 16 bits."""
    return F.when(port < 0, port.cast("bigint") + 65536).otherwise(port.cast("bigint"))


def canonical_endpoint(end: Column) -> Column:
    addr, v6 = end["addr"], end["v6"]
    return F.struct(canonical_addr(addr, v6).alias("addr"), canonical_v6(addr, v6).alias("v6"), unsigned_port(end["port"]).alias("port"))


def stream_key(lo: Column, hi: Column, proto: Column) -> list[Column]:
    """lo_addr, lo_v6, lo_port, hi_addr, hi_v6, hi_port, proto with (lo) <= (hi); null parts sort first, addresses are BINARY."""
    a, b = canonical_endpoint(lo), canonical_endpoint(hi)
    low, high = F.least(a, b), F.greatest(a, b)
    return [*(side[part].alias(f"{name}_{part}") for name, side in (("lo", low), ("hi", high)) for part in ("addr", "v6", "port")), proto.cast("bigint").alias("proto")]


KEY = ("lo_addr", "lo_v6", "lo_port", "hi_addr", "hi_v6", "hi_port", "proto")
