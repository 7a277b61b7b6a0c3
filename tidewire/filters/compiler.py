"""Checked filters to Columns: over the tree of a frame, or over header columns where those suffice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.dissect import stage
from tidewire.dissect.headers import PRESENT, PROMOTED, headers
from tidewire.dissect.layers import Options
from tidewire.filters.language import And, Compare, FilterError, Not, Or, Present, field_names, parse

#: fields that depend on other frames of the capture
STATEFUL = ("tcp.stream", "udp.stream", "tcp.analysis", "ip.fragments", "ip.fragment", "ip.reassembled", "http", "tls", "_ws", "frame.protocols", "eth.trailer", "eth.padding", "data")
_OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _balanced(parts: list[Column], op) -> Column:
    """A tree of logarithmic depth: chains of hundreds of operands stay analysable."""
    while len(parts) > 1:
        parts = [reduce(op, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _number(op: str, x: Column, v: int) -> Column:
    """Comparison of a 64-bit number stored as BIGINT with a literal."""
    if v < 0:
        return F.lit(op in ("!=", ">", ">=")) & x.isNotNull()
    if op in ("==", "!="):
        return _OPS[op](x, F.lit(v if v < 1 << 63 else v - (1 << 64)))
    small = v < 1 << 63
    lit = F.lit(v if small else v - (1 << 64))
    same = x >= 0 if small else x < 0  # numbers of the literal's half; the negative half is the larger one
    beyond = (x < 0) if small else F.lit(False)
    below = F.lit(False) if small else (x >= 0)
    hit = same & _OPS[op](x, lit)
    return hit | (beyond if op in (">", ">=") else below)


def _value(field, op: str, x: Column, v) -> Column:
    """Comparison of a value column with a literal, by the field's kind."""
    if field.kind in ("unsigned", "enum"):
        return _number(op, x, v)
    if isinstance(v, tuple):
        inside = (x >= F.lit(v[0])) & (x <= F.lit(v[1]))
        return inside if op == "==" else ~inside
    return _OPS[op](x, F.lit(v))


def _source(n: Column, sources: Column) -> Column:
    return F.get(sources, n["source"])


def _bytes(c: Compare, n: Column, sources: Column) -> tuple[Column, Column]:
    """A node's bytes, or the slice of them, and whether it has them."""
    start, size = n["start"], n["end"] - n["start"]
    if c.field.kind in ("protocol", "group"):
        return F.substring(_source(n, sources), start + 1, F.lit(2**31 - 1)), F.lit(True)
    if c.slice is None:
        return F.substring(_source(n, sources), start + 1, size), F.lit(True)
    off, length = c.slice
    need = off + (length if length is not None else 1)
    return F.substring(_source(n, sources), start + 1 + off, F.lit(length) if length is not None else size - off), size >= need


def _on_node(c: Compare, n: Column, sources: Column) -> Column:
    kind = c.field.kind
    raw = c.slice is not None or kind in ("bytes", "protocol", "group") or (c.op in ("contains", "matches") and kind != "string")
    if not raw:
        x = n[{"unsigned": "u", "enum": "u", "bool": "b", "string": "s"}.get(kind, "a")]
        if c.op == "contains":
            return F.contains(x, F.lit(c.value))
        return F.rlike(x, F.lit("(?dU)" + c.value)) if c.op == "matches" else _value(c.field, c.op, x, c.value)
    b, has = _bytes(c, n, sources)
    if c.op == "contains":
        return has & F.contains(b, F.lit(c.value))
    if c.op == "matches":
        latin = "".join(x if ord(x) < 128 else x.encode().decode("latin-1") for x in c.value)
        return has & F.rlike(F.decode(b, "ISO-8859-1"), F.lit("(?d)" + latin))
    return has & _OPS[c.op](b, F.lit(c.value))


def _tree(e, nodes: Column, sources: Column) -> Column:
    if isinstance(e, And):
        return _balanced([_tree(p, nodes, sources) for p in e.parts], lambda a, b: a & b)
    if isinstance(e, Or):
        return _balanced([_tree(p, nodes, sources) for p in e.parts], lambda a, b: a | b)
    if isinstance(e, Not):
        return ~_tree(e.part, nodes, sources)
    ids = list(e.field.ids)
    if isinstance(e, Present):
        return _sure(F.exists(nodes, lambda n: n["field"].isin(ids)))
    return _sure(F.exists(nodes, lambda n: n["field"].isin(ids) & _sure(_on_node(e, n, sources))))


def compile_filter(text: str, nodes: Column | str = "nodes", sources: Column | str = "sources") -> Column:
    """A predicate over dissected frames; never null. Blank text is true; FilterError tells what is wrong and where."""
    e = parse(text)
    return F.lit(True) if e is None else _tree(e, F.col(nodes) if isinstance(nodes, str) else nodes, F.col(sources) if isinstance(sources, str) else sources)


def _flat(e) -> Column | None:
    if isinstance(e, (And, Or)):
        parts = [_flat(p) for p in e.parts]
        if any(p is None for p in parts):
            return None
        return _balanced(parts, (lambda a, b: a & b) if isinstance(e, And) else (lambda a, b: a | b))
    if isinstance(e, Not):
        p = _flat(e.part)
        return None if p is None else ~p
    if isinstance(e, Present):
        cols = [PRESENT.get(i) or PROMOTED.get(i) for i in e.field.ids]
        return None if None in cols else _balanced([F.col(c).isNotNull() for c in cols], lambda a, b: a | b)
    cols = [PROMOTED.get(i) for i in e.field.ids]
    if None in cols or e.slice is not None or e.op in ("contains", "matches"):
        return None
    return _balanced([_sure(_value(e.field, e.op, F.col(c), e.value)) for c in cols], lambda a, b: a | b)


_RAW_COLUMNS = {"frame.number": "number", "frame.len": "orig_len", "frame.cap_len": None}


def _of_table(e) -> Column | None:
    """The predicate over the columns of RAW alone, where every field is a number of the frame itself; null numbers count as 0.
    Comparisons of stored columns reach the scan."""
    if isinstance(e, (And, Or)):
        parts = [_of_table(p) for p in e.parts]
        if any(p is None for p in parts):
            return None
        return _balanced(parts, (lambda a, b: a & b) if isinstance(e, And) else (lambda a, b: a | b))
    if isinstance(e, Not):
        p = _of_table(e.part)
        return None if p is None else ~_sure(p)
    if any(i not in _RAW_COLUMNS for i in e.field.ids):
        return None
    if isinstance(e, Present):
        return F.lit(True)
    if e.slice is not None or e.op in ("contains", "matches"):
        return None
    parts = []
    for i in e.field.ids:
        column = _RAW_COLUMNS[i]
        x = F.length("bytes").cast("bigint") if column is None else F.col(column)
        hit = _number(e.op, x, e.value)
        parts.append(hit | x.isNull() if _OPS[e.op](0, e.value) else hit)
    return _balanced(parts, lambda a, b: a | b)


def flat_filter(text: str) -> Column | None:
    """The predicate over the columns of headers(), where it can be told from them; valid on rows that are not deep."""
    e = parse(text)
    return F.lit(True) if e is None else _flat(e)


def displayed(raw: DataFrame, text: str, options: Options = Options()) -> DataFrame:
    """RAW rows that the filter selects.

    Filters over a frame's number and lengths are filters of the table and reach its scan. Those over header fields read
    headers in Arrow batches, and only frames whose headers nest are dissected; others dissect every frame, fragments with
    their datagram, and with the state of its flow where the filter asks for what depends on other frames.
    """
    e, flat = parse(text), flat_filter(text)
    raw = raw.select(*stage.RAW)
    if e is None:
        return raw
    if (own := _of_table(e)) is not None:
        return raw.where(own)
    if flat is not None and not any(n.startswith("frame.") for n in field_names(e)):
        h = headers(raw, {"deep", "fragment", "ip_src", "ip_dst", "ip_id", "ip_proto", "ip_frag", "l3", "head", "l4_end"} | {c for n in field_names(e) for c in (PROMOTED.get(n), PRESENT.get(n)) if c})
        plain = h.where(~F.col("deep") & flat).select(*stage.RAW)
        deep = stage.dissect_stateless(stage.deep_frames(h), options, field_names(e))
        return plain.unionByName(deep.where(compile_filter(text)).select(*stage.RAW))
    stateful = any(n == s or n.startswith(f"{s}.") for n in field_names(e) for s in STATEFUL)
    frames = stage.dissect(raw, options, field_names(e)) if stateful else stage.dissect_stateless(stage.with_wholes(raw), options, field_names(e))
    return frames.where(compile_filter(text)).select(*stage.RAW)



def evaluated(raw: DataFrame, texts: Sequence[tuple[str, str]], options: Options = Options()) -> tuple[DataFrame, dict[str, str]]:
    """RAW and a BOOLEAN column for each (name, filter), and the errors of the filters that do not compile; these are false.

    Where header columns can answer all of them, only frames whose headers nest are dissected, else every frame."""
    parsed, errors = {}, {}
    for name, text in texts:
        try:
            parsed[name] = (text, parse(text))
        except FilterError as e:
            errors[name] = str(e)
    known = [(name, text, e) for name, (text, e) in parsed.items() if e is not None]
    fields = {n for _, _, e in known for n in field_names(e)}
    raw = raw.select(*stage.RAW)
    fast = {name: F.lit(True) for name in parsed}
    for name, text, e in known:
        own = _of_table(e)
        fast[name] = own if own is not None else None if any(n.startswith("frame.") for n in field_names(e)) else _flat(e)
    columns = lambda of: [(F.lit(False) if name in errors else of(name)).alias(name) for name, _ in texts]
    tree = lambda name: compile_filter(parsed[name][0])
    if all(c is not None for c in fast.values()):
        h = headers(raw, {*stage._FRAGMENT} | {c for n in fields for c in (PROMOTED.get(n), PRESENT.get(n)) if c})
        plain = h.where(~F.col("deep")).select(*stage.RAW, *columns(fast.get))
        deep = stage.dissect_stateless(stage.deep_frames(h), options, fields).select(*stage.RAW, *columns(tree))
        return plain.unionByName(deep), errors
    stateful = any(n == s or n.startswith(f"{s}.") for n in fields for s in STATEFUL)
    frames = stage.dissect(raw, options, fields) if stateful else stage.dissect_stateless(stage.with_wholes(raw), options, fields)
    return frames.select(*stage.RAW, *columns(tree)), errors
