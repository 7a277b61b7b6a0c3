"""Trees as text, and ways through them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.dissect.fields import FIELDS, enum_name, label
from tidewire.dissect.tree import addr_text

#: fields shown in hexadecimal, and in both; fixed values
HEX = frozenset("llc.dsap llc.ssap llc.control llc.oui llc.pid llc.type eth.type vlan.etype arp.proto.type ip.dsfield ip.flags ip.checksum ipv6.tclass ipv6.flow ipv6.fraghdr.reserved_octet ipv6.fraghdr.ident icmp.checksum icmp.unused icmpv6.checksum icmpv6.reserved icmpv6.nd.na.flag icmpv6.nd.ra.flag udp.checksum tcp.flags tcp.checksum dns.id dns.flags dns.qry.class dns.resp.class dhcp.hw.type dhcp.id dhcp.flags dhcp.cookie tls.record.version tls.handshake.version tls.handshake.extensions.supported_version tls.handshake.ciphersuite tls.handshake.comp_method".split())
BOTH = frozenset(["ip.id"])
MOST_BYTES = 48  # of a value shown in hexadecimal; fixed value


#: lines of layers, with the values of fields directly below them; fixed values
LAYERS = {
    "frame": "Frame {frame.number}: {frame.len} bytes on wire, {frame.cap_len} bytes captured",
    "eth": "Ethernet II, Src: {eth.src}, Dst: {eth.dst}",
    "ip": "Internet Protocol Version 4, Src: {ip.src}, Dst: {ip.dst}",
    "ipv6": "Internet Protocol Version 6, Src: {ipv6.src}, Dst: {ipv6.dst}",
    "arp": "Address Resolution Protocol ({arp.opcode})",
    "udp": "User Datagram Protocol, Src Port: {udp.srcport}, Dst Port: {udp.dstport}",
    "tcp": "Transmission Control Protocol, Src Port: {tcp.srcport}, Dst Port: {tcp.dstport}, Seq: {tcp.seq}, Ack: {tcp.ack}, Len: {tcp.len}",
    "data": "Data ({data.len} bytes)",
}
#: enumerations shown by their names alone; fixed values
NAMES_ONLY = frozenset(["_ws.expert.severity", "_ws.expert.group"])
_HOLE = re.compile(r"\{([^}]+)\}")


def value_text(node: dict, sources: list[bytes]) -> str | None:
    """A node's value as text, None where it has none. node: a NODE struct as a dict."""
    f = FIELDS[node["field"]]
    size = node["end"] - node["start"]
    if f.kind == "bool":
        return None if node["b"] is None else "Set" if node["b"] else "Not set"
    if f.kind == "string":
        return node["s"]
    if f.kind == "bytes":
        raw = (sources[node["source"]] or b"")[node["start"] : node["end"]]
        return raw[:MOST_BYTES].hex() + ("…" if len(raw) > MOST_BYTES else "")
    if f.kind in ("mac", "ipv4", "ipv6"):
        return addr_text(node["a"])
    if f.kind not in ("unsigned", "enum") or node["u"] is None:
        return None
    u = node["u"] % 2**64
    known = enum_name(f.enum, u) if f.enum else None
    if f.name in NAMES_ONLY:
        return known
    digits = f"0x{u:0{2 * min(max(size, 1), 8)}x}"
    plain = digits if f.name in HEX else f"{digits} ({u})" if f.name in BOTH else str(u)
    return f"{known} ({plain})" if known else plain


def _layer(nodes: list[dict], at: int, sources: list[bytes]) -> str:
    """The line of a layer from the fields directly below it; enumerations by name, a question mark for what is missing."""
    node = nodes[at]
    below: dict[str, dict] = {}
    for n in nodes[at + 1 :]:
        if n["depth"] <= node["depth"]:
            break
        if n["depth"] == node["depth"] + 1:
            below.setdefault(n["field"], n)

    def value(m: re.Match) -> str:
        n = below.get(m[1])
        if n is None:
            return "?"
        f = FIELDS[n["field"]]
        return enum_name(f.enum, n["u"], "unknown") if f.kind == "enum" and n["u"] is not None else value_text(n, sources) or ""

    return _HOLE.sub(value, LAYERS[node["field"]])


def lines(nodes: list[dict], sources: list[bytes]) -> list[str]:
    """Each node's line: its own text, else its layer's, else its label and value."""
    out = []
    for at, n in enumerate(nodes):
        if n["text"] is not None:
            out.append(n["text"])
        elif n["field"] in LAYERS:
            out.append(_layer(nodes, at, sources))
        else:
            v = value_text(n, sources)
            out.append(f"{label(n['field'])}: {v}" if v else label(n["field"]))
    return out


def details(frames: DataFrame) -> DataFrame:
    """capture_id, number, lines ARRAY<STRING>: the tree of each frame, two blanks a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [[f"{'  ' * n['depth']}{x}" for n, x in zip(nodes, lines(nodes, sources))] for nodes, sources in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shown, pa.list_(pa.string()))], names=["capture_id", "number", "lines"])

    return frames.select("capture_id", "number", "nodes", "sources").mapInArrow(run, "capture_id string, number bigint, lines array<string>")


def with_lines(frames: DataFrame) -> DataFrame:
    """frames and __lines ARRAY<STRING>, the lines of each frame's tree without indents."""
    names = frames.columns
    nodes, sources = names.index("nodes"), names.index("sources")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [lines(own, src) for own, src in zip(b.column(nodes).to_pylist(), b.column(sources).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.list_(pa.string()))], names=[*names, "__lines"])

    return frames.mapInArrow(run, T.StructType([*frames.schema.fields, T.StructField("__lines", T.ArrayType(T.StringType()))]))


def roots(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["depth"] == 0)


def subtree_end(nodes: Column, idx: Column) -> Column:
    """Index behind the last node below idx."""
    depth = F.get(nodes, idx)["depth"]
    behind = F.filter(nodes, lambda n: (n["idx"] > idx) & (n["depth"] <= depth))
    return F.coalesce(F.get(behind, F.lit(0))["idx"], F.size(nodes))


def children(nodes: Column, idx: Column) -> Column:
    depth, end = F.get(nodes, idx)["depth"], subtree_end(nodes, idx)
    return F.filter(nodes, lambda n: (n["idx"] > idx) & (n["idx"] < end) & (n["depth"] == depth + 1))


def innermost_at(nodes: Column, source: Column, offset: Column) -> Column:
    """The deepest node over a byte, of equally deep ones the shortest, null if there is none."""
    over = F.filter(nodes, lambda n: (n["source"] == source) & (n["start"] <= offset) & (offset < n["end"]))
    best = F.array_max(F.transform(over, lambda n: F.struct(n["depth"].alias("d"), (n["start"] - n["end"]).alias("s"), (-n["idx"]).alias("i"))))
    return F.get(nodes, -best["i"])
