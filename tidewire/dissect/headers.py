"""Header fields of frames as plain columns.

Covers what occurs at most once per frame and at a computable place: Ethernet with up to two VLAN tags, loopback and raw
IP links, the IPv4 and IPv6 base headers, UDP, TCP and ICMP. `deep` marks frames that need the full dissection for their
flow or may hold a field twice: fragments, IPv6 extension headers, quoted datagrams, LLC, more VLAN tags, cut headers.

The fields of a batch are read side by side: its bytes are one array, and each field is one gather from it. (The same as
SQL expressions on the bytes, conv(hex(substring(...))), was measured to take eight times as long.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: columns of headers() that filters may use in place of the tree, by field
PROMOTED = {
    "frame.number": "number", "frame.len": "orig_len", "frame.cap_len": "cap_len",
    "eth.dst": "eth_dst", "eth.src": "eth_src", "eth.type": "eth_type",
    "ip.src": "ip_src", "ip.dst": "ip_dst", "ip.len": "ip_len", "ip.id": "ip_id", "ip.ttl": "ip_ttl", "ip.proto": "ip_proto", "ip.flags.df": "ip_df", "ip.dsfield.dscp": "ip_dscp",
    "ipv6.src": "ip6_src", "ipv6.dst": "ip6_dst", "ipv6.nxt": "ip6_nxt", "ipv6.hlim": "ip6_hlim", "ipv6.plen": "ip6_plen",
    "udp.srcport": "udp_src", "udp.dstport": "udp_dst", "udp.length": "udp_length",
    "tcp.srcport": "tcp_src", "tcp.dstport": "tcp_dst", "tcp.seq": "tcp_seq", "tcp.ack": "tcp_ack", "tcp.flags": "tcp_flags", "tcp.window_size_value": "tcp_window", "tcp.len": "tcp_len", "tcp.hdr_len": "tcp_hdr",
    "tcp.flags.syn": "tcp_syn", "tcp.flags.ack": "tcp_ackf", "tcp.flags.fin": "tcp_fin", "tcp.flags.reset": "tcp_rst", "tcp.flags.push": "tcp_psh",
}
#: protocols whose presence headers() knows, by the column that is then not null
PRESENT = {"eth": "eth_type0", "ip": "ip_src", "ipv6": "ip6_src", "udp": "udp_src", "tcp": "tcp_hdr"}
_ADDRESSES = {"eth_dst": 6, "eth_src": 6, "ip_src": 4, "ip_dst": 4, "ip6_src": 16, "ip6_dst": 16}
_FLAGS = ("ip_df", "fragment", "deep", "tcp_fin", "tcp_syn", "tcp_rst", "tcp_psh", "tcp_ackf")
_NUMBERS = ("cap_len", "eth_type0", "eth_type", "l3", "head", "ip_dscp", "ip_len", "ip_id", "ip_frag", "ip_ttl", "ip_proto", "ip6_plen", "ip6_nxt", "ip6_hlim", "l4", "l4_end", "proto", "icmp_type", "udp_length", "udp_src", "udp_dst", "tcp_src", "tcp_dst", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_hdr", "tcp_window", "tcp_len")
COLUMNS = (*_NUMBERS, *_ADDRESSES, *_FLAGS)


def be(v: Column, n: int) -> Column:
    """The n lowest bytes of a number, big-endian."""
    return F.unhex(F.lpad(F.hex(F.pmod(v.cast("bigint"), F.lit(1 << min(8 * n, 62)))), 2 * n, "0"))


class _Window:
    """The bytes of a batch: where each row's begin, and how many there are."""

    def __init__(self, column: pa.Array):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        bounds = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
        self.data = data if len(data) >= 64 else np.concatenate([data, np.zeros(64, np.uint8)])
        self.start, self.size = bounds[:-1], np.diff(bounds)
        if column.null_count:
            self.size = np.where(column.is_valid().to_numpy(zero_copy_only=False), self.size, 0)

    def number(self, at: np.ndarray | int, n: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned big-endian numbers, and where they could be read."""
        ok = where & (at + n <= self.size)
        i = np.where(ok, self.start + at, 0)
        out = self.data[i].astype(np.int64)
        for k in range(1, n):
            out = out << 8 | self.data[i + k]
        return out, ok

    def address(self, at: np.ndarray | int, n: int, where: np.ndarray) -> pa.Array:
        ok = where & (at + n <= self.size)
        raw = self.data[np.where(ok, self.start + at, 0)[:, None] + np.arange(n)]
        valid = pa.array(ok).buffers()[1]
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(ok), [valid, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def read(column: pa.Array, link: np.ndarray, want: set[str]) -> dict[str, pa.Array]:
    """The wanted columns of a batch; link: -1 where it is not known."""
    w, out = _Window(column), {}
    every = np.ones(len(link), bool)

    def give(name: str, values: np.ndarray, ok: np.ndarray | None = None) -> None:
        if name in want:
            out[name] = pa.array(values, mask=None if ok is None else ~ok)

    def number(name: str, at, n: int, where: np.ndarray) -> np.ndarray:
        v, ok = w.number(at, n, where)
        give(name, v, ok)
        return np.where(ok, v, -1)

    def address(name: str, at, where: np.ndarray) -> None:
        if name in want:
            out[name] = w.address(at, _ADDRESSES[name], where)

    eth, loop = link == 1, (link == 0) | (link == 108)
    give("cap_len", w.size, column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None)
    address("eth_dst", 0, eth)
    address("eth_src", 6, eth)
    tagged = lambda v: (v == 0x8100) | (v == 0x88A8)
    first = number("eth_type0", 12, 2, eth)
    second, third = (np.where(ok, v, -1) for v, ok in (w.number(16, 2, eth), w.number(20, 2, eth)))
    give("eth_type", first, first > 1500)
    one, two = tagged(first), tagged(first) & tagged(second)
    inner = np.where(two, third, np.where(one, second, first))
    family, ok = w.number(0, 4, loop)
    little = family.astype(np.uint32).byteswap().astype(np.int64)
    family = np.where(ok, np.where(little <= 0xFF, little, family), -1)
    is4 = (eth & (inner == 0x0800)) | (link == 12) | (link == 228) | (family == 2)
    is6 = (eth & (inner == 0x86DD)) | (link == 229) | np.isin(family, (24, 28, 30))
    l3 = np.where(eth, 14 + 4 * (one.astype(np.int64) + two), np.where(loop, 4, 0))
    give("l3", l3)
    odd = (two & tagged(third)) | (eth & (inner <= 1500) & (inner >= 0)) | (eth & (first < 0))
    vihl, ok = w.number(l3, 1, is4 | is6)
    size4 = 4 * (vihl & 15)
    v4 = is4 & ok & (vihl >> 4 == 4) & (size4 >= 20) & (l3 + 20 <= w.size)
    v6 = is6 & ok & (vihl >> 4 == 6) & (l3 + 40 <= w.size)
    head = np.where(v4, size4, 40)
    give("head", head, v4 | v6)
    if "ip_dscp" in want:
        v, ok = w.number(l3 + 1, 1, v4)
        give("ip_dscp", v >> 2, ok)
    length, frag = number("ip_len", l3 + 2, 2, v4), number("ip_frag", l3 + 6, 2, v4)
    number("ip_id", l3 + 4, 2, v4)
    number("ip_ttl", l3 + 8, 1, v4)
    proto4, nxt, plen = number("ip_proto", l3 + 9, 1, v4), number("ip6_nxt", l3 + 6, 1, v6), number("ip6_plen", l3 + 4, 2, v6)
    number("ip6_hlim", l3 + 7, 1, v6)
    for name, at, where in (("ip_src", 12, v4), ("ip_dst", 16, v4), ("ip6_src", 8, v6), ("ip6_dst", 24, v6)):
        address(name, l3 + at, where)
    give("ip_df", frag & 0x4000 != 0, v4)
    fragment = v4 & (frag & 0x3FFF != 0)
    give("fragment", fragment)
    proto = np.where(v4, proto4, nxt)
    give("proto", proto, v4 | v6)
    end = np.where(v4, np.where(length == 0, w.size, np.minimum(w.size, l3 + np.maximum(length, head))), np.minimum(w.size, l3 + 40 + plen))
    give("l4_end", end, v4 | v6)
    inside = (v4 | v6) & ~fragment
    l4 = l3 + head
    give("l4", l4, inside)
    size = end - l4
    udp, tcp = inside & (proto == 17) & (size >= 8), inside & (proto == 6) & (size >= 20)
    icmp = number("icmp_type", l4, 1, inside & (proto == 1))
    u_length, word = (np.where(ok, v, -1) for v, ok in (w.number(l4 + 4, 2, udp), w.number(l4 + 12, 2, tcp)))
    udp, tcp = udp & (u_length >= 8), tcp & (word >= 0x5000)
    give("udp_length", u_length, udp)
    number("udp_src", l4, 2, udp)
    number("udp_dst", l4 + 2, 2, udp)
    number("tcp_src", l4, 2, tcp)
    number("tcp_dst", l4 + 2, 2, tcp)
    number("tcp_seq", l4 + 4, 4, tcp)
    number("tcp_ack", l4 + 8, 4, tcp)
    number("tcp_window", l4 + 14, 2, tcp)
    t_head = (word >> 12) * 4
    give("tcp_flags", word & 0xFFF, tcp)
    give("tcp_hdr", t_head, tcp)
    give("tcp_len", np.maximum(size - t_head, 0), tcp)
    for name, bit in (("tcp_fin", 1), ("tcp_syn", 2), ("tcp_rst", 4), ("tcp_psh", 8), ("tcp_ackf", 16)):
        give(name, word & bit != 0, tcp)
    cut = (is4 & ~v4) | (is6 & ~v6) | (v4 & (w.size < l4)) | (v4 & (length < head) & (length > 0))
    cut |= inside & (((proto == 17) & ~udp) | ((proto == 6) & (~tcp | (t_head > size))))
    give("deep", every & (odd | fragment | (v6 & np.isin(proto, (0, 43, 44, 60))) | np.isin(icmp, (3, 4, 5, 11, 12)) | cut))
    return out


def header_type(name: str) -> T.DataType:
    return T.BinaryType() if name in _ADDRESSES else T.BooleanType() if name in _FLAGS else T.LongType()


def headers(raw: DataFrame, want: Sequence[str] = COLUMNS) -> DataFrame:
    """The columns of raw (bytes and link_type among them) and the wanted ones of COLUMNS. Null and empty bytes give nulls;
    deep and fragment are never null."""
    want = [c for c in COLUMNS if c in want]
    names, keep = raw.columns, len(raw.columns)
    at, link_at = names.index("bytes"), names.index("link_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = b.column(link_at).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            got = read(b.column(at), link, set(want))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keep)), *(got[c] for c in want)], names=[*names, *want])

    return raw.mapInArrow(run, T.StructType([*raw.schema.fields, *(T.StructField(c, header_type(c)) for c in want)]))
