"""Capture files as bytes: pcap and pcapng, read and written.

A reader walks the records and keeps everything that could be read; what it had to give up is a warning or an error that
names the format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

LARGEST_FRAME = 16 << 20  # fixed value
#: first four bytes -> (byte order, nanoseconds); fixed values
PCAP_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
MODIFIED = (b"\x34\xcd\xb2\xa1", b"\xa1\xb2\xcd\x34")
SECTION, INTERFACE, SIMPLE, STATISTICS, ENHANCED = 0x0A0D0D0A, 1, 3, 5, 6  # block types; fixed values


class CaptureError(ValueError):
    """A file that cannot be read as a capture."""


@dataclass
class Interface:
    link_type: int
    snaplen: int = 0
    name: str | None = None
    description: str | None = None
    ts_per_sec: int = 1_000_000
    ts_offset: int = 0
    received: int | None = None
    dropped: int | None = None
    filter_accepted: int | None = None
    os_dropped: int | None = None

    def ns(self, units: int) -> int:
        """Exact nanoseconds, rounded down; finer units than nanoseconds lose only what is below one."""
        return units * 10**9 // self.ts_per_sec + self.ts_offset * 10**9


@dataclass
class Capture:
    format: str
    interfaces: list[Interface] = field(default_factory=list)
    packets: list[tuple[int, int, int, bytes]] = field(default_factory=list)  # interface, ts_ns, orig_len, bytes
    truncated_at: int | None = None
    warnings: list[str] = field(default_factory=list)


def sniff(head: bytes) -> str:
    """pcap, pcapng, pcap_modified, gzip, empty or unknown, from the first four bytes."""
    if not head:
        return "empty"
    if head[:4] in PCAP_MAGIC:
        return "pcap"
    if head[:4] in MODIFIED:
        return "pcap_modified"
    return "pcapng" if head[:4] == b"\n\r\r\n" else "gzip" if head[:2] == b"\x1f\x8b" else "unknown"


def read(data: bytes) -> Capture:
    kind = sniff(data)
    if kind not in ("pcap", "pcapng"):
        said = {"empty": "the file is empty", "gzip": "the file is compressed with gzip; decompress it first", "pcap_modified": "modified pcap files are not supported", "unknown": "the file is neither pcap nor pcapng"}
        raise CaptureError(said[kind])
    out = read_pcap(data) if kind == "pcap" else read_pcapng(data)
    if out.truncated_at is not None:
        out.warnings.append(f"the file ends in the middle of a record at byte {out.truncated_at}; the frames before it are kept")
    lost = sum((i.dropped or 0) + (i.os_dropped or 0) for i in out.interfaces)
    if lost:
        out.warnings.append(f"{lost} frames were dropped while capturing")
    links = {out.interfaces[i].link_type for i, *_ in out.packets if i < len(out.interfaces)}
    if len(links) > 1:
        out.warnings.append("the file mixes link types " + ", ".join(map(str, sorted(links))))
    return out


def read_pcap(data: bytes) -> Capture:
    order, nanos = PCAP_MAGIC[data[:4]]
    if len(data) < 24:
        raise CaptureError("the pcap header is truncated")
    zone, _, snaplen, link = struct.unpack(order + "iIII", data[8:24])
    out, at = Capture("pcap", [Interface(link & 0xFFFF, snaplen)]), 24
    while at < len(data):
        if at + 16 > len(data):
            out.truncated_at = at
            break
        secs, part, size, orig = struct.unpack_from(order + "IIII", data, at)
        if size > LARGEST_FRAME or (orig and size > orig):
            raise CaptureError(f"pcap record at byte {at} claims {size} bytes of {orig}")
        if at + 16 + size > len(data):
            out.truncated_at = at
            break
        out.packets.append((0, (secs + zone) * 10**9 + min(part * (1 if nanos else 1000), 999_999_999), orig, data[at + 16 : at + 16 + size]))
        at += 16 + size
    return out


def _options(body: bytes, order: str) -> Iterable[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0 or at + 4 + size > len(body):
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _interface(body: bytes, order: str) -> Interface:
    out = Interface(*struct.unpack_from(order + "HxxI", body))
    for code, v in _options(body[8:], order):
        if code == 2:
            out.name = v.decode("utf-8", "replace")
        elif code == 3:
            out.description = v.decode("utf-8", "replace")
        elif code == 9 and v:
            out.ts_per_sec = 1 << (v[0] & 127) if v[0] & 128 else 10 ** (v[0] & 127)
        elif code == 14 and len(v) == 8:
            out.ts_offset = struct.unpack(order + "q", v)[0]
    return out


def read_pcapng(data: bytes) -> Capture:
    """Packets keep the interface of their own section: the table of interfaces runs over all sections."""
    out, at, order, first = Capture("pcapng"), 0, "<", 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\n\r\r\n":
            mark = data[at + 8 : at + 12]
            if mark not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise CaptureError(f"pcapng section at byte {at} has no byte order")
            order, first = ("<" if mark[0] == 0x4D else ">"), len(out.interfaces)
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size % 4 or at + size > len(data) or struct.unpack_from(order + "I", data, at + size - 4)[0] != size:
            raise CaptureError(f"pcapng block at byte {at} has a wrong length")
        body = data[at + 8 : at + size - 4]
        known = out.interfaces[first:]
        if kind == INTERFACE and len(body) >= 8:
            out.interfaces.append(_interface(body, order))
        elif kind == ENHANCED:
            if len(body) < 20:
                raise CaptureError(f"pcapng packet at byte {at} is too short")
            iface, high, low, cap, orig = struct.unpack_from(order + "IIIII", body)
            if 20 + cap > len(body):
                raise CaptureError(f"pcapng packet at byte {at} overruns its block")
            if iface >= len(known):
                said = f"a packet names interface {iface}, which is not described; interface 0 is used"
                if said not in out.warnings:
                    out.warnings.append(said)
                iface = 0
            ns = known[iface].ns(high << 32 | low) if known else Interface(1).ns(high << 32 | low)
            out.packets.append((first + iface, ns, orig, body[20 : 20 + cap]))
        elif kind == SIMPLE and len(body) >= 4:
            orig = struct.unpack_from(order + "I", body)[0]
            cap = min(orig, known[0].snaplen or orig) if known else orig
            if 4 + cap > len(body):
                raise CaptureError(f"pcapng packet at byte {at} overruns its block")
            out.packets.append((first, 0, orig, body[4 : 4 + cap]))
        elif kind == STATISTICS and len(body) >= 12:
            iface = struct.unpack_from(order + "I", body)[0]
            if iface < len(known):
                for code, v in _options(body[12:], order):
                    name = {4: "received", 5: "dropped", 6: "filter_accepted", 7: "os_dropped"}.get(code)
                    if name and len(v) == 8:
                        setattr(known[iface], name, struct.unpack(order + "Q", v)[0])
        at += size
    if out.packets and not out.interfaces:
        out.warnings.append("the file describes no interface; Ethernet is assumed")
        out.interfaces.append(Interface(1))
    return out


def pcap_header(link: int, nanos: bool, snaplen: int = 262_144) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link)


def pcap_record(ts_ns: int, orig_len: int, raw: bytes, nanos: bool, snaplen: int = 262_144) -> bytes:
    """Microseconds are cut off, times before 1970 are 0, lengths are made consistent."""
    raw = raw[:snaplen] if snaplen else raw
    ts = max(ts_ns, 0)
    return struct.pack("<IIII", ts // 10**9 & 0xFFFFFFFF, ts % 10**9 // (1 if nanos else 1000), len(raw), max(orig_len, len(raw))) + raw


def _block(kind: int, body: bytes) -> bytes:
    size = 12 + len(body)
    return struct.pack("<II", kind, size) + body + struct.pack("<I", size)


def _option(code: int, v: bytes) -> bytes:
    return struct.pack("<HH", code, len(v)) + v + bytes(-len(v) % 4)


def pcapng_header(links: list[int], names: dict[int, tuple[str | None, str | None, int]] | None = None) -> bytes:
    """A section and an interface per link type, in the order given, with nanoseconds. names: link -> (name, description, snaplen)."""
    out = _block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link in links:
        name, description, snaplen = (names or {}).get(link, (None, None, 262_144))
        options = (_option(2, name.encode()) if name else b"") + (_option(3, description.encode()) if description else b"") + _option(9, b"\x09") + _option(0, b"")
        out += _block(INTERFACE, struct.pack("<HHI", link, 0, snaplen) + options)
    return out


def pcapng_record(iface: int, ts_ns: int, orig_len: int, raw: bytes) -> bytes:
    ts = max(ts_ns, 0)
    return _block(ENHANCED, struct.pack("<IIIII", iface, ts >> 32, ts & 0xFFFFFFFF, len(raw), max(orig_len, len(raw))) + raw + bytes(-len(raw) % 4))
