"""Builders of frames for tests."""

import struct

from tidewire.dissect.layers import ones_sum

MAC_A, MAC_B = bytes.fromhex("001122334455"), bytes.fromhex("66778899aabb")
IP_A, IP_B = bytes([192, 168, 1, 10]), bytes([93, 184, 216, 34])


def eth(payload, kind=0x0800, src=MAC_A, dst=MAC_B):
    return dst + src + struct.pack(">H", kind) + payload


def _sum(b):
    return ones_sum(b).to_bytes(2, "little")


def ip(payload, proto, src=IP_A, dst=IP_B, ident=1, flags=0x4000, options=b"", total=None, good=True):
    n = 20 + len(options) + len(payload) if total is None else total
    head = struct.pack(">BBHHHBB", 0x40 | (20 + len(options)) // 4, 0, n, ident, flags, 64, proto)
    sum_ = _sum(head + bytes(2) + src + dst + options)
    return head + (sum_ if good else b"\x12\x34") + src + dst + options + payload


def ip6(payload, nxt, src, dst):
    return struct.pack(">IHBB", 6 << 28, len(payload), nxt, 64) + src + dst + payload


def udp(payload, sport, dport, src=IP_A, dst=IP_B, sum_=True, length=None):
    n = 8 + len(payload) if length is None else length
    head = struct.pack(">HHH", sport, dport, n)
    if not sum_:
        return head + bytes(2) + payload
    return head + _sum(src + dst + b"\0\x11" + struct.pack(">H", n) + head + bytes(2) + payload) + payload


def tcp(payload=b"", sport=40000, dport=7000, seq=1000, ack=0, flags=0x10, window=8192, options=b"", src=IP_A, dst=IP_B):
    head = struct.pack(">HHIIHH", sport, dport, seq, ack, (5 + len(options) // 4) << 12 | flags, window)
    n = len(head) + 4 + len(options) + len(payload)
    sum_ = _sum(src + dst + b"\0\x06" + struct.pack(">H", n) + head + bytes(4) + options + payload)
    return head + sum_ + bytes(2) + options + payload


def segment(payload=b"", back=False, sport=40000, dport=7000, **more):
    """A whole TCP frame; back: from the other end."""
    a, b = (IP_B, IP_A) if back else (IP_A, IP_B)
    p, q = (dport, sport) if back else (sport, dport)
    return eth(ip(tcp(payload, p, q, src=a, dst=b, **more), 6, a, b))


def rows(frames, capture="c", step_ns=10**9):
    return [(capture, i + 1, 1, 1_700_000_000 * 10**9 + i * step_ns, len(f), f) for i, f in enumerate(frames)]


RAW = "capture_id string, number bigint, link_type int, ts_ns bigint, orig_len bigint, bytes binary"
