"""State of one stream across its frames: sequence analysis and messages that span segments; and of one datagram's fragments."""

from __future__ import annotations

from dataclasses import dataclass, field

WRAP = 1 << 32
OUT_OF_ORDER_NS, FAST_NS = 3_000_000, 20_000_000  # fixed values
LARGEST_HELD, HELD_IDLE_NS = 1 << 20, 60 * 10**9  # fixed values
LARGEST_DATAGRAM, FRAGMENT_IDLE_NS = 65_535, 30 * 10**9  # fixed values

#: finding -> (severity, summary), in the order they are reported; fixed values
FINDINGS = {
    "retransmission": (2, "This frame is a (suspected) retransmission"),
    "fast_retransmission": (2, "This frame is a (suspected) fast retransmission"),
    "spurious_retransmission": (2, "This frame is a (suspected) spurious retransmission"),
    "out_of_order": (2, "This frame is a (suspected) out-of-order segment"),
    "overlap": (3, "This frame overlaps bytes already seen"),
    "lost_segment": (3, "Previous segment(s) not captured (common at capture start)"),
    "duplicate_ack": (2, "This is a TCP duplicate ACK"),
    "zero_window": (3, "This frame advertises a zero window"),
    "window_full": (2, "This frame fills the peer's advertised window"),
    "keep_alive": (2, "This frame is a TCP keep-alive"),
    "ack_lost_segment": (3, "ACK for a segment that was not captured"),
}


def ahead(a: int, b: int) -> int:
    """How far a is ahead of b in sequence space, negative if behind."""
    return (a - b + WRAP // 2) % WRAP - WRAP // 2


@dataclass
class Side:
    """One direction of a TCP stream."""

    first: int | None = None  # sequence number of its first segment
    next: int = 0
    ack: int | None = None
    window: int = 0
    scale: int = 0
    repeats: int = 0
    repeated_frame: int = 0
    advanced: int = 0
    third_repeat: int | None = None
    held: bytes = b""
    held_proto: str = ""
    held_at: int = 0


@dataclass
class Seen:
    """What the analysis says of a segment."""

    sequence: str | None = None
    flags: list[str] = field(default_factory=list)
    in_flight: int = 0
    ack_number: int = 0
    ack_frame: int = 0

    def names(self) -> list[str]:
        found = set(self.flags) | ({self.sequence} if self.sequence else set())
        return [f for f in FINDINGS if f in found]


class Stream:
    """Sides 0 (the first sender's) and 1."""

    def __init__(self):
        self.sides = (Side(), Side())
        self.starter = None

    def side_of(self, sender) -> int:
        if self.starter is None:
            self.starter = sender
        return int(sender != self.starter)

    def observe(self, side: int, frame: int, ts: int, seq: int, ack: int, length: int, window: int, syn: bool, fin: bool, rst: bool, acks: bool, scale: int | None) -> Seen:
        me, peer, out = self.sides[side], self.sides[1 - side], Seen()
        if scale is not None:
            me.scale = min(scale, 14)
        offered = window if syn else window << me.scale & WRAP - 1
        span = length + syn + fin
        end = (seq + span) % WRAP
        fresh, expected = me.first is None, me.next
        if fresh:
            me.first, me.next, me.advanced = seq, end, ts
        else:
            gap, new = ahead(seq, expected), ahead(end, expected)
            if gap > 0:
                out.sequence = "lost_segment"
            elif span and new > 0:
                out.sequence = "overlap" if gap < 0 else None
            elif span:
                out.sequence = self._old(me, peer, end, ts)
            if new > 0:
                me.next, me.advanced = end, ts
            if length <= 1 and not (syn or fin or rst) and gap == -1:
                out.flags.append("keep_alive")
                out.sequence = None
        if offered == 0 and not (rst or fin or syn):
            out.flags.append("zero_window")
        if acks:
            same = me.ack == ack and not span and not rst and offered == me.window
            if same and peer.first is not None and ahead(ack, peer.next) < 0:
                me.repeats += 1
                if me.repeats == 3:
                    me.third_repeat = ts
                out.flags.append("duplicate_ack")
                out.ack_number, out.ack_frame = me.repeats, me.repeated_frame
            else:
                me.repeats, me.repeated_frame, me.third_repeat = 0, frame, None
            if peer.first is not None and ahead(ack, peer.next) > 0:
                out.flags.append("ack_lost_segment")
            me.ack = ack
        me.window = offered
        if peer.ack is not None and ahead(peer.ack, me.first) >= 0 and ahead(peer.ack, me.next) <= 0:
            out.in_flight = (me.next - peer.ack) % WRAP
        if length and 0 < peer.window <= out.in_flight:
            out.flags.append("window_full")
        return out

    @staticmethod
    def _old(me: Side, peer: Side, end: int, ts: int) -> str:
        """Why bytes come that were seen before."""
        if peer.ack is not None and ahead(end, peer.ack) <= 0:
            return "spurious_retransmission"
        if peer.third_repeat is not None and ts - peer.third_repeat <= FAST_NS:
            return "fast_retransmission"
        return "out_of_order" if ts - me.advanced <= OUT_OF_ORDER_NS else "retransmission"

    def hold(self, side: int, rest: bytes, proto: str, ts: int) -> bool:
        if not rest or len(rest) > LARGEST_HELD:
            return False
        s = self.sides[side]
        s.held, s.held_proto, s.held_at = bytes(rest), proto, ts
        return True

    def release(self, side: int, ts: int) -> tuple[bytes, str] | None:
        """Held bytes and their protocol, unless they waited too long; they are gone then."""
        s = self.sides[side]
        held, s.held = s.held, b""
        return (held, s.held_proto) if held and ts // 10**9 - s.held_at // 10**9 <= HELD_IDLE_NS // 10**9 else None

    def drop(self, side: int) -> None:
        self.sides[side].held = b""


class Fragments:
    """One datagram being put together; later bytes win."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.bytes, self.have, self.total, self.parts, self.seen = bytearray(), [], None, [], None

    def add(self, offset: int, more: bool, payload: bytes, frame: int, ts: int) -> tuple[str, bytes | str | None, list]:
        """('whole', bytes, parts), ('part', None, parts) or ('bad', why, parts)."""
        if self.seen is not None and self.seen // 10**9 < ts // 10**9 - FRAGMENT_IDLE_NS // 10**9:
            self.reset()
        end = offset + len(payload)
        if end > LARGEST_DATAGRAM:
            return "bad", "fragment exceeds maximum datagram size", []
        self.seen = ts
        if not more:
            if self.total not in (None, end):
                self.reset()
                return "bad", "conflicting total length", []
            self.total = end
        if self.total is not None and end > self.total:
            self.reset()
            return "bad", "fragment beyond datagram end", []
        if len(self.bytes) < end:
            self.bytes.extend(bytes(end - len(self.bytes)))
        self.bytes[offset:end] = payload
        self.parts.append((frame, offset, len(payload)))
        spans, self.have = sorted([*self.have, (offset, end)]), []
        for a, b in spans:
            if self.have and a <= self.have[-1][1]:
                self.have[-1] = (self.have[-1][0], max(b, self.have[-1][1]))
            else:
                self.have.append((a, b))
        if self.total is None or self.have != [(0, self.total)]:
            return "part", None, list(self.parts)
        whole, parts = bytes(self.bytes), self.parts
        self.reset()
        return "whole", whole, parts
