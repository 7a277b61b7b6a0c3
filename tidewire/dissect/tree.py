"""Cursors over bytes and the tree they fill. A layout is text: `type:field` items, read together and then written.

Types: u1 u2 u3 u4 unsigned, m MAC, 4 IPv4, 6 IPv6, xN bytes; a field of `-` is read and not written.
"""

from __future__ import annotations

import ipaddress
from functools import lru_cache


class Unreadable(Exception):
    """A layer whose bytes cannot be read."""

    @classmethod
    def short(cls, at: int, need: int, have: int) -> Unreadable:
        return cls(f"truncated at offset {at}: need {need} bytes, {have} left")

    @classmethod
    def invalid(cls, what: str, at: int) -> Unreadable:
        return cls(f"invalid {what} at offset {at}")


def mac_text(b: bytes) -> str:
    return b.hex(":")


def ip4_text(b: bytes) -> str:
    return ".".join(map(str, b))


def ip6_text(b: bytes) -> str:
    a = ipaddress.IPv6Address(bytes(b))
    return f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped else str(a)


def addr_text(b: bytes | None) -> str:
    return "" if b is None else {4: ip4_text, 6: mac_text, 16: ip6_text}[len(b)](b)


@lru_cache(maxsize=512)
def _layout(text: str) -> tuple[tuple[str, int, str], ...]:
    out = []
    for item in text.split():
        kind, field = item.split(":")
        size = {"m": 6, "4": 4, "6": 16}.get(kind) or int(kind[1:])
        out.append((kind[0], size, field))
    return tuple(out)


class Cursor:
    """A window of a source: data holds the window, base is where it begins in the source."""

    __slots__ = ("data", "base", "pos")

    def __init__(self, data: bytes, base: int, pos: int = 0):
        self.data, self.base, self.pos = data, base, pos

    @property
    def at(self) -> int:
        return self.base + self.pos

    @property
    def left(self) -> int:
        return len(self.data) - self.pos

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise Unreadable.short(self.at, n, self.left)
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def sub(self, n: int) -> Cursor:
        at = self.at
        return Cursor(self.take(n), at)

    def rest(self) -> bytes:
        return self.data[self.pos :]

    def read(self, layout: str) -> tuple[list, list[tuple[str, str, int, int]]]:
        """Values, and what to write for them."""
        values, spans = [], []
        for kind, size, field in _layout(layout):
            at = self.at
            raw = self.take(size)
            values.append(int.from_bytes(raw, "big") if kind == "u" else raw)
            spans.append((kind, field, at, at + size))
        return values, spans


COLUMNS = ("field", "depth", "source", "start", "end", "u", "b", "s", "a", "text")


class Tree:
    """Nodes in depth-first order, by column."""

    def __init__(self):
        self.field, self.depth, self.source, self.start, self.end = [], [], [], [], []
        self.u, self.b, self.s, self.a, self.text = [], [], [], [], []
        self.level, self.current, self.open = 0, 0, []
        self.covered = 0

    def leaf(self, field: str, start: int, end: int, u: int | None = None, b: bool | None = None, s: str | None = None, a: bytes | None = None, text: str | None = None) -> int:
        self.field.append(field)
        self.depth.append(self.level)
        self.source.append(self.current)
        self.start.append(start)
        self.end.append(end)
        self.u.append(u)
        self.b.append(b)
        self.s.append(s)
        self.a.append(a)
        self.text.append(text)
        if self.current == 0 and end > self.covered:
            self.covered = end
        return len(self.field) - 1

    def aside(self, field: str, start: int, end: int) -> None:
        """A node for bytes that another layer accounts for."""
        covered = self.covered
        self.leaf(field, start, end)
        self.covered = covered

    def begin(self, field: str, start: int, end: int, **value) -> int:
        i = self.leaf(field, start, end, **value)
        self.open.append(i)
        self.level += 1
        return i

    def close(self, end: int | None = None) -> None:
        i = self.open.pop()
        self.level -= 1
        if end is not None:
            self.end[i] = end
            if self.source[i] == 0 and end > self.covered:
                self.covered = end

    def unwind(self, level: int) -> None:
        while self.level > level:
            self.close()

    def write(self, values: list, spans: list[tuple[str, str, int, int]]) -> None:
        for v, (kind, field, start, end) in zip(values, spans):
            if field == "-":
                continue
            if kind == "u":
                self.leaf(field, start, end, u=v)
            elif kind == "x":
                self.leaf(field, start, end)
            else:
                self.leaf(field, start, end, a=v)

    def bits(self, field: str, start: int, end: int, value: int, parts: list[tuple[str, int | bool]], text: str | None = None) -> None:
        """A value with the parts of it below."""
        self.begin(field, start, end, u=value, text=text)
        for name, v in parts:
            self.leaf(name, start, end, **({"b": v} if isinstance(v, bool) else {"u": v}))
        self.close()
