"""Findings of frames, counted without their trees where header fields tell all of them.

A frame is plain if its findings are those of its checksums and of its place in its stream: TCP or UDP under a whole header,
with options that can be read and a payload of no known protocol. Plain frames are read side by side, and reach the task that
sweeps their stream as records of header fields and payload, packed by stream. There the run of frames with which a stream
begins in order is passed over at once; from the first frame on that is out of order, or from the other side, each is observed
by itself. All other frames are dissected, with the state of their stream.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.dissect import apps, flow, layers, stage
from tidewire.dissect.headers import _Window, headers, read
from tidewire.dissect.tree import Cursor, Tree

NOT_FINDINGS = ("tcp.analysis.bytes_in_flight", "tcp.analysis.duplicate_ack_num", "tcp.analysis.duplicate_ack_frame")
SAMPLE = 32  # fixed value
TOTAL = "capture_id string, field string, summary string, severity bigint, grp bigint, count bigint, first bigint, frames array<bigint>"

#: frames of a block of numbers are put in order by one task at once; a row holds so many of its frames, and bytes of payload
BLOCK, ROW_FRAMES, ROW_BYTES = 1024, 16, 8192
RECORD = np.dtype([("number", "<i8"), ("ts", "<i8"), ("seq", "<u4"), ("ack", "<u4"), ("size", "<u4"), ("window", "<u2"), ("flags", "<u2"), ("marks", "u1"), ("scale", "u1")])
BAD_IP, BAD_TCP, BAD_UDP, HARD, FRESH, BACK = 1, 2, 4, 8, 16, 32  # marks; BACK: sent by the end that comes last in the key
NO_SCALE = 255
CHECKSUMS = {BAD_IP: "Bad IPv4 header checksum", BAD_TCP: "Bad TCP checksum", BAD_UDP: "Bad UDP checksum"}
ROW = f"capture_id string, key binary, block bigint, records binary, payload binary, link int, orig_len bigint, raw binary, whole {stage.WHOLE}"
_WANT = {"deep", "fragment", "ip_src", "ip6_src", "l3", "head", "l4", "l4_end", "tcp_src", "tcp_dst", "udp_src", "udp_dst", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_hdr", "tcp_window", "udp_length"}
_APP_PORTS, _UDP_PORTS = (80, 443, 8080, 8443), (53, 67, 68, 5353)
_FIRST_BYTES = np.array(sorted({20, 21, 22, 23, 24} | {s[0] for s in apps._STARTS}), np.uint8)


def told(t: Tree) -> Iterator[tuple[str, str | None, int | None, int | None]]:
    """field, summary, severity and group of each finding of a tree, with the expert record that follows it."""
    n = len(t.field)
    for i, f in enumerate(t.field):
        if f.startswith("tcp.analysis.") and f not in NOT_FINDINGS or f in ("_ws.checksum.bad", "_ws.malformed"):
            has = i + 3 < n and t.field[i + 1] == "_ws.expert"
            yield (f, t.text[i + 1] or t.text[i], t.u[i + 2], t.u[i + 3]) if has else (f, t.text[i], None, None)


def _end(addr: bytes, v6: bool, port: int) -> bytes:
    return (addr if v6 else addr[:4]) + port.to_bytes(2, "big")


def _key(src: dict, dst: dict) -> tuple[bytes, bool]:
    """The bytes of both ends of a flow, the lesser first, and whether the sender's come last."""
    a, b = (_end(bytes(e["addr"]), e["v6"], e["port"]) for e in (src, dst))
    return (a + b, False) if a <= b else (b + a, True)


def _numbers(column: pa.Array, missing: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _binary(data: bytes | memoryview, sizes: np.ndarray) -> pa.Array:
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


class _Sums:
    """Sums of the 16-bit words of any range of a batch's bytes."""

    def __init__(self, w: _Window):
        total = lambda part: np.r_[0, np.cumsum(part, dtype=np.int64)]
        self.even, self.odd = total(w.data[0::2]), total(w.data[1::2])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        even, odd = self.even[b + 1 >> 1] - self.even[a + 1 >> 1], self.odd[b >> 1] - self.odd[a >> 1]
        return np.where(a & 1, odd * 256 + even, even * 256 + odd)


def _options_read(options: bytes) -> bool:
    x = layers.Context(0, 0, layers.Options())
    layers._each_option(Cursor(options, 0), x, layers._tcp_option, "tcp.options.data")
    return "_ws.malformed" not in x.tree.field


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """ROWs of the frames of a batch of RAW that may have findings; fragments are left out."""
    capture, number, link, ts = batch.column(0), _numbers(batch.column(1), 0), _numbers(batch.column(2), -1), _numbers(batch.column(3), 0)
    orig, column, n = _numbers(batch.column(4), 0), batch.column(5), batch.num_rows
    got, w = read(column, link, _WANT), _Window(column)
    col = {c: got[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in _WANT if not c.startswith("ip") and c not in ("deep", "fragment")}
    has = lambda c: got[c].is_valid().to_numpy(zero_copy_only=False)
    flag = lambda c: got[c].to_numpy(zero_copy_only=False)
    data = lambda a, b: w.data[a:b].tobytes()
    v4, v6, fragment = has("ip_src"), has("ip6_src"), flag("fragment")
    shallow = ~flag("deep") & ~fragment & (v6 | (col["head"] == 20))
    tcp, udp = shallow & (col["tcp_hdr"] >= 0), shallow & (col["udp_length"] >= 0)
    some = tcp | udp
    l3, l4, end, header = (np.where(some, x, 0) for x in (w.start + col["l3"], w.start + col["l4"], w.start + col["l4_end"], col["tcp_hdr"]))
    marks, flags = np.zeros(n, np.uint8), np.where(tcp, col["tcp_flags"], 0)

    sums = _Sums(w)
    stated = w.data[np.where(some & v4, l3 + 10, 0)] | w.data[np.where(some & v4, l3 + 11, 0)]
    marks[some & v4 & (stated != 0) & (sums(l3, np.where(some, l3 + 20, 0)) % 65535 != 0)] |= BAD_IP
    length = np.where(udp, col["udp_length"], end - l4)
    pseudo = sums(np.where(some, l3 + np.where(v6, 8, 12), 0), np.where(some, l3 + np.where(v6, 40, 20), 0)) + np.where(udp, 17, 6) + (length >> 16) + (length & 0xFFFF)
    stated = w.data[np.where(udp, l4 + 6, 0)] | w.data[np.where(udp, l4 + 7, 0)]
    verified = tcp | (udp & (stated != 0) & (length <= end - l4))
    bad = verified & ((pseudo + sums(l4, np.where(verified, l4 + length, l4))) % 65535 != 0)
    marks[bad & tcp] |= BAD_TCP
    marks[bad & udp] |= BAD_UDP

    at = l4 + header
    size, scale = np.where(tcp, end - at, 0), np.full(n, NO_SCALE, np.uint8)
    hard = tcp & (size > 0) & (np.isin(col["tcp_src"], _APP_PORTS) | np.isin(col["tcp_dst"], _APP_PORTS))
    for i in np.flatnonzero(tcp & ~hard & (size > 0) & np.isin(w.data[np.where(size > 0, at, 0)], _FIRST_BYTES)).tolist():
        start = data(at[i], min(at[i] + 16, end[i]))
        hard[i] = apps.is_tls(start) or apps.is_http(start)
    for i in np.flatnonzero(tcp & ~hard & (header > 20)).tolist():
        options = data(l4[i] + 20, at[i])
        hard[i] = not _options_read(options)
        if flags[i] & 2:
            shift = layers.window_scale(options)
            scale[i] = NO_SCALE if shift is None else min(shift, 14)
    dissected = udp & (np.minimum(length - 8, end - l4 - 8) > 0) & (np.isin(col["udp_src"], _UDP_PORTS) | np.isin(col["udp_dst"], _UDP_PORTS))
    marks[hard] |= HARD
    marks[tcp & (flags & 0x12 == 2)] |= FRESH

    # a key of two numbers: the ends of IPv4, or a place in the list of other keys
    lo, hi, others = np.zeros(n, np.int64), np.full(n, -2, np.int64), {}
    if (tcp & v4).any():
        src, dst = (w.number(col["l3"] + o, 4, tcp & v4)[0] << 16 | col[p] for o, p in ((12, "tcp_src"), (16, "tcp_dst")))
        lo, hi = np.where(tcp & v4, np.minimum(src, dst), lo), np.where(tcp & v4, np.maximum(src, dst), hi)
        marks[tcp & v4 & (src > dst)] |= BACK

    def keyed(i: int, key: bytes, back: bool) -> None:
        lo[i], hi[i] = others.setdefault(key, len(others)), -1
        marks[i] |= BACK if back else 0

    for i in np.flatnonzero(tcp & v6).tolist():
        a, b = (data(l3[i] + o, l3[i] + o + 16) + int(col[p][i]).to_bytes(2, "big") for o, p in ((8, "tcp_src"), (24, "tcp_dst")))
        keyed(i, min(a, b) + max(a, b), a > b)
    take = tcp | (marks & (BAD_IP | BAD_UDP) != 0)
    for i in np.flatnonzero(~fragment & (~some | dissected)).tolist():
        x = layers.frame(data(w.start[i], w.start[i] + w.size[i]), int(link[i]), int(number[i]), int(ts[i]), int(orig[i]))
        src, dst, proto, fresh = stage._ends(x)
        take[i] = proto == 6 or next(told(x.tree), None) is not None
        marks[i] = HARD | (FRESH if fresh else 0)
        if proto == 6:
            keyed(i, *_key(src, dst))

    block, caught = number // BLOCK, _numbers(capture.dictionary_encode().indices, -1)
    at_ = np.flatnonzero(take)
    at_ = at_[np.lexsort((number[at_], block[at_], hi[at_], lo[at_], caught[at_]))]
    hard, size = marks[at_] & HARD != 0, np.where(marks[at_] & HARD != 0, 0, size[at_])
    same = np.zeros(len(at_), bool)
    same[1:] = (lo[at_][1:] == lo[at_][:-1]) & (hi[at_][1:] == hi[at_][:-1]) & (block[at_][1:] == block[at_][:-1]) & (caught[at_][1:] == caught[at_][:-1]) & ~hard[1:] & ~hard[:-1]
    before, place = np.cumsum(size) - size, np.arange(len(at_))
    group = np.maximum.accumulate(np.where(same, 0, place)) if len(at_) else place
    piece = (place - group) // ROW_FRAMES * (1 << 40) + (before - before[group]) // ROW_BYTES
    same[1:] &= piece[1:] == piece[:-1]
    begin = np.flatnonzero(~same)
    frames = np.diff(np.r_[begin, len(at_)])
    records = np.zeros(len(at_), RECORD)
    for name, v in (("number", number), ("ts", ts), ("seq", col["tcp_seq"]), ("ack", col["tcp_ack"]), ("window", col["tcp_window"]), ("flags", flags), ("marks", marks), ("scale", scale)):
        records[name] = v[at_]
    records["size"] = size
    after = before + size
    bytes_ = np.repeat(at[at_] - before, size) + np.arange(int(size.sum()))
    payload = w.data[bytes_].tobytes()
    first = at_[begin]
    ends4 = np.stack([lo[first], hi[first]], axis=1).astype(">i8").view(np.uint8).reshape(-1, 2, 8)[:, :, 2:].tobytes()
    more = list(others)
    key = [ends4[12 * i : 12 * i + 12] if h >= 0 else more[l] if h == -1 else None for i, (l, h) in enumerate(zip(lo[first].tolist(), hi[first].tolist()))]
    own = pa.array(first), pa.array(~(marks[first] & HARD != 0))
    only = lambda values, kind: pc.if_else(own[1], pa.scalar(None, kind), values.take(own[0]).cast(kind))
    cols = [capture.take(own[0]), pa.array(key, pa.binary()), pa.array(block[first]), _binary(records.tobytes(), frames * RECORD.itemsize), _binary(payload, np.add.reduceat(size, begin) if len(begin) else size), only(batch.column(2), pa.int32()), only(batch.column(4), pa.int64()), only(column, pa.binary()), pa.nulls(len(first), _WHOLE)]
    assert not len(after) or after[-1] == len(payload)
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


_WHOLE = pa.struct([("state", pa.string()), ("value", pa.binary()), ("why", pa.string()), ("parts", pa.list_(stage._PART))])
_KINDS = (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), _WHOLE)
_NAMES = ["capture_id", "key", "block", "records", "payload", "link", "orig_len", "raw", "whole"]


def _fragments(raw: DataFrame) -> DataFrame:
    """ROWs of IPv4 fragments, with what reassembly says of each. Frames that are none by their first bytes are not looked at."""
    # type and fragment bits, in one look at the bytes, so that an expression that makes them is not repeated
    seen = F.overlay(F.substring("bytes", 13, 10), F.lit(b""), F.lit(3), F.lit(6))
    none = (F.col("link_type") == 1) & seen.isin(*(F.lit(b"\x08\0" + bytes([f, 0])) for f in (0, 0x40, 0x80, 0xC0)))
    f = stage.reassembled(headers(raw.where(~F.coalesce(none, F.lit(False))).select(*stage.RAW), stage._FRAGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for capture, number, link, ts, orig, raw_, whole, src, dst, proto, fresh in stage._rows(b):
                record, key = np.zeros(1, RECORD), None
                if proto == 6:
                    key, back = _key(src, dst)
                    record["marks"] = (FRESH if fresh else 0) | (BACK if back else 0)
                record["number"], record["ts"], record["marks"] = number or 0, ts or 0, record["marks"] | HARD
                out.append((capture, key, (number or 0) // BLOCK, record.tobytes(), b"", link, orig, raw_ or b"", whole))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(_KINDS)], names=_NAMES)

    return f.select(*stage.RAW, "whole", "src_end", "dst_end", "flow_proto", "fresh").mapInArrow(run, ROW)


class _Totals:
    """Findings counted by capture and kind, with the least SAMPLE numbers of each."""

    def __init__(self):
        self.count, self.least, self.new = {}, {}, {}

    def add(self, capture: str | None, kind: tuple, numbers: Iterable[int]) -> None:
        got = self.new.setdefault((capture, *kind), [])
        got.extend(numbers)
        if len(got) > 1 << 16:
            self._merge((capture, *kind))

    def add_all(self, capture: str | None, kind: tuple, numbers: np.ndarray) -> None:
        k = (capture, *kind)
        if len(numbers):
            self.count[k] = self.count.get(k, 0) + len(numbers)
            few = np.partition(numbers, SAMPLE)[:SAMPLE] if len(numbers) > SAMPLE else numbers
            self.least[k] = np.sort(np.r_[self.least.get(k, few[:0]), few])[:SAMPLE]

    def _merge(self, k: tuple) -> None:
        self.add_all(k[0], k[1:], np.array(self.new.pop(k), np.int64))

    def rows(self) -> pa.RecordBatch:
        for k in list(self.new):
            self._merge(k)
        keys, count, least = list(self.count), list(self.count.values()), [v.tolist() for v in self.least.values()]
        self.__init__()
        cols = [pa.array([k[i] for k in keys], pa.string() if i < 3 else pa.int64()) for i in range(5)]
        cols += [pa.array(count, pa.int64()), pa.array([v[0] for v in least], pa.int64()), pa.array(least, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["capture_id", "field", "summary", "severity", "grp", "count", "first", "frames"])


_KIND = {name: (f"tcp.analysis.{name}", said, severity, 2) for name, (severity, said) in flow.FINDINGS.items()}


def _sender(key: bytes, back: int) -> tuple[bytes, int]:
    end = key[len(key) // 2 :] if back else key[: len(key) // 2]
    return end[:-2], int.from_bytes(end[-2:], "big")


def _rebuilt(r: np.void, key: bytes, payload: bytes) -> tuple[bytes, int]:
    """A frame with a plain frame's header fields and payload, and its link type."""
    (src, sport), (dst, dport) = _sender(key, r["marks"] & BACK), _sender(key, ~r["marks"] & BACK)
    options = bytes([3, 3, r["scale"], 0]) if r["scale"] != NO_SCALE else b""
    be = lambda v, n: int(v).to_bytes(n, "big")
    tcp = be(sport, 2) + be(dport, 2) + be(r["seq"], 4) + be(r["ack"], 4) + be((5 + len(options) // 4) << 12 | int(r["flags"]), 2) + be(r["window"], 2) + bytes(4) + options + payload
    if len(src) == 16:
        return be(6 << 28, 4) + be(min(len(tcp), 0xFFFF), 2) + b"\x06\x40" + src + dst + tcp, 229
    return b"\x45\0" + be(20 + len(tcp) if len(tcp) < 0xFFEC else 0, 2) + bytes(4) + b"\x40\x06\0\0" + src + dst + tcp, 228


class _Sweep:
    """Findings of ROWs that are sorted by key, capture and block, with the state of one stream at a time."""

    def __init__(self):
        self.totals, self.at, self.state, self.begun = _Totals(), None, None, None

    def __call__(self, b: pa.RecordBatch) -> None:
        """All rows of some blocks of keys."""
        capture, key, n = b.column(0), b.column(1), b.num_rows
        counts = np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset :][: n + 1]) // RECORD.itemsize
        start = int(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset])
        r = np.frombuffer(b.column(3).buffers()[2], RECORD, int(counts.sum()), start)
        row = np.repeat(np.arange(n), counts)
        flow_of, coded = np.cumsum(_changes(capture) | _changes(key)), capture.dictionary_encode()
        f = flow_of[row]
        number, seq = np.ascontiguousarray(r["number"]), np.ascontiguousarray(r["seq"])
        order = None
        if not ((f[1:] > f[:-1]) | (number[1:] > number[:-1]) | ((number[1:] == number[:-1]) & (seq[1:] >= seq[:-1]))).all():
            order = np.lexsort((seq, number, f))  # repeated numbers by sequence number, so that each run counts the same
            r, row, f, number = r[order], row[order], f[order], number[order]
        marks, flags = np.ascontiguousarray(r["marks"]), np.ascontiguousarray(r["flags"])
        hard = marks & HARD != 0

        c = _numbers(coded.indices, -1)[row]
        for code, name in [(i, v) for i, v in enumerate(coded.dictionary.to_pylist())] + ([(-1, None)] if capture.null_count else []):
            own = (c == code) & ~hard
            for mark, said in CHECKSUMS.items():
                self.totals.add_all(name, ("_ws.checksum.bad", said, 4, 1), number[own & (marks & mark != 0)])

        # where a stream begins in order, all from one side, it has no findings
        seq, size, back = r["seq"].astype(np.int64), r["size"].astype(np.int64), marks & BACK
        new = np.r_[True, f[1:] > f[:-1]]
        fresh = new | (marks & FRESH != 0)
        end = seq + size + (flags >> 1 & 1) + (flags & 1) & flow.WRAP - 1
        quiet = ~hard & (r["window"] != 0)
        quiet[1:] &= fresh[1:] | ((flags[1:] & 2 == 0) & (seq[1:] == end[:-1]) & (back[1:] == back[:-1]))
        keyless = ~key.is_valid().to_numpy(zero_copy_only=False)[row]
        quiet |= keyless
        goes_on = self.at is not None and self.at == (capture[0].as_py(), key[0].as_py())
        if goes_on:
            quiet[: int(np.argmax((fresh & (np.arange(len(f)) > 0)) | (f > f[0]))) if (fresh[1:] | (f[1:] > f[0])).any() else len(f)] = False
        begin = np.flatnonzero(fresh)
        stream = np.cumsum(fresh) - 1
        loud = np.flatnonzero(~quiet | (keyless & hard))
        late = np.searchsorted(loud, begin) if len(loud) else np.zeros(len(begin), np.int64)
        until = np.r_[begin[1:], len(f)]
        stop = np.where(late < len(loud), loud[np.minimum(late, len(loud) - 1)], len(f)) if len(loud) else np.full(len(begin), len(f))
        stop = np.minimum(stop, until)
        todo = np.flatnonzero(stop < until)
        last = int(stream[-1]) if len(f) else -1
        if len(begin) and (not len(todo) or todo[-1] != last):
            todo = np.r_[todo, last]  # its state is needed if the stream goes on
        offsets = None
        for s in todo.tolist():
            a, stop_, b_ = int(begin[s]), int(stop[s]), int(until[s])
            i = int(row[a])
            k, name = key[i].as_py(), capture[i].as_py()
            if k is None:
                for j in range(a, b_):
                    if hard[j]:
                        self._dissected(b, int(row[j]), name, r[j], None)
                continue
            if a == 0 and goes_on and not (marks[0] & FRESH and self.begun != int(number[0])):
                state = self.state
            else:
                state = flow.Stream()
                if marks[a] & FRESH:
                    self.begun = int(number[a])
                if stop_ > a:
                    self._passed(state, r[a:stop_], int(end[stop_ - 1]), _sender(k, back[a]))
            for j in range(stop_, b_):
                if hard[j]:
                    self._dissected(b, int(row[j]), name, r[j], state)
                    continue
                number_, ts, seq_, ack, size_, window, flag, mark, shift = r[j].item()
                side = state.side_of(_sender(k, mark & BACK))
                if size_ and state.sides[side].held:
                    if offsets is None:
                        offsets = self._payloads(b, r, row, order)
                    raw, link = _rebuilt(r[j], k, offsets(j))
                    x = layers.frame(raw, link, number_, ts, len(raw), stream=state, stream_id=0)
                    for kind in told(x.tree):
                        if kind[0] != "_ws.checksum.bad":
                            self.totals.add(name, kind, (number_,))
                    continue
                syn, fin, rst = bool(flag & 2), bool(flag & 1), bool(flag & 4)
                seen = state.observe(side, number_, ts, seq_, ack, size_, window, syn, fin, rst, bool(flag & 16), shift if syn and shift != NO_SCALE else None)
                if seen.sequence or seen.flags:
                    for found in seen.names():
                        self.totals.add(name, _KIND[found], (number_,))
                if rst or fin:
                    state.drop(side)
            self.at, self.state = (name, k), state

    @staticmethod
    def _passed(state: flow.Stream, r: np.ndarray, end: int, sender: tuple[bytes, int]) -> None:
        """The state after a run in order from one side."""
        state.starter = sender
        me, first, z = state.sides[0], r[0], r[-1]
        me.first, me.next, me.advanced = int(first["seq"]), end, int(first["ts"])
        if first["flags"] & 2 and first["scale"] != NO_SCALE:
            me.scale = int(first["scale"])
        me.window = int(z["window"]) if z["flags"] & 2 else int(z["window"]) << me.scale & flow.WRAP - 1
        for x in r[::-1]:
            if x["flags"] & 16:
                me.ack, me.repeated_frame = int(x["ack"]), int(x["number"])
                break
        for x in r[:0:-1]:
            if x["size"] or x["flags"] & 1:
                me.advanced = int(x["ts"])
                break

    def _dissected(self, b: pa.RecordBatch, i: int, name: str | None, r: np.void, state: flow.Stream | None) -> None:
        link, orig, raw, whole = (b.column(c)[i].as_py() for c in range(5, 9))
        x = layers.frame(raw or b"", stage._link(link), int(r["number"]), int(r["ts"]), orig or 0, layers.Options(), state, None if state is None else 0, stage._whole(whole))
        for kind in told(x.tree):
            self.totals.add(name, kind, (int(r["number"]),))

    @staticmethod
    def _payloads(b: pa.RecordBatch, r: np.ndarray, row: np.ndarray, order: np.ndarray | None):
        """The payload of a frame by its place."""
        sizes = r["size"].astype(np.int64)
        if order is not None:
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            sizes, row = sizes[back], row[back]  # as they came
        ends = np.cumsum(sizes)
        first = np.r_[0, ends][np.searchsorted(row, row)]
        at = (ends - sizes) - first
        if order is not None:
            at, row = at[order], row[order]
        return lambda j: b.column(4)[int(row[j])].as_py()[int(at[j]) : int(at[j]) + int(r["size"][j])]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        out[1:] = pc.not_equal(a, b).fill_null(False).to_numpy(zero_copy_only=False) | (valid[1:] != valid[:-1])
    return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gc.disable()  # trees hold no cycles
    sweep, kept = _Sweep(), None
    for b in batches:
        if not b.num_rows:
            continue
        if kept is not None:
            b = pa.concat_batches([kept, b])
        changed = np.flatnonzero(_changes(b.column(0)) | _changes(b.column(1)) | _changes(b.column(2)))
        whole = int(changed[-1])  # the last block may go on in the next batch
        if whole:
            sweep(b.slice(0, whole))
        kept = b.slice(whole)
        if len(sweep.totals.count) + len(sweep.totals.new) > 4096:
            yield sweep.totals.rows()
    if kept is not None:
        sweep(kept)
    yield sweep.totals.rows()


def totals(raw: DataFrame) -> DataFrame:
    """TOTAL rows of the findings of dissect(raw), each of part of the frames: count, the first frame's number and the first
    SAMPLE numbers of a capture's findings of a kind. raw: RAW columns; a null number counts as 0."""
    raw = raw.select(*stage.RAW)
    rows = raw.mapInArrow(lambda batches: (_packed(b) for b in batches if b.num_rows), ROW).unionByName(_fragments(raw))
    at = ["capture_id", "key", F.when(F.col("key").isNull(), F.pmod(F.xxhash64("block"), F.lit(4096)))]
    rows = rows.repartition(*at).sortWithinPartitions("key", "capture_id", "block")
    return rows.mapInArrow(_swept, TOTAL)
