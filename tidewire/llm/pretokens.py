"""Pre-tokenisation by code point classes, without regular expressions.

A text is an array of code points, each of a class. The splitting rule of the byte-level vocabularies is an automaton
over the classes; its states come from an associative scan of transition functions, and the piece boundaries from states
and neighbouring classes, all vectorised over many texts at once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

L, N, O, SP, WS, END, Q = range(7)  # letter, number, other, blank, other white space, between texts, apostrophe of a contraction
C = 6  # the state after an apostrophe that does begin a contraction; the other states are named as the classes
SENTINEL = 0x110000
#: Every class but the apostrophe leads to its own state, whatever came before.
TRANSITIONS = np.array([[L] * 7, [N] * 7, [O] * 7, [SP] * 7, [WS] * 7, [END] * 7, [C, C, O, O, C, C, C]], np.uint8)


#: White space of Unicode; fixed values
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16.0, first and last of each run, for Pythons whose own tables are older; fixed values
_LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(first code points, classes) of the runs of equal class, by general category. Made once in the driver; workers get
    the runs."""
    first_letter = [unicodedata.category(chr(c))[0] for c in range(SENTINEL)]
    kind = np.array([{"L": L, "N": N}.get(k, O) for k in first_letter], np.uint8)
    for code, runs in ((L, _LETTERS_16), (N, _NUMBERS_16)):
        for a, b in runs:
            kind[a : b + 1] = code
    kind[_WHITE] = WS
    kind[32] = SP
    first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    return first.astype(np.int32), kind[first]


def class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, kind = runs
    table = np.repeat(kind, np.diff(np.r_[first, SENTINEL]))
    return np.r_[table, np.uint8(END)].astype(np.uint8)


def scan_states(classes: np.ndarray, transitions: np.ndarray = TRANSITIONS) -> np.ndarray:
    """State after each position. Constant functions give theirs at once; the rest are composed by pointer doubling, in
    as many rounds as the logarithm of their longest run. The first position must have a constant function."""
    const = (transitions == transitions[:, :1]).all(1)
    state = transitions[classes, 0]
    todo = np.flatnonzero(~const[classes])
    if not len(todo):
        return state
    f, src = transitions[classes[todo]], todo - 1
    while True:
        k = np.searchsorted(todo, src)
        more = (k < len(todo)) & (todo[np.minimum(k, len(todo) - 1)] == src)
        if not more.any():
            break
        j = k[more]
        f[more], src[more] = np.take_along_axis(f[more], f[j].astype(np.intp), 1), src[j]
    state[todo] = f[np.arange(len(todo)), state[src]]
    return state


def piece_starts(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """True where a piece begins. points: code points, with SENTINEL first, last and between texts (each its own piece)."""
    c = table[points]
    q = np.flatnonzero(points == 39)
    ends = np.zeros(0, np.intp)
    if len(q):
        a, b = points[q + 1], points[np.minimum(q + 2, len(points) - 1)]
        one = np.isin(a, [115, 116, 109, 100])  # 's 't 'm 'd
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # 're 've 'll
        c[q[one | two]] = Q
        ends = np.where(one, q + 2, q + 3)
    s = scan_states(c)
    c[c == Q] = O
    prev = np.r_[np.uint8(END), s[:-1]]
    nxt = np.r_[c[1:], np.uint8(END)]
    start = np.ones(len(c), bool)
    start[((c == L) & ((prev == L) | (prev == C))) | (((c == L) | (c == N) | (c == O)) & (prev == SP)) | ((c == N) & (prev == N)) | ((c == O) & (prev == O))] = False
    white = (c == SP) | (c == WS)
    start[white & ((prev == SP) | (prev == WS)) & ((nxt == SP) | (nxt == WS) | (nxt == END))] = False
    if len(q):
        start[ends[s[q] == C]] = True
    return start


def split_texts(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes joined, with a byte before, between and behind; the byte offsets of the pieces; and for each
    text the index of its first piece, and one more. Piece k of text i spans offsets[k] to offsets[k + 1], for k from
    first[i] to first[i + 1] - 2: the last piece in that range is the separator."""
    joined = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    seps = np.cumsum([0, *(len(t) + 1 for t in texts)])
    width = (points >= 0x80).astype(np.uint8)
    if width.any():
        width += points >= 0x800
        width += points >= 0x10000
        offset = np.r_[0, np.cumsum(width + np.uint8(1), dtype=np.int64)]
    else:
        offset = np.arange(len(points) + 1)
    points = points.copy()
    points[seps] = SENTINEL
    starts = np.flatnonzero(piece_starts(points, table))
    return joined.encode("utf-8"), np.r_[offset[starts], offset[-1]], np.searchsorted(starts, seps) + 1
