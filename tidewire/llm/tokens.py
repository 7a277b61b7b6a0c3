"""Encoding texts with a byte-level pair-merging vocabulary.

Pieces come from pretokens; each distinct piece is merged once per worker and then found in a cache. The path of the
rank file is a parameter, the file is read in the driver and its ranks travel with the plan.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import pretokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_PIECES = 500_000  # distinct pieces kept per worker; beyond it the cache starts anew, results stay the same
BATCH_CHARS = 2_000_000  # texts are split together up to this size; a longer text is split alone


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank. O(n log n)."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    end = list(range(1, n + 1))  # the part that begins at i ends at end[i]
    before = list(range(-1, n))  # the part that ends at i begins at before[i]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        alive[end[i]] = 0
        end[i], before[e] = e, i
        if i and (r := ranks.get(piece[(b := before[i]) : e])) is not None:
            heapq.heappush(heap, (r, b, e))
        if e < n and (r := ranks.get(piece[i : end[e]])) is not None:
            heapq.heappush(heap, (r, i, end[e]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class _Cache(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = merge(piece, self.ranks)
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class Encoder:
    """Vocabulary, classes and cache of one process."""

    def __init__(self, ranks: dict[bytes, int], runs: tuple[np.ndarray, np.ndarray]):
        self.cache, self.table = _Cache(ranks), pretokens.class_table(runs)

    def pieces(self, texts: Sequence[str]) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Ids of each piece (separators: none), tokens before each piece, and each text's first piece."""
        joined, offset, first = pretokens.split_texts(list(texts), self.table)
        at = offset.tolist()
        cache = self.cache
        ids = [cache[joined[a:b]] for a, b in zip(at, at[1:])]
        for k in (first - 1).tolist():
            ids[k] = ()
        return ids, np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))], first

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin, with the end."""
        ids, upto, first = self.pieces(texts)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(upto[-1]))
        return flat, upto[first]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(load_ranks(path), pretokens.class_runs())


def local_encoder(path: str = VOCABULARY) -> Encoder:
    return _encoder(path)


_MADE: dict[str, Encoder] = {}  # a worker's encoders by vocabulary; their caches outlive its tasks


def _of_worker(vocabulary: str, shared) -> Encoder:
    """The worker's encoder. A function of the module, not of the task: what the task carries along would be new each time."""
    if (encoder := _MADE.get(vocabulary)) is None:
        encoder = _MADE[vocabulary] = Encoder(*shared.value)
    return encoder


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > BATCH_CHARS:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def _decoded(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of a BINARY column; null is the empty text, bytes that are not UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") if b else "" for b in column.to_pylist()]


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core for work that is heavy per row; input already split as finely stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _mapped(df: DataFrame, text: str, keep: Sequence[str], schema: T.StructType, vocabulary: str, out: Callable[[Encoder, list[str]], list[pa.Array]]) -> DataFrame:
    """mapInArrow over keep and the text: out gives the further columns of schema."""
    shared = df.sparkSession.sparkContext.broadcast((load_ranks(vocabulary), pretokens.class_runs()))  # a fixed vocabulary of some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _of_worker(vocabulary, shared)
        for batch in batches:
            done = 0
            for group in _grouped(_decoded(batch.column(len(keep)))):
                part = batch.slice(done, len(group))
                done += len(group)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *out(encoder, group)], names=schema.names)

    return spread(df.select(*keep, F.col(text).cast("binary").alias("__text"))).mapInArrow(run, schema)


def encode(df: DataFrame, text: str, keep: Sequence[str], offsets: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns and ids ARRAY<INT>, one row per row; offsets adds offsets ARRAY<BIGINT>, the byte of the text at which
    each token begins. Null, empty: an empty array. Repeated rows stay repeated; texts of any length are encoded whole;
    strings of special tokens are ordinary text. Columns outside keep are not read."""
    sizes = _sizes(vocabulary) if offsets else None

    def out(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        flat, at = encoder.encode(texts)
        at = pa.array(at.astype(np.int32))
        ids = pa.ListArray.from_arrays(at, pa.array(flat))
        if sizes is None:
            return [ids]
        upto = np.r_[0, np.cumsum(sizes[flat], dtype=np.int64)]
        begin = upto[np.asarray(at)]
        byte = upto[:-1] - np.repeat(begin[:-1], np.diff(np.asarray(at)))
        return [ids, pa.ListArray.from_arrays(at, pa.array(byte))]

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("offsets", T.ArrayType(T.LongType()))] if offsets else []))
    return _mapped(df, text, keep, schema, vocabulary, out)


def _sizes(vocabulary: str) -> np.ndarray:
    ranks = load_ranks(vocabulary)
    sizes = np.zeros(max(ranks.values()) + 1, np.int32)
    for b, i in ranks.items():
        sizes[i] = len(b)
    return sizes


def count(df: DataFrame, text: str, keep: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns and tokens BIGINT, the number of ids that encode gives."""

    def out(encoder: Encoder, texts: list[str]) -> list[pa.Array]:
        _, upto, first = encoder.pieces(texts)
        return [pa.array(np.diff(upto[first]))]

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("tokens", T.LongType())])
    return _mapped(df, text, keep, schema, vocabulary, out)


def decode(df: DataFrame, ids: str, keep: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """keep columns and text STRING from ids; null ids give null, ids outside the vocabulary nothing."""
    shared = df.sparkSession.sparkContext.broadcast({i: b for b, i in load_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = shared.value
        for batch in batches:
            texts = [None if x is None else b"".join(word.get(i, b"") for i in x).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=schema.names)

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("text", T.StringType())])
    return df.select(*keep, ids).mapInArrow(run, schema)
