"""Vectorised text primitives on Arrow string buffers: chunks, word spans, rolling hashes.

Everything here works on whole batches with numpy. Words are maximal runs of bytes other than the
six ASCII white-space bytes; UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 3 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the rolling-hash base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        up = np.full(n, _BASE)
        down = np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 4 * CHUNK_BYTES:  # one huge document must not pin its tables in the worker
            return up, down
        _powers = (up, down)
    return _powers[0][:n], _powers[1][:n]


def text_column(column: pa.Array) -> pa.Array:
    """The column as strings with 32-bit or 64-bit offsets and nulls as empty texts."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes, at least one row each."""
    ends = byte_offsets(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def byte_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, the first at 0."""
    offsets = byte_offsets(texts)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs that don't cross an offset: starts, ends, and each text's first run."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    first = edge[edge < n]
    opens[first] = inside[first]
    last = edge[(edge > 0)] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(_IS_WORD[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte (or code point) span, independent of where it stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data))
    codes = _BYTE_CODES[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64) + _U(1))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(codes * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a text, and each text's first shingle.

    A text with fewer words has one shingle, all its words; a text without words has none.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = first[:-1][owner] + (np.arange(begin[-1]) - begin[:-1][owner])
    left = first[1:][owner] - at
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
    for j in range(width):
        out = out * _BASE + np.where(left > j, padded[at + j], _U(0))
    return mix(out), begin


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start..start+length-1 for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def small_batches(spark, rows: int = 1000) -> None:
    """Bound the Arrow batches by which texts reach Python, in rows and, where known, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
