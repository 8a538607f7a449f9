"""Byte-level BPE encoding and decoding.

Texts are split before merging by a nine-state automaton that reproduces the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regular expression: code points become classes by one table lookup, a class and the
class after it give a symbol, and each symbol is a transition function on states. Composing
functions is associative, so the state before every character comes from a blocked prefix scan
over a whole chunk at once. The slices between boundaries meet a cache of merged results.

Defined results: a null text encodes like an empty one (no ids); repeated rows each give a row;
other columns are ignored unless named, whatever their names; an empty table gives an empty one;
a text of any length is scanned whole, in windows that hand their state on.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.textscan import chunks, small_batches, text_column

# Symbols. The class of a code point is one of the first four; the others come from what follows.
LETTER, NUMBER, OTHER, SPACE_MID, SPACE_LAST, BLANK_LAST, APOS_1, APOS_2, RESET = range(9)
# States: what the character read last belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACES, SUFFIX_1, SUFFIX_2 = range(8)
N_STATES = 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state] (a token begins at this character)."""
    nxt = np.zeros((9, N_STATES), dtype=np.uint8)
    starts = np.ones((9, N_STATES), dtype=bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[symbol] = state
        starts[symbol, [state, AFTER_BLANK]] = False
    nxt[SPACE_MID], starts[SPACE_MID, IN_SPACES] = IN_SPACES, False
    nxt[SPACE_LAST] = FRESH
    nxt[BLANK_LAST] = AFTER_BLANK
    for symbol, state in ((APOS_1, SUFFIX_1), (APOS_2, SUFFIX_2)):
        nxt[symbol] = state
        nxt[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_BLANK]] = False
    nxt[:, SUFFIX_2], starts[:, SUFFIX_2] = SUFFIX_1, False
    nxt[:, SUFFIX_1], starts[:, SUFFIX_1] = FRESH, False
    nxt[RESET], starts[RESET] = FRESH, False
    return nxt, starts


NEXT, STARTS = _tables()
_classes: np.ndarray | None = None
# White space of the pattern's \s beyond the separator categories.
_EXTRA_SPACES = (9, 10, 11, 12, 13, 0x85)


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_MID for each code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))
            if kind[0] == "L":
                table[cp] = LETTER
            elif kind[0] == "N":
                table[cp] = NUMBER
            elif kind[0] == "Z":
                table[cp] = SPACE_MID
        table[list(_EXTRA_SPACES)] = SPACE_MID
        _classes = table
    return _classes


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of code points; at ``breaks`` stands a separator between texts."""
    sym = code_point_classes()[points]
    sym[breaks] = RESET
    after = np.append(sym[1:], np.uint8(RESET))
    last = (sym == SPACE_MID) & (after != SPACE_MID) & (after != RESET)
    sym[last] = np.where(points[last] == 32, BLANK_LAST, SPACE_LAST)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.append(points, np.zeros(2, dtype=points.dtype))
        one, two = padded[at + 1], padded[at + 2]
        sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS_1
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        sym[at[pair]] = APOS_2
    return sym


def token_starts(sym: np.ndarray, entry: int = FRESH) -> tuple[np.ndarray, int]:
    """Where tokens begin, by an associative scan of the symbols' transition functions; the state after the last."""
    n = len(sym)
    if not n:
        return np.zeros(0, dtype=np.int64), entry
    width = max(16, min(256, int(n**0.5)))
    blocks = -(-n // width)
    grid = np.full(blocks * width, RESET, dtype=np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    step = NEXT.reshape(-1)
    # Each block's whole function: one state per possible entry state.
    whole = np.tile(np.arange(N_STATES, dtype=np.int64), (blocks, 1))
    for row in grid:
        whole = step[row[:, None].astype(np.int64) * N_STATES + whole]
    # Inclusive scan of the blocks by doubling.
    shift = 1
    while shift < blocks:
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift].astype(np.int64), axis=1)
        shift *= 2
    state = np.full(blocks, entry, dtype=np.int64)
    state[1:] = whole[:-1, entry]
    begins = np.empty((width, blocks), dtype=bool)
    starts = STARTS.reshape(-1)
    end = (n - 1) - (blocks - 1) * width
    for i, row in enumerate(grid):
        at = row.astype(np.int64) * N_STATES + state
        begins[i] = starts[at]
        state = step[at]
        if i == end:
            leaving = int(state[-1])
    return np.flatnonzero(begins.T.reshape(-1)[:n]), leaving


class BytePairs:
    """Merges of a rank file, with a cache of slices already merged, of two generations bounded in bytes."""

    CACHE_BYTES = 64 << 20
    #: What an entry takes besides its slice and ids: two objects' heads and its place in the table.
    ENTRY_BYTES = 180

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (1 + max(self.ranks.values()))
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int32)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cached_bytes = 0

    def rest(self) -> None:
        """Drop the older generation, so that an idle worker holds the ranks and ``CACHE_BYTES`` at most."""
        self.older = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one slice: the adjacent pair of lowest rank, leftmost first, merges next."""
        known = self.ranks.get(piece)
        if known is not None:
            return (known,)
        ranks, n = self.ranks, len(piece)
        if n > 400:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        none = sys.maxsize
        pair = [ranks.get(parts[i] + parts[i + 1], none) for i in range(n - 1)]
        while pair:
            best = min(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1" * n)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode_slices(self, data: bytes, bounds: list[int]) -> bytes:
        """Ids of the consecutive slices between ``bounds``, as packed 32-bit integers."""
        slices = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        cache = self.cache
        fresh = set(slices).difference(cache)
        if self.cached_bytes > self.CACHE_BYTES:
            self.older, self.cache, self.cached_bytes = cache, {}, 0
            cache, fresh = self.cache, set(slices)
        older, merge, added = self.older, self.merge, 0
        for s in fresh:
            packed = older.get(s)
            cache[s] = packed = array("i", merge(s)).tobytes() if packed is None else packed
            added += len(s) + len(packed)
        self.cached_bytes += added + self.ENTRY_BYTES * len(fresh)
        return b"".join(map(cache.__getitem__, slices))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_loaded: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = BytePairs(path)
    return _loaded[path]


#: Characters scanned at a time; what a scan holds beside the text is bounded by it, however long a text is.
WINDOW = 1 << 18
#: Bytes of short texts handled together.
CHUNK_BYTES = 1 << 20


def _bounds(points: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By window: the byte offsets at which tokens begin, and the byte offset of every break; breaks take no bytes."""
    state, at = FRESH, 0
    for a in range(0, len(points), WINDOW):
        b = min(a + WINDOW, len(points))
        seen = points[a : b + 2]  # what a class depends on lies up to two characters ahead
        cut = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b + 2)] - a
        starts, state = token_starts(symbols(seen, cut)[: b - a], state)
        width = 1 + (seen[: b - a] > 0x7F).astype(np.int64) + (seen[: b - a] > 0x7FF) + (seen[: b - a] > 0xFFFF)
        cut = cut[cut < b - a]
        width[cut] = 0
        ends = np.cumsum(width)
        yield at + ends[starts] - width[starts], at + ends[cut]
        at += int(ends[-1])


def encode_texts(texts: list[str], pairs: BytePairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of each text's ids."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    del joined
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    breaks = (np.cumsum(lengths + 1) - 1)[:-1]
    data = "".join(texts).encode("utf-8", "surrogatepass")
    packed, text_ends, open_at = [], [], np.zeros(0, dtype=np.int64)
    for starts, cuts in _bounds(points, breaks):
        text_ends.append(cuts)
        bounds = np.concatenate([open_at, starts])
        if len(bounds) > 1:
            packed.append(pairs.encode_slices(data, bounds.tolist()))
        open_at = bounds[-1:]
    if len(open_at):
        packed.append(pairs.encode_slices(data, [int(open_at[0]), len(data)]))
    ids = np.frombuffer(b"".join(packed), dtype=np.int32)
    ends = np.cumsum(pairs.lengths[ids], dtype=np.int64)
    edge = np.concatenate([[0], *text_ends, [len(data)]])
    return ids, np.diff(np.searchsorted(ends, edge, "right"))


def _encoded(texts: pa.Array, pairs: BytePairs) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows [a, b), their ids, where each row's ids begin, and each id's last byte + 1 within its row."""
    for a, b in chunks(texts, CHUNK_BYTES):
        ids, counts = encode_texts(texts.slice(a, b - a).to_pylist(), pairs)
        edge = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(pairs.lengths[ids], dtype=np.int64)])
        yield a, b, ids, edge, ends[1:] - np.repeat(ends[edge[:-1]], counts)


def _mapped(docs: DataFrame, ranks: str, text: str, keep: tuple[str, ...], columns: dict[str, pa.DataType], kinds: dict[str, str], make) -> DataFrame:
    """Columns ``keep`` and ``columns``, which ``make`` gives for the rows of a chunk."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks)
        try:
            for batch in batches:
                schema = pa.schema([batch.schema.field(i) for i in range(len(keep))] + [pa.field(n, t) for n, t in columns.items()])
                for a, b, *rest in _encoded(text_column(batch.column(len(keep))), pairs):
                    kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays(kept + make(pairs, *rest), schema=schema)
        finally:
            pairs.rest()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return source.mapInArrow(run, ", ".join(kept + [f"{n} {k}" for n, k in kinds.items()]))


_LIST = pa.list_(pa.int32())


def _lists(ids: np.ndarray, edge: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    at = pa.array(edge, type=pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(ends.astype(np.int32)))]


def encode(docs: DataFrame, ranks: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` array<int> and ``ends`` (each id's last byte + 1)."""
    return _mapped(docs, ranks, text, keep, {"ids": _LIST, "ends": _LIST}, {"ids": "array<int>", "ends": "array<int>"}, lambda pairs, *rest: _lists(*rest))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``decoded`` binary, the bytes the ids stand for."""
    keep = tuple(encoded.columns) if keep is None else keep
    source = encoded.select(*keep, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks)
        for batch in batches:
            column = batch.column(len(keep))
            values = column.flatten().to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            decoded = [pairs.decode(values[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            kept = [batch.column(i) for i in range(len(keep))]
            schema = pa.schema([batch.schema.field(i) for i in range(len(keep))] + [pa.field("decoded", pa.binary())])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(decoded, type=pa.binary())], schema=schema)

    kept = encoded.select(*keep).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["decoded binary"])
    return source.mapInArrow(run, out)


def _digests(pairs: BytePairs, ids: np.ndarray, edge: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Number of ids, digest of the ids, digest of what they decode to, and its length."""
    of_ids, of_bytes, n_bytes = [], [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        decoded = pairs.decode(ids[a:b])
        of_ids.append(hashlib.sha256(" ".join(map(str, ids[a:b].tolist())).encode()).hexdigest())
        of_bytes.append(hashlib.sha256(decoded).hexdigest())
        n_bytes.append(len(decoded))
    return [pa.array(np.diff(edge)), pa.array(of_ids, type=pa.string()), pa.array(of_bytes, type=pa.string()), pa.array(n_bytes, type=pa.int64())]


_DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_bytes": pa.int64()}
_DIGEST_KINDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "n_bytes": "long"}


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode and decode every text; per document the id count and the two digests."""
    return _mapped(docs, ranks, "text", ("doc_id",), _DIGESTS, _DIGEST_KINDS, _digests)


def encoded_with_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per row the ids with their offsets, their number, and the digests of ids and round trip."""
    kinds = {"ids": "array<int>", "ends": "array<int>"} | _DIGEST_KINDS
    make = lambda pairs, ids, edge, ends: _lists(ids, edge, ends) + _digests(pairs, ids, edge, ends)
    return _mapped(docs, ranks, "text", ("doc_id",), {"ids": _LIST, "ends": _LIST} | _DIGESTS, kinds, make)
