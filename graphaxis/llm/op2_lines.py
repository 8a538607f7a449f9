"""Fuzzy line dedup.

A line is normalised to its lower-case words of letters and digits. Equal lines form a class. Two
lines of five words or more are alike if the edit similarity of their sequences of words is 0.8 or
more (one less edits by the longer length); shorter ones only if they are equal. Lines without a
word (rules, brackets) take no part.

Blocks: a line of ``l`` words is within ``L // 5`` edits of one of ``L >= l``, of which ``L - l`` or more
are insertions; an insertion parts one pair of adjacent words and another edit two, so at most
``2 * (l // 5)`` of the line's word pairs, and one more where ``l % 5 == 4``, are lost in the other.
Pigeonhole: one more of its pairs than that, least first in an order that all lines share, holds one
that the other line has among its own. Those pairs are the blocks of lines of up to 19 words, which
misses no line at 0.8. Pairs say too little of longer lines in a large corpus; from 16 words on a line's
blocks are the ``MOST_KEYS`` least of its runs of three words, a consistent weighted sample: lines at
exactly 0.8 miss each other about once in a thousand (README). As a line of 15 words is alike to
none of over 18, every two lines that may be alike have blocks of one kind. The order is
that of exponential draws, seeded by the run, over its rarity, so that common runs are rarely keys.
SimHash blocks, the method first chosen, meet one line pair in five at this similarity (README).

Pairs of lines that pass a check of their lengths and of the parities of their words, which drops
none that are alike, are verified. Of each connected group the first occurrence (least document id,
then line) stays; the others go, within one document too.

Defined results: a null text stays null and counts no lines; a null id's lines are never compared;
rows that repeat an id are one document, whose equal line numbers are one line; a document whose
every line goes keeps an empty text; ties don't arise, as ids and line numbers are an order; an
empty table gives an empty one; a text of any length is read whole; other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.blocking import link
from graphaxis.llm.scratch import discard, materialise
from graphaxis.llm.textscan import chunks, mix, raw_bytes, runs, small_batches, span_hashes, text_column

LEAST_WORDS = 5
SIMILARITY = 0.8
MOST_KEYS = 10
#: Lines of up to so many words have pairs as keys; those of so many or more have runs of three.
PAIRS_TO, TRIPLES_FROM = 19, 16
#: Hashed counters of words, from all documents.
COUNTERS = 1 << 18
#: A word that is one of so many has half of a rare word's weight.
HALF_WEIGHT = 1e-5
#: Bits of the first guard that hold a line's length; the others, and the second guard's, are parities.
LENGTH_BITS = 12
PARITIES = 128 - LENGTH_BITS
_U = np.uint64

_WORD = np.zeros(256, dtype=bool)
for _a, _b in (("a", "z"), ("0", "9")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_WORD[128:] = True


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of lines with words: ids, line numbers, all word hashes, and each line's first word."""
    for batch in batches:
        ids, texts = batch.column(0), text_column(batch.column(1))
        for a, b in chunks(texts, 1 << 19):
            data, offsets = raw_bytes(pc.utf8_lower(texts.slice(a, b - a)))
            # Lines as texts of their own: a line begins at each offset and after each break.
            breaks = np.flatnonzero(data == 10) + 1
            edge = np.unique(np.concatenate([offsets, breaks]))
            doc = np.searchsorted(offsets, edge[:-1], "right") - 1
            before = np.searchsorted(breaks, offsets[:-1], "right")
            no = np.searchsorted(breaks, edge[:-1], "right") - before[doc]
            starts, ends, first = runs(_WORD[data], edge)
            counts = np.diff(first)
            use = np.flatnonzero(counts)
            if len(use):
                yield ids.take(pa.array(a + doc[use])), no[use], span_hashes(data, starts, ends), np.append(first[:-1][use], first[-1])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The hashes of all words, which no line break is part of."""
    for batch in batches:
        texts = text_column(batch.column(1))
        for a, b in chunks(texts, 1 << 19):
            data, offsets = raw_bytes(pc.utf8_lower(texts.slice(a, b - a)))
            yield span_hashes(data, *runs(_WORD[data], offsets)[:2])


def _hash(words: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    place = (np.arange(len(words)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.uint64)
    return mix(np.add.reduceat(mix(words * _U(2 * k + 1) + mix(place + _U(k << 40))), begin[:-1])).view(np.int64)


def _source(docs: DataFrame, id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def _counter(words: np.ndarray) -> np.ndarray:
    return (words & _U(COUNTERS - 1)).astype(np.int64)


def word_weights(docs: DataFrame, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """For each counter a weight from 1 (rare) towards 0, by its share of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for words in _words(batches):
            total += np.bincount(_counter(words), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["counter", "k"])

    summed = _source(docs, id, text).mapInArrow(run, "counter long, k long").groupBy("counter").agg(F.sum("k").alias("k")).toArrow()
    count = np.zeros(COUNTERS)
    count[summed.column("counter").to_numpy()] = summed.column("k").to_numpy()
    return (1 / (1 + count / max(count.sum(), 1.0) / HALF_WEIGHT)).astype(np.float32)


def _least_runs(words: np.ndarray, begin: np.ndarray, weights: np.ndarray, width: int, use: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines ``use`` the ``most`` runs of ``width`` words of least draw, and the line of each."""
    sizes = np.where(use, np.diff(begin) - width + 1, 0)
    line = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(line)) + np.repeat(begin[:-1] - first, sizes)
    run, weight = np.full(len(at), _U(width)), np.zeros(len(at))
    rarity = weights[_counter(words)].astype(np.float64)
    for j in range(width):
        run = mix(run * _U(3) + words[at + j])
        weight = np.maximum(weight, rarity[at + j])
    draw = -np.log(((mix(run + _U(5)) >> _U(12)).astype(np.float64) + 1) / (1 << 52)) / weight
    # Positive floats sort as their bits do: the line's place stands above the draw's leading bits.
    room = 64 - max(1, len(sizes).bit_length())
    rank = np.argsort(line.astype(np.uint64) << _U(room) | draw.view(np.uint64) >> _U(64 - room))
    run, line = run[rank], line[rank]
    take = np.arange(len(run)) - first[line] < most[line]
    take[1:] &= (run[1:] != run[:-1]) | (line[1:] != line[:-1])
    return run[take], line[take]


def _line_keys(words: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each line of three words or more, and how many each has."""
    counts = np.diff(begin)
    pairs = _least_runs(words, begin, weights, 2, counts <= PAIRS_TO, 2 * (counts // 5) + (counts % 5 == 4) + 1)
    triples = _least_runs(words, begin, weights, 3, counts >= TRIPLES_FROM, np.full(len(counts), MOST_KEYS))
    key, line = (np.concatenate(x) for x in zip(pairs, triples))
    order = np.argsort(line, kind="stable")
    return key[order].view(np.int64), np.bincount(line, minlength=len(counts))


def _guards(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each line: its length, and for each bit whether the words of that bit are odd in number."""
    at = (mix(words + _U(29)) >> _U(8)) % _U(PARITIES) + _U(LENGTH_BITS)
    bit = _U(1) << (at & _U(63))
    one = np.bitwise_xor.reduceat(np.where(at < 64, bit, _U(0)), begin[:-1])
    two = np.bitwise_xor.reduceat(np.where(at < 64, _U(0), bit), begin[:-1])
    return (one | np.minimum(np.diff(begin), (1 << LENGTH_BITS) - 1).astype(np.uint64)).view(np.int64), two.view(np.int64)


def line_table(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, line number ``no``, two hashes ``h`` and ``g``; and of lines that may be alike to others
    ``keys``, guards ``a`` and ``b``, and ``letters``: two bytes for each word.

    A task gives a line's keys once as long as it remembers it, so that copies don't crowd a block.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, no, words, begin in _lines(batches):
            h, g, counts = _hash(words, begin, 3), _hash(words, begin, 4), np.diff(begin)
            if len(seen) > 1 << 18:
                seen.clear()
            new = np.zeros(len(h), dtype=bool)
            new[np.unique(h, return_index=True)[1]] = True
            new &= counts >= LEAST_WORDS
            new[new] = np.fromiter((x not in seen for x in h[new].tolist()), dtype=bool, count=int(new.sum()))
            seen.update(h[new].tolist())
            words, held = words[np.repeat(new, counts)], np.where(new, counts, 0)
            inner = np.concatenate([[0], np.cumsum(counts[new])])
            keys, n_keys, a, b = np.zeros(0, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            if len(words):
                keys, n_keys[new] = _line_keys(words, inner, shared.value)
                a[new], b[new] = _guards(words, inner)
            letters = (words % _U(50000) + _U(256)).astype(">u2").tobytes()  # below the surrogates
            column = lambda x: pa.array(x, mask=~new)
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]), pa.int32()), pa.array(keys))
            ends = np.concatenate([[0], np.cumsum(2 * held)]).astype(np.int32)
            spelled = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters)])
            arrays = [ids, pa.array(no), pa.array(h), pa.array(g), column(a), column(b), listed, spelled]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "no", "h", "g", "a", "b", "keys", "letters"])

    return _source(docs, id, text).mapInArrow(run, "id long, no long, h long, g long, a long, b long, keys array<long>, letters binary")


def _changed_most(long, short):
    """Each of the edits, a fifth of the longer length, changes two parities, an insertion one."""
    return 2 * (long // 5) - (long - short)


def _guard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = (1 << LENGTH_BITS) - 1
    one, two = a[0] & most, b[0] & most
    long, short = np.maximum(one, two), np.minimum(one, two)
    changed = np.bitwise_count(((a[0] ^ b[0]) & ~most).view(np.uint64)).astype(np.int64) + np.bitwise_count((a[1] ^ b[1]).view(np.uint64))
    return (long == most) | ((5 * short >= 4 * long) & (changed <= _changed_most(long, short)))


def _guard_sql(g: Column, h: Column, g2: Column, h2: Column) -> Column:
    most = (1 << LENGTH_BITS) - 1
    one, two = g.bitwiseAND(F.lit(most)), g2.bitwiseAND(F.lit(most))
    long, short = F.greatest(one, two), F.least(one, two)
    changed = F.bit_count(g.bitwiseXOR(g2).bitwiseAND(F.lit(~most))) + F.bit_count(h.bitwiseXOR(h2))
    return (long == most) | ((5 * short >= 4 * long) & (changed <= 2 * F.floor(long / 5) - (long - short)))


#: Parities of the longer guard, in longs.
FINE = 6


def _fine_guards(held: DataFrame) -> DataFrame:
    """``node`` and ``f``: parities of the line's words over so many bits that edits hardly hide each other."""
    names = [f"f{i}" for i in range(FINE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).to_pylist()
            words = np.frombuffer("".join(lines).encode("utf-16-le"), dtype=np.uint16)
            at = mix(words.astype(np.uint64) + _U(41)) % _U(64 * FINE)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lines])])[:-1]
            bits = [np.bitwise_xor.reduceat(np.where(at >> _U(6) == i, _U(1) << (at & _U(63)), _U(0)), begin) for i in range(FINE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in bits]], names=["node", *names])

    made = held.select("node", "payload").mapInArrow(run, "node long, " + ", ".join(f"{n} long" for n in names))
    return made.select("node", F.struct(*names).alias("f"))


def _fine_sql(g: Column, g2: Column, f: Column, f2: Column) -> Column:
    most = (1 << LENGTH_BITS) - 1
    one, two = g.bitwiseAND(F.lit(most)), g2.bitwiseAND(F.lit(most))
    long, short = F.greatest(one, two), F.least(one, two)
    changed = reduce(lambda x, y: x + y, [F.bit_count(f[f"f{i}"].bitwiseXOR(f2[f"f{i}"])) for i in range(FINE)])
    return (long == most) | (changed <= 2 * F.floor(long / 5) - (long - short))


def _alike(pairs: DataFrame) -> DataFrame:
    """Pairs at the edit similarity over words: one letter of ``a`` and ``b`` stands for each word."""
    longest = F.greatest(F.length("a"), F.length("b"))
    near = F.least(F.length("a"), F.length("b")) >= SIMILARITY * longest
    return pairs.withColumn("most", F.floor(longest * (1 - SIMILARITY) + 1e-9).cast("int")).where(near).where(F.expr("levenshtein(a, b, most) >= 0"))


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``gone``, the numbers of the lines to drop, for documents that lose any."""
    lines = materialise(line_table(docs, word_weights(docs, id, text), id, text), "lines")
    blocks = lines.where("a is not null").select(F.explode("keys").alias("key"), F.col("h").alias("node"), F.col("a").alias("g"), F.col("b").alias("h"))
    spelled = lines.where("a is not null").select(F.col("h").alias("node"), F.decode("letters", "UTF-16BE").alias("payload"))
    found = link(blocks, _guard, _guard_sql, spelled, lambda pairs: _alike(pairs).dropDuplicates(["u", "v"]), finer=(_fine_guards, _fine_sql))
    # Fixed-width aggregates are hashed, not sorted: the document that keeps a line first, then its line number.
    classes = lines.groupBy("h", "g").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    grouped = classes.join(found, F.col("h") == F.col("node"), "left").where("n > 1 or component is not null")
    grouped = materialise(grouped.select("h", "g", "n", "first", F.coalesce("component", "h").alias("grp")), "grouped")
    keepers = grouped.groupBy("grp").agg(F.min("first").alias("stay"), F.sum("n").alias("total")).where("total > 1").select("grp", "stay")
    repeated = materialise(grouped.join(keepers, "grp").select("h", "g", "grp", "stay"), "repeated")
    # Of the keeping document's own lines of a group the first stays: by group, then number, it stands first.
    own = F.when(F.col("id") == F.col("stay"), F.col("grp")).alias("own")
    held = lines.select("id", "no", "h", "g").join(repeated, ["h", "g"]).select("id", F.struct(own, F.col("no").cast("int").alias("no")).alias("line"))
    held = held.groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("held"))
    goes = F.filter("held", lambda x, i: x["own"].isNull() | ((i > 0) & (F.get("held", i - 1)["own"] == x["own"])))
    gone = held.select("id", F.transform(goes, lambda x: x["no"]).alias("gone")).where(F.size("gone") > 0)
    gone = materialise(gone, "gone")
    discard(lines, grouped, repeated, found)
    return gone


def _free(name: str, taken: list[str]) -> str:
    """A column name that no input column has."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _joined(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, Column, Column]:
    """Documents with the numbers of lines that go, and the lines of those that lose any as a column, computed once."""
    key, gone, split = (_free(f"__{n}", docs.columns) for n in ("id", "gone", "split"))
    lost = dropped_lines(docs, id, text).select(F.col("id").alias(key), F.col("gone").alias(gone))
    # Hinted: the lines that go grow with the input, so they are never broadcast, whatever their size here.
    # Those of a partition are hashed: they are a small part of its texts, which then need no sort.
    joined = docs.join(lost.hint("shuffle_hash"), F.col(id).cast("long") == F.col(key), "left")
    lines = F.when(F.col(gone).isNotNull(), F.split(text, "\n"))
    return joined.withColumn(split, F.explode(F.array(lines))), F.col(gone), F.col(split)


def _kept_text(text: str, gone: Column, split: Column) -> Column:
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    rest = F.array_join(F.transform(places, lambda i: F.get(split, i)), "\n")
    return F.when(gone.isNull(), F.col(text)).otherwise(rest)


def digests(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_lines``, ``n_dropped`` and the digest of the text that stays."""
    joined, gone, split = _joined(docs.select("doc_id", "text"), "doc_id", "text")
    return joined.select(
        "doc_id",
        F.greatest(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.greatest(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(_kept_text("text", gone, split), 256).alias("text_sha256"),
    )


def shortened(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents without repeated lines, with the columns they came with; ``length``, if there, follows the text."""
    joined, gone, split = _joined(docs, id, text)
    kinds = dict(docs.dtypes)
    rest = _kept_text(text, gone, split)
    made = {text: rest, length: F.when(gone.isNotNull(), F.length(rest).cast(kinds.get(length, "long"))).otherwise(F.col(length) if length in kinds else F.lit(None))}
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
