"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles; a shingle weighs its count in the text
times the mean inverse document frequency of its words, over all documents. Each sample draws, for
every shingle, Gamma(2,1) variates r and c and a uniform b that depend on the shingle alone, takes
t = floor(ln S / r + b), and keeps the shingle and t with the least ln c - r (t - b + 1): two
documents agree with the probability of their weighted Jaccard similarity. The draws come from a
pool of 65,536 triples reached by hashing, which spares the transcendental functions. Samples are
banded; candidates are verified by the exact weighted similarity of their whole texts.

Document frequencies are kept in 2**18 hashed counters, so what is broadcast has a fixed size.
Exact copies (same words in any case) share one class and one set of samples.

Defined results: a null text or one without words is its own group; a null id is never grouped and
is kept; rows that repeat an id are one document; a text under five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.blocking import link
from graphaxis.llm.scratch import materialise
from graphaxis.llm.textscan import chunks, mix, raw_bytes, shingle_hashes, small_batches, span_hashes, text_column, word_runs

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
COUNTERS = 1 << 18
POOL = 1 << 16
_U = np.uint64


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw_bytes(pc.utf8_lower(texts))
    starts, ends, first = word_runs(data, offsets)
    return span_hashes(data, starts, ends), first


def _counter(words: np.ndarray) -> np.ndarray:
    return (words & _U(COUNTERS - 1)).astype(np.int64)


def word_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log(1 + documents / documents with the word) for every counter."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COUNTERS, dtype=np.int64), 0
        for batch in batches:
            texts = text_column(batch.column(0))
            for a, b in chunks(texts, 1 << 20):
                words, first = _words(texts.slice(a, b - a))
                sizes = np.diff(first)
                owner = np.repeat(np.arange(b - a), sizes)
                once = np.unique(owner * COUNTERS + _counter(words))
                total += np.bincount(once & (COUNTERS - 1), minlength=COUNTERS)
                n += int((sizes > 0).sum())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["counter", "k"])

    summed = docs.select(text).mapInArrow(run, "counter long, k long").groupBy("counter").agg(F.sum("k").alias("k")).toArrow()
    counter, k = summed.column("counter").to_numpy(), summed.column("k").to_numpy()
    total = max(1, int(k[counter < 0].sum()))
    frequency = np.ones(COUNTERS)
    frequency[counter[counter >= 0]] = k[counter >= 0]
    return np.log1p(total / frequency)


def weighted_shingles(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, first words, distinct shingles, their weights and counts, and each text's first."""
    words, first = _words(texts)
    shingles, begin = shingle_hashes(words, first, SHINGLE)
    rarity = np.concatenate([[0.0], np.cumsum(idf[_counter(words)])])
    sizes = np.diff(begin)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = first[:-1][owner] + np.arange(len(shingles)) - begin[:-1][owner]
    stop = np.minimum(at + SHINGLE, first[1:][owner])
    mean = (rarity[stop] - rarity[at]) / np.maximum(stop - at, 1)
    order = np.lexsort((shingles, owner))
    s, o, w = shingles[order], owner[order], mean[order]
    if not len(s):
        return words, first, s, w, np.zeros(0, dtype=np.int64), begin
    new = np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))
    edge = np.flatnonzero(new)
    count = np.diff(np.append(edge, len(s)))
    return words, first, s[edge], w[edge] * count, count, np.searchsorted(o[edge], np.arange(len(texts) + 1))


class Sampler:
    """Consistent weighted samples of many weighted sets at once."""

    def __init__(self, samples: int, seed: int = 1910):
        rng = np.random.default_rng(seed)
        r = np.maximum(rng.gamma(2, 1, POOL), 1e-3)
        self.r, self.inverse = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = np.log(np.maximum(rng.gamma(2, 1, POOL), 1e-12)).astype(np.float32)
        self.b = rng.random(POOL, dtype=np.float32)
        self.multipliers = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)
        self.salts = rng.integers(0, 1 << 63, samples, dtype=np.uint64)

    def sample(self, shingles: np.ndarray, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A row for each sample, a column for each set (sets without elements: zero)."""
        full = np.flatnonzero(np.diff(begin) > 0)
        out = np.zeros((len(self.salts), len(begin) - 1), dtype=np.uint64)
        if not len(full):
            return out
        log_s = np.log(weights).astype(np.float32)
        starts = begin[:-1][full]
        for d, (multiplier, salt) in enumerate(zip(self.multipliers, self.salts)):
            scattered = shingles * multiplier
            at = (scattered >> _U(48)).astype(np.int64)
            b, r = self.b[at], self.r[at]
            t = np.floor(log_s * self.inverse[at] + b)
            order = self.log_c[at] - r * (t - b + np.float32(1)) + np.float32(128)
            # A positive float's bits sort as it does; below them stands what was drawn.
            low = ((scattered ^ salt) + t.astype(np.int64).view(np.uint64) * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93) >> _U(32)
            key = np.maximum(order, np.float32(1e-6)).view(np.uint32).astype(np.uint64) << _U(32) | low
            out[d, full] = np.minimum.reduceat(key, starts) & _U(0xFFFFFFFF)
        return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A row for each set, a column for each band's key."""
    rows = samples.reshape(BANDS, ROWS, -1)
    key = np.zeros((BANDS, rows.shape[2]), dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, i] + _U(1))
    return mix(key + np.arange(BANDS, dtype=np.uint64)[:, None]).T


def _text_keys(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    n = len(first) - 1
    sizes = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], sizes)
    keys = []
    for salt in (1, 2):
        spread = mix(words * _U(2 * salt + 1) + mix(place.astype(np.uint64) + _U(salt << 40)))
        total = np.concatenate([[_U(0)], np.cumsum(spread)])
        keys.append(mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return keys[0][:n], keys[1][:n]


def signatures(docs: DataFrame, idf: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n`` words, text keys ``h`` and ``g``, ``bands`` and the guard ``a``, ``b``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # COUNTERS numbers
    names = ["id", "n", "h", "g", "a", "b", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            texts = text_column(batch.column(1))
            for a, b in chunks(texts, 1 << 20):
                words, first, shingles, weights, _, begin = weighted_shingles(texts.slice(a, b - a), shared.value)
                samples = sampler.sample(shingles, weights, begin)
                keys = bands(samples).view(np.int64)
                total = np.concatenate([[0.0], np.cumsum(weights)])
                edge = pa.array(np.arange(b - a + 1) * BANDS, pa.int32())
                h, g = _text_keys(words, first)
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(h), pa.array(g), *map(pa.array, guards(samples, total[begin[1:]] - total[begin[:-1]])), pa.ListArray.from_arrays(edge, pa.array(keys.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, h long, g long, a long, b long, bands array<long>")


def similarity(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of texts side by side."""
    n = len(left)
    s, o, w = [], [], []
    for texts in (left, right):
        _, _, shingles, weights, _, begin = weighted_shingles(texts, idf)
        s.append(shingles)
        w.append(weights)
        o.append(np.repeat(np.arange(n), np.diff(begin)))
    total = np.bincount(np.concatenate(o), weights=np.concatenate(w), minlength=n)
    shingle, owner, weight = np.concatenate(s), np.concatenate(o), np.concatenate(w)
    order = np.lexsort((shingle, owner))
    shingle, owner, weight = shingle[order], owner[order], weight[order]
    both = np.flatnonzero((shingle[1:] == shingle[:-1]) & (owner[1:] == owner[:-1]))
    shared = np.bincount(owner[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
    return shared / np.maximum(total - shared, 1e-12)


#: Columns of a dense piece of the matrices that are multiplied.
_COLUMNS = 4096


def linked_matrix(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Which texts of the left are at the threshold with which of the right.

    A shingle that occurs k times is k elements of its own, so that the weight of what two texts
    share is a product of matrices; it is added up over pieces of the columns.
    """
    sides = []
    for texts in (left, right):
        _, _, shingles, weights, count, begin = weighted_shingles(texts, idf)
        owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(begin)), count)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        key = mix(np.repeat(shingles, count) + level.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        sides.append((owner, key, np.repeat(weights / np.maximum(count, 1), count)))
    common = np.intersect1d(sides[0][1], sides[1][1])
    total = [np.bincount(o, weights=w, minlength=len(t)) for (o, _, w), t in zip(sides, (left, right))]
    shared = np.zeros((len(left), len(right)))
    for at in range(0, len(common), _COLUMNS):
        piece = common[at : at + _COLUMNS]
        dense = []
        for (owner, key, weight), texts, weighted in zip(sides, (left, right), (True, False)):
            column = np.minimum(np.searchsorted(piece, key), len(piece) - 1)
            use = piece[column] == key
            m = np.zeros((len(texts), len(piece)))
            m[owner[use], column[use]] = weight[use] if weighted else 1.0
            dense.append(m)
        shared += dense[0] @ dense[1].T
    return shared >= THRESHOLD * np.maximum(total[0][:, None] + total[1][None, :] - shared, 1e-12)


def _verifier(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = text_column(batch.column(3)), text_column(batch.column(4))
            for a, b in chunks(left, 1 << 20):
                for c, d in chunks(right.slice(a, b - a), 1 << 20):
                    at = slice(a + c, a + d)
                    same = similarity(left.slice(a + c, d - c), right.slice(a + c, d - c), idf.value) >= THRESHOLD
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_numpy()[at][same]) for i in range(3)], names=kept)

    kept = ["u", "v", "lead"]

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.select(*kept, "a", "b").mapInArrow(run, "u long, v long, lead long").dropDuplicates(["u", "v"])

    return verify


#: Of 2-bit digests of the 56 samples so many must agree: at the threshold 48 do, give or take 3.
LEAST_AGREEING = 36
_LOW = (1 << BANDS * ROWS) - 1
_WEIGHT_STEPS = 2000  # of the logarithm of a text's total weight
_MOST_STEPS = int(-np.log(THRESHOLD) * _WEIGHT_STEPS) + 3


def guards(samples: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two longs for each set: a bit of each sample in each, and above them half of the log weight."""
    place = np.arange(samples.shape[0], dtype=np.uint64)[:, None]
    step = np.clip(np.log(np.maximum(total, 1.0)) * _WEIGHT_STEPS, 0, 65535).astype(np.uint64)
    one = ((samples & _U(1)) << place).sum(axis=0, dtype=np.uint64) | (step >> _U(8)) << _U(56)
    two = ((samples >> _U(1) & _U(1)) << place).sum(axis=0, dtype=np.uint64) | (step & _U(255)) << _U(56)
    return one.view(np.int64), two.view(np.int64)


def _guard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Enough samples agree, and total weights are within the ratio that the threshold demands."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    differ = ((a[0] ^ b[0]) | (a[1] ^ b[1])) & _U(_LOW)
    steps = [((x[0] >> _U(56)) << _U(8) | x[1] >> _U(56)).astype(np.int64) for x in (a, b)]
    return (np.bitwise_count(differ) <= BANDS * ROWS - LEAST_AGREEING) & (np.abs(steps[0] - steps[1]) <= _MOST_STEPS)


def _guard_sql(g: Column, h: Column, g2: Column, h2: Column) -> Column:
    differ = g.bitwiseXOR(g2).bitwiseOR(h.bitwiseXOR(h2)).bitwiseAND(F.lit(_LOW))
    step = lambda x, y: F.shiftrightunsigned(x, 56) * 256 + F.shiftrightunsigned(y, 56)
    return (F.bit_count(differ) <= BANDS * ROWS - LEAST_AGREEING) & (F.abs(step(g, h) - step(g2, h2)) <= _MOST_STEPS)


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id with ``class_id`` (least id of its exact copies), ``component_id``, ``kept``."""
    idf = word_frequencies(docs, text)
    signed = materialise(signatures(docs, idf, id, text), "signatures")
    classes = signed.where("n > 0 and id is not null").groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("bands").alias("bands"))
    classes = materialise(classes, "classes")
    blocks = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("node"), F.col("a").alias("g"), F.col("b").alias("h"))
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # COUNTERS numbers
    payload = texts.select(F.col("id").alias("node"), F.col("text").alias("payload"))
    found = link(blocks, _guard, _guard_sql, payload, _verifier(shared), lambda a, b: linked_matrix(text_column(a), text_column(b), shared.value))
    row = signed.select("id", "n", "h", "g").join(classes.select("h", "g", "rep"), ["h", "g"], "left")
    row = row.withColumn("class_id", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = row.join(found, F.col("class_id") == F.col("node"), "left")
    component = F.coalesce("component", "class_id")
    return out.select(F.col("id").alias(id), "class_id", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with the columns they came with.

    Rows without an id all stay; of rows that repeat an id the least one, by text and then by the
    other columns, does.
    """
    stay = groups(docs.select(id, text), id, text).where(F.col("kept") & F.col(id).isNotNull()).select(F.col(id).alias(id)).distinct()
    named = docs.where(F.col(id).isNotNull()).join(stay, id, "left_semi")
    order = [text, *[c for c, kind in docs.dtypes if c not in (id, text) and "map<" not in kind and "variant" not in kind]]
    least = named.groupBy(F.col(id).alias("k")).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row"))
    return least.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.where(F.col(id).isNull()))
