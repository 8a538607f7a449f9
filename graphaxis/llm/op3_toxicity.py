"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

Severity has three grades: 0 for texts labelled clean; toxic texts are 1 or 2 as their number of
words that tell toxic from clean training texts lies up to or over the median of toxic texts.
P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector for all thresholds, so a word
that raises one grade raises all. The result is the expected grade, and toxic if P(grade >= 1)
reaches a half.

Fitted on a bounded sample of labelled texts (``MAX_TEXTS`` of least hashed id); every text is
scored whole. Defined results: a null or wordless text scores by the thresholds alone; without
labels of both kinds nothing is toxic; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.textscan import chunks, raw_bytes, runs, small_batches, span_hashes, text_column

MAX_TEXTS = 12_000
#: A word is a feature if its lean towards toxic texts has at least this z-score
#: (signed root of the likelihood ratio).
LEAST_Z = 5.0
LEAST_TEXTS = 5
MAX_FEATURES = 5_000
GRADES = 3
RIDGE = 1e-5
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def word_counts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its bounds, the hash of every word, and each text's first word."""
    for a, b in chunks(texts):
        data, offsets = raw_bytes(pc.utf8_lower(texts.slice(a, b - a)))
        starts, ends, first = runs(_LETTER[data], offsets)
        yield a, b, span_hashes(data, starts, ends).view(np.int64), first


@dataclass
class Ordinal:
    """Features (sorted word hashes), shared weights and ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -50, 50)))


def strength(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def fit(word: np.ndarray, row: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> Ordinal:
    """``word``, ``row``, ``count``: sparse entries; ``toxic``: the label by row."""
    none = Ordinal(np.zeros(0, dtype=np.int64), np.zeros(0), np.full(GRADES - 1, 50.0))
    if not len(word) or toxic.all() or not toxic.any():
        return none
    names, at = np.unique(word, return_inverse=True)
    texts = np.bincount(at, minlength=len(names))
    bad = np.bincount(at, weights=toxic[row], minlength=len(names))
    n_bad, n_good = toxic.sum(), (~toxic).sum()
    # Signed root of the likelihood ratio that a word's presence depends on the label.
    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(expected, 1e-12))

    n_bad, n = toxic.sum(), len(toxic)
    good = texts - bad
    ratio = term(bad, texts * n_bad / n) + term(good, texts * (n - n_bad) / n)
    ratio += term(n_bad - bad, (n - texts) * n_bad / n) + term(n - n_bad - good, (n - texts) * (n - n_bad) / n)
    z = np.sqrt(np.maximum(2 * ratio, 0)) * np.where(bad > texts * n_bad / n, 1, -1)
    tells = np.flatnonzero((z >= LEAST_Z) & (texts >= LEAST_TEXTS))
    tells = np.sort(tells[np.argsort(-z[tells], kind="stable")][:MAX_FEATURES])
    if not len(tells):
        return none
    column = np.full(len(names), -1)
    column[tells] = np.arange(len(tells))
    use = column[at] >= 0
    j, i, x = column[at[use]], row[use], strength(count[use].astype(np.float64))
    hits = np.bincount(i, weights=count[use], minlength=len(toxic))
    middle = np.median(hits[toxic])
    grade = np.where(toxic, np.where(hits > middle, 2, 1), 0)
    return _descend(names[tells], i, j, x, grade, len(toxic))


def _descend(features: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, grade: np.ndarray, n: int) -> Ordinal:
    """Adam on the cumulative-link likelihood; thresholds stay ordered by positive gaps."""
    k = GRADES - 1
    at_most = np.clip(np.array([(grade <= g).mean() for g in range(k)]), 1e-3, 1 - 1e-3)
    start = np.log(at_most / (1 - at_most))
    theta = np.concatenate([np.zeros(len(features)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    p = len(features)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -50, 50)))
    for step in range(1, 601):
        w, gaps = theta[:p], np.exp(theta[p + 1 :])
        cuts = theta[p] + np.concatenate([[0.0], np.cumsum(gaps)])
        linear = np.bincount(i, weights=w[j] * x, minlength=n)
        below = np.column_stack([np.zeros(n), sigmoid(cuts[None, :] - linear[:, None]), np.ones(n)])
        rows = np.arange(n)
        upper, lower = below[rows, grade + 1], below[rows, grade]
        mass = np.maximum(upper - lower, 1e-9)
        slope_u, slope_l = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        by_linear = slope_u - slope_l  # of the negative log likelihood
        g_w = np.bincount(j, weights=by_linear[i] * x, minlength=p) / n + RIDGE * w
        g_cut = np.array([(-(slope_u * (grade == g)) + slope_l * (grade == g + 1)).sum() for g in range(k)]) / n
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[p] + np.concatenate([[0.0], np.cumsum(np.exp(theta[p + 1 :]))])
    return Ordinal(features, theta[:p], cuts)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Ordinal:
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(id).alias("id"), F.col(toxic).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(MAX_TEXTS)
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marked), "id").select("toxic", "text")  # at most MAX_TEXTS ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0), text_column(batch.column(1))
            for a, b, words, first in word_counts(texts):
                found = [np.unique(words[s:e], return_counts=True) for s, e in zip(first[:-1], first[1:])]
                edge = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
                values, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [labels.slice(a, b - a), pa.ListArray.from_arrays(edge, pa.array(values)), pa.ListArray.from_arrays(edge, pa.array(counts.astype(np.int32)))],
                    names=["toxic", "words", "counts"],
                )

    got = sample.mapInArrow(count, "toxic int, words array<long>, counts array<int>").toArrow()
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0, dtype=np.int64)
    lengths = got.column("words").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(got.num_rows), lengths)
    return fit(flat("words"), row, flat("counts"), got.column("toxic").to_numpy() > 0)


def score(docs: DataFrame, model: Ordinal, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``severity`` (expected grade), ``grade`` (likeliest by halves), ``toxic``."""
    small_batches(docs.sparkSession)
    features, weights = np.append(model.features, np.iinfo(np.int64).max), np.append(model.weights, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(len(keep)))
            linear = np.zeros(len(texts))
            for a, b, words, first in word_counts(texts):
                at = np.searchsorted(features, words)
                hit = np.flatnonzero(features[at] == words)
                owner = np.searchsorted(first, hit, "right") - 1
                pair, times = np.unique(owner * len(features) + at[hit], return_counts=True)
                linear[a:b] = np.bincount(pair // len(features), weights=weights[pair % len(features)] * strength(times), minlength=b - a)
            tails = model.grades(linear)
            kept = [batch.column(i) for i in range(len(keep))]
            extra = [pa.array(tails.sum(axis=1)), pa.array((tails >= 0.5).sum(axis=1).astype(np.int32)), pa.array(tails[:, 0] >= 0.5)]
            names = ["severity", "grade", "toxic"]
            schema = pa.schema([batch.schema.field(i) for i in range(len(keep))] + [pa.field(n, e.type) for n, e in zip(names, extra)])
            yield pa.RecordBatch.from_arrays(kept + extra, schema=schema)

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["severity double", "grade int", "toxic boolean"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)
