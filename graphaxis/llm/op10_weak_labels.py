"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or nothing on every text. Expectation
maximisation over the counts of their vote patterns (there are few, whatever the corpus) estimates
each labeller's accuracy without any labelled text, and with it the probability that a text is
good. Those posteriors train a hashed linear scorer on the texts' own bytes, which then scores
every text, also where no labeller spoke.

Votes are counted over all texts; the scorer is fitted on a bounded sample (``MAX_TEXTS`` of least
hashed id). Defined results: a null or wordless text scores 0 and is not kept; repeated rows each
give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.textscan import chunks, mix, raw_bytes, ranges, shingle_hashes, small_batches, span_hashes, text_column, word_runs

MAX_TEXTS = 4_000
BUCKETS = 1 << 16
GRAM = 4
RIDGE = 1e-4
ROUNDS = 150
KEEP = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2


def _set(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_SYMBOL, _MARK = _set("#*$%&|<>"), _set("!")
_UPPER, _LOWER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("abcdefghijklmnopqrstuvwxyz")
_STOP = _set(".?!\"')")
_ODD = _set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Scan:
    """One chunk of texts: bytes, words and the shares that the labellers judge."""

    data: np.ndarray
    offsets: np.ndarray
    n_words: np.ndarray
    twins: np.ndarray
    votes: np.ndarray


def scan(texts: pa.Array) -> Scan:
    data, offsets = raw_bytes(texts)
    starts, ends, first = word_runs(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = np.diff(first)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    twins = _per_text(same, first)
    windows, begin = shingle_hashes(hashes, first, 3)
    window_owner = np.repeat(np.arange(len(n)), np.diff(begin))
    order = np.lexsort((windows, window_owner))
    again = np.zeros(len(windows), dtype=np.int64)
    if len(windows) > 1:
        again[1:] = (windows[order][1:] == windows[order][:-1]) & (window_owner[order][1:] == window_owner[order][:-1])
    repeats = _per_text(again, begin) / np.maximum(np.diff(begin), 1)
    symbols = _per_text(_SYMBOL[data], offsets) / some
    marks = _per_text(_MARK[data], offsets) / some
    upper, lower = _per_text(_UPPER[data], offsets), _per_text(_LOWER[data], offsets)
    wide = _per_text((data > 127).astype(np.int64), offsets)
    shout = upper / np.maximum(upper + lower, 1)
    letters = _per_text(ends - starts, first)
    shape = letters / some
    odd = _per_text(_ODD[data], offsets) / np.maximum(letters, 1)
    closed = np.zeros(len(data), dtype=np.int64)
    line_end = np.append(data[1:] == 10, True) if len(data) else np.zeros(0, dtype=bool)
    if len(data):
        line_end[offsets[1:][offsets[1:] > 0] - 1] = True
        line_end &= data != 10
        closed = _STOP[data] * line_end
    lines = _per_text(line_end.astype(np.int64), offsets)
    sentences = _per_text(closed, offsets) / np.maximum(lines, 1)
    none = np.zeros(len(n), dtype=bool)  # most labellers know junk only, and abstain elsewhere
    judged = [
        (symbols > 0.15, none),
        (shout > 0.5, none),
        (marks > 0.3, none),
        (twins / some > 0.15, none),
        (repeats > 0.3, none),
        (upper + lower + wide < 0.3 * letters, n >= 40),
        ((n >= 8) & (odd > 0.1) | (shape > 15), (odd < 0.05) & (shape < 9)),
        (sentences < 0.2, sentences > 0.7),
    ]
    votes = np.column_stack([np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)) for bad, good in judged])
    votes[n == 0] = ABSTAIN
    return Scan(data, offsets, n, twins, votes)


N_LABELLERS = 8
_BASE3 = 3 ** np.arange(N_LABELLERS)


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How many texts (with a word) have each pattern of votes; at most 3**8 patterns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**N_LABELLERS, dtype=np.int64)
        for batch in batches:
            texts = text_column(batch.column(0))
            for a, b in chunks(texts):
                seen = scan(texts.slice(a, b - a))
                total += np.bincount((seen.votes @ _BASE3)[seen.n_words > 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pattern", "k"])

    counted = docs.select(text).mapInArrow(run, "pattern long, k long").groupBy("pattern").agg(F.sum("k").alias("k")).toArrow()
    return dict(zip(counted.column("pattern").to_pylist(), counted.column("k").to_pylist()))


#: Beliefs before any data: the chance that a labeller votes bad on a good and on a bad text, and
#: that one which can vote good does so. They weigh as much as this share of all texts. Such a model
#: needs them: kinds of junk hardly overlap, so votes alone don't say which side is which.
BELIEF_BAD, BELIEF_GOOD = {GOOD: 0.003, BAD: 0.3}, {GOOD: 0.7, BAD: 0.5}
BELIEF_SHARE = 0.5


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """P(good) for each pattern of votes, by expectation maximisation over vote probabilities.

    The E step weighs the votes of a pattern, labellers independent given the class; the M step
    counts each labeller's votes within each class.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], dtype=np.float64)
    votes = (patterns[:, None] // _BASE3) % 3
    speaks = [(votes[:, j] == GOOD).any() for j in range(N_LABELLERS)]
    belief = np.empty((2, N_LABELLERS, 3))
    for c, kind in enumerate((BAD, GOOD)):
        for j in range(N_LABELLERS):
            good = BELIEF_GOOD[kind] * (1 - BELIEF_BAD[kind]) if speaks[j] else 1e-9
            belief[c, j, [ABSTAIN, BAD, GOOD]] = 1 - BELIEF_BAD[kind] - good, BELIEF_BAD[kind], good
    chance, prior, p = belief, 0.8, np.full(len(patterns), 0.5)
    strength = BELIEF_SHARE * weight.sum()
    for _ in range(200):
        logs = np.log(prior / (1 - prior)) + sum(np.log(chance[1, j, votes[:, j]]) - np.log(chance[0, j, votes[:, j]]) for j in range(N_LABELLERS))
        new = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
        prior = float(np.clip((weight * p).sum() / weight.sum(), 0.05, 0.95))
        own = np.stack([weight * (1 - p), weight * p])
        seen = np.stack([[np.bincount(votes[:, j], weights=own[c], minlength=3) for j in range(N_LABELLERS)] for c in range(2)])
        chance = (seen + strength * belief) / (own.sum(axis=1)[:, None, None] + strength)
    return dict(zip(patterns.tolist(), p.tolist()))


def features(seen: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 4-grams, one per place, and each text's first; word twins count as a gram."""
    length = np.diff(seen.offsets)
    sizes = np.maximum(length - GRAM + 1, 0)
    at = ranges(seen.offsets[:-1], sizes)
    data = seen.data.astype(np.uint64)
    gram = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM):
        gram = gram << np.uint64(8) | data[at + k]
    return (mix(gram) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Scorer:
    weights: np.ndarray
    twin: float
    bias: float

    def linear(self, seen: Scan) -> np.ndarray:
        bucket, first = features(seen)
        means = _per_text(self.weights[bucket], first) / np.maximum(np.diff(first), 1)
        return means + self.twin * seen.twins / np.maximum(seen.n_words, 1) + self.bias


#: Relative frequencies are small numbers; this puts their weights on the scale of the bias.
SCALE = 100.0


def train(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Scorer:
    posterior = estimate(pattern_counts(docs, text))
    chosen = docs.select(F.col(id).alias("id")).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(MAX_TEXTS).distinct()
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id", "left_semi").select("text")  # at most MAX_TEXTS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(0))
            for a, b in chunks(texts):
                seen = scan(texts.slice(a, b - a))
                bucket, first = features(seen)
                found = [np.unique(bucket[s:e], return_counts=True) for s, e in zip(first[:-1], first[1:])]
                edge = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
                idx, n = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.votes @ _BASE3), pa.array(seen.n_words), pa.array(seen.twins / np.maximum(seen.n_words, 1)), pa.ListArray.from_arrays(edge, pa.array(idx)), pa.ListArray.from_arrays(edge, pa.array(n))],
                    names=["pattern", "n", "twins", "idx", "k"],
                )

    got = sample.mapInArrow(run, "pattern long, n long, twins double, idx array<int>, k array<int>").where("n > 0").toArrow()
    if not got.num_rows:
        return Scorer(np.zeros(BUCKETS), 0.0, 0.0)
    target = np.array([posterior.get(p, 0.5) for p in got.column("pattern").to_pylist()])
    idx_lists = got.column("idx").combine_chunks()
    lengths = idx_lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(target)), lengths)
    idx, k = idx_lists.flatten().to_numpy(), got.column("k").combine_chunks().flatten().to_numpy().astype(np.float64)
    total = np.maximum(np.bincount(row, weights=k, minlength=len(target)), 1)
    return fit(row, idx, k / total[row], got.column("twins").to_numpy(), target)


def fit(row: np.ndarray, idx: np.ndarray, share: np.ndarray, twins: np.ndarray, target: np.ndarray) -> Scorer:
    """Logistic regression on probabilities as labels, both classes weighing the same, by Adam."""
    n = len(target)
    x = (share * SCALE).astype(np.float64)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= weight.sum()
    theta = np.zeros(BUCKETS + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        linear = np.bincount(row, weights=theta[idx] * x, minlength=n) + theta[-2] * twins * 10 + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target) * weight
        g = np.concatenate([np.bincount(idx, weights=error[row] * x, minlength=BUCKETS), [(error * twins).sum() * 10, error.sum()]])
        g[:-1] += RIDGE * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(theta[:-2] * SCALE, float(theta[-2] * 10), float(theta[-1]))


def score(docs: DataFrame, model: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``score`` (probability of good) and ``kept``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(len(keep)))
            out = np.zeros(len(texts))
            for a, b in chunks(texts):
                seen = scan_words(texts.slice(a, b - a))
                out[a:b] = np.where(seen.n_words > 0, 1 / (1 + np.exp(-np.clip(model.linear(seen), -30, 30))), 0.0)
            kept = [batch.column(i) for i in range(len(keep))]
            schema = pa.schema([batch.schema.field(i) for i in range(len(keep))] + [pa.field("score", pa.float64()), pa.field("kept", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out), pa.array(out >= KEEP)], schema=schema)

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["score double", "kept boolean"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def scan_words(texts: pa.Array) -> Scan:
    """What the scorer needs of a scan, without the votes."""
    data, offsets = raw_bytes(texts)
    starts, ends, first = word_runs(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return Scan(data, offsets, n, _per_text(same, first), np.zeros((len(n), N_LABELLERS), dtype=np.int64))
