"""Language identification with word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams with word boundaries, the longest length of which any is known, and scores by
their mean log frequency. A text's score adds over its words. Words are found as runs in an array of
character classes and told apart by hash, so that each distinct word of a batch is looked up once.

The tables are learned from a bounded sample of labelled texts (``MAX_TEXTS`` of least hashed id),
so that the model has a fixed size; every text is scored whole. Defined results: a null text or one
without a letter is ``und`` with score 0, as is every text if nothing could be learned; repeated
rows each give a row; rows with a null id are scored but never learned from; of languages that tie
the first by name is taken; an empty table gives an empty result; a text of any length is scored whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.textscan import runs, small_batches, span_hashes

MAX_TEXTS = 8_000
LONGEST_GRAM = 4
LEAST_WORD, LEAST_GRAM = 2, 3
SMOOTHING = 0.05
WORDS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000
#: Characters scanned together; a longer text is scanned alone.
CHUNK_CHARS = 1 << 20
UNDETERMINED = "und"


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    framed = f"<{word}>" if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


class Backoff:
    """Log frequencies of words and n-grams; a dictionary from words to rows of ``scores``."""

    def __init__(self, counts: dict[tuple[str, int], dict[str, int]]):
        """``counts``: by (language, gram length or 0 for words), how often each piece occurs."""
        self.languages = sorted({lang for lang, _ in counts})
        self.logs: list[dict[str, np.ndarray]] = []
        for n in range(LONGEST_GRAM + 1):
            pieces = sorted(set().union(*(counts.get((lang, n), {}) for lang in self.languages)))
            table = np.zeros((len(pieces), len(self.languages)))
            for j, lang in enumerate(self.languages):
                own = counts.get((lang, n), {})
                table[:, j] = [own.get(p, 0) for p in pieces]
            total = table.sum(axis=0)
            logs = np.log((table + SMOOTHING) / (total + SMOOTHING * max(1, len(pieces)))).astype(np.float32)
            self.logs.append(dict(zip(pieces, logs)))
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.scores = np.zeros((1024, len(self.languages)), dtype=np.float32)

    def word(self, word: str) -> np.ndarray:
        known = self.logs[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST_GRAM, 0, -1):
            found = [r for g in grams(word, n) if (r := self.logs[n].get(g)) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.languages), dtype=np.float32)

    def rows(self, hashes: np.ndarray, spelled) -> np.ndarray:
        """Rows of ``scores`` for distinct hashes; ``spelled`` gives the i-th word."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        index, out = self.index, np.empty(len(hashes), dtype=np.int64)
        for i, h in enumerate(hashes.tolist()):
            at = index.get(h)
            if at is None:
                at = index[h] = len(index)
                if at >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.scores[at] = self.word(spelled(i))
            out[i] = at
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Added log frequencies, a row for each text and a column for each language; which texts have a letter."""
        lower = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.minimum(np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])]), len(points)).astype(np.int64)
        kinds = character_kinds()[points]
        letters = np.concatenate([[0], np.cumsum(kinds == LETTER)])
        total = np.zeros((len(texts), len(self.languages)))
        starts, ends, first = runs(kinds > 0, offsets)
        if len(starts) and self.languages:
            unique, sample, which = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
            spelled = lambda i: points[starts[sample[i]] : ends[sample[i]]].tobytes().decode("utf-32-le", "surrogatepass")
            row = self.rows(unique, spelled)[which]
            full = np.flatnonzero(np.diff(first))
            total[full] = np.add.reduceat(self.scores[row].astype(np.float64), first[full], axis=0)
        return total, (letters[offsets[1:]] > letters[offsets[:-1]]) & bool(self.languages)


OTHER_IN_WORD, LETTER = 1, 2
_kinds: np.ndarray | None = None


def character_kinds() -> np.ndarray:
    """For each code point: letter, other character of ``WORDS``, or none."""
    global _kinds
    if _kinds is None:
        chars = [chr(c) for c in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in chars), dtype=bool, count=len(chars))
        word = np.fromiter((c.isalnum() and not c.isdecimal() for c in chars), dtype=bool, count=len(chars))
        _kinds = np.where(letter, LETTER, np.where(word, OTHER_IN_WORD, 0)).astype(np.uint8)
    return _kinds


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def learn(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[tuple[str, int], dict[str, int]]:
    """Counts of words and n-grams by language, from a bounded sample of the learnable rows."""
    small_batches(docs.sparkSession)
    able = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    able = able.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    chosen = able.select("id").orderBy(F.xxhash64("id"), "id").limit(MAX_TEXTS).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
            rows = Counter()
            for lang, words in seen.items():
                for word, k in words.items():
                    rows[lang, 0, word] += k
                    for n in range(1, LONGEST_GRAM + 1):
                        for g in grams(word, n):
                            rows[lang, n, g] += k
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "n", "piece", "k"])

    sample = able.join(F.broadcast(chosen), "id", "left_semi").select("lang", "text")  # at most MAX_TEXTS ids
    counted = sample.mapInArrow(count, "lang string, n int, piece string, k long").groupBy("lang", "n", "piece").agg(F.sum("k").alias("k"))
    kept = counted.where(F.col("k") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_GRAM)).toArrow()
    counts: dict[tuple[str, int], dict[str, int]] = {}
    for lang, n, piece, k in zip(*(kept.column(c).to_pylist() for c in ("lang", "n", "piece", "k"))):
        counts.setdefault((lang, n), {})[piece] = k
    return counts


_models: dict[str, Backoff] = {}


def identify(docs: DataFrame, counts: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score``, the probability of that language."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of a bounded sample
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # built once in each worker, not in each task
            _models.clear()
            _models[name] = Backoff(shared.value)
        model = _models[name]
        for batch in batches:
            names, scores = [], []
            for texts in _pieces(batch.column(len(keep)).to_pylist()):
                logs, lettered = model.score(texts)
                best = logs.argmax(axis=1) if model.languages else np.zeros(len(texts), dtype=np.int64)
                top = logs[np.arange(len(texts)), best] if model.languages else np.zeros(len(texts))
                names += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
                scores.append(np.where(lettered, 1 / np.maximum(np.exp(logs - top[:, None]).sum(axis=1), 1e-300), 0.0))
            kept = [batch.column(i) for i in range(len(keep))]
            schema = pa.schema([batch.schema.field(i) for i in range(len(keep))] + [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], schema=schema)

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["lang_pred string", "score double"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)
