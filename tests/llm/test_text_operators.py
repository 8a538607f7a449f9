"""Operators on single texts, against brute force and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from graphaxis.llm import op3_toxicity, op4_bpe, op6_quality, op8_secrets, op9_language, op10_weak_labels
from graphaxis.llm import textscan

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string"
ODD = [None, "", " ", "\n\n", "'s", "x", "é" * 300, "word " * 5000, "日本語 テスト", "a\tb\rc\x0bd\x0ce", "\x1c\x85", "😀 emoji's 'll"]


def documents(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["a", "B", "'", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "1", "²", "!", "é", "日", "\x85", "\x1c", "😀", "'T", "​", "́", "st"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=6))
def test_encoding_is_what_the_library_gives(reference, texts):
    ids, counts = op4_bpe.encode_texts(texts, op4_bpe.byte_pairs(RANKS)) if texts else (np.zeros(0, int), np.zeros(0, int))
    edge = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])] == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), min_size=20, max_size=60).map("".join), st.integers(2, 9))
def test_windows_hand_their_state_on(reference, text, window):
    was, op4_bpe.WINDOW = op4_bpe.WINDOW, window
    try:
        ids, counts = op4_bpe.encode_texts([text, "", text[::-1]], op4_bpe.byte_pairs(RANKS))
    finally:
        op4_bpe.WINDOW = was
    assert ids[: counts[0]].tolist() == reference.encode_ordinary(text)
    assert ids[counts[0] :].tolist() == reference.encode_ordinary(text[::-1])
    assert counts[1] == 0


def test_caches_are_bounded(reference):
    pairs = op4_bpe.BytePairs(RANKS)
    pairs.CACHE_BYTES = 2000
    text = " ".join(f"wx{i}yz" for i in range(400))
    for _ in range(3):
        ids, _ = op4_bpe.encode_texts([text, text], pairs)
        assert ids.tolist() == 2 * reference.encode_ordinary(text)
    pairs.rest()
    assert len(pairs.cache) < 400 and not pairs.older


def test_long_slices_merge_like_short_ones(reference):
    for text in ("a" * 3000, "ab" * 1500 + "日本" * 700, "".join(random.Random(4).choices("abc", k=5000))):
        ids, _ = op4_bpe.encode_texts([text], op4_bpe.byte_pairs(RANKS))
        assert ids.tolist() == reference.encode_ordinary(text)


def test_bpe_query_digests(spark, reference):
    rows = op4_bpe.digests(documents(spark, ODD), RANKS).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op4_bpe.digests(documents(spark, []), RANKS).count() == 0


def test_offsets_end_each_token(spark, reference):
    row = op4_bpe.encode(documents(spark, ["don't stop 日本"]), RANKS).first()
    pieces = [reference.decode_single_token_bytes(i) for i in row.ids]
    assert list(row.ends) == np.cumsum([len(p) for p in pieces]).tolist()


def base_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    places = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, before, twice = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(places)


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(5)
    texts = [*ODD, "a b c " * 40, "\n".join(["same line here"] * 9), *[" ".join(rng.choices(["ab", "cd", "ef#", "g"], k=rng.randint(1, 90))) for _ in range(40)]]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in op6_quality.judge(docs, carry=("doc_id",)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_statistics(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = op6_quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows.values())
    assert op6_quality.judge(documents(spark, []), carry=("doc_id",)).count() == 0


def test_quality_spares_clean_documents_of_bad_hosts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    junk = " ".join(f"word{i}***" for i in range(80))
    docs = spark.createDataFrame([(i, junk if i % 2 else clean, "bad") for i in range(40)] + [(100 + i, clean, None) for i in range(40)], "doc_id long, text string, source string")
    rows = op6_quality.judge(docs, carry=("doc_id",)).collect()
    assert all(r.kept == (r.doc_id >= 100 or r.doc_id % 2 == 0) for r in rows)


def test_toxicity_separates_and_orders(spark):
    rng = random.Random(6)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bad = ["vileword", "nastyword"]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=60)
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 8) if toxic else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append((i, None if i == 7 else int(toxic)))
    docs = documents(spark, texts + ODD)
    model = op3_toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.features) == 2 and (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in op3_toxicity.score(docs, model).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(rows[i].toxic == bool(t) for i, t in labels if t is not None)
    mild, severe = documents(spark, ["vileword"]), documents(spark, ["vileword " * 9 + "nastyword " * 9])
    assert op3_toxicity.score(mild, model).first().severity < op3_toxicity.score(severe, model).first().severity
    nothing = op3_toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.toxic for r in op3_toxicity.score(docs, nothing).collect())


def test_language_backs_off_to_shorter_grams(spark):
    rng = random.Random(7)
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "gro", "pfa"]}
    rows = [(i, " ".join("".join(rng.choices(parts[l], k=3)) for _ in range(40)), l, "s", 0, "") for i, l in enumerate(["xx", "yy"] * 60)]
    odd = [(1000 + i, t, None, None, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    counts = op9_language.learn(docs)
    assert {lang for lang, _ in counts} == {"xx", "yy"}
    out = {r.doc_id: r for r in op9_language.identify(docs.withColumn("held_out", op9_language.held_out(docs.doc_id)), counts, keep=("doc_id", "held_out")).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert all(out[r[0]].lang_pred == r[2] for r in rows)
    assert [out[1000 + i].lang_pred for i in range(4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in out.values())
    unseen = documents(spark, ["strgropfastrgropfa"])
    assert op9_language.identify(unseen, counts).first().lang_pred == "yy"
    assert op9_language.identify(unseen, {}).first().lang_pred == "und"


def test_weak_labels_find_junk(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    good = [". ".join(" ".join(rng.choices(vocabulary, k=9)).capitalize() for _ in range(8)) + "." for _ in range(150)]
    shout = [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=60)) for _ in range(20)]
    marked = [" ".join(w + "***" for w in rng.choices(vocabulary, k=60)) for _ in range(20)]
    docs = documents(spark, good + shout + marked + ODD)
    rows = {r.doc_id: r for r in op10_weak_labels.score(docs, op10_weak_labels.train(docs)).collect()}
    assert len(rows) == len(good + shout + marked + ODD)
    assert sum(rows[i].kept for i in range(150)) >= 148
    assert sum(rows[i].kept for i in range(150, 190)) <= 2
    assert not rows[190].kept and rows[190].score == 0
    empty = documents(spark, [])
    assert op10_weak_labels.score(empty, op10_weak_labels.train(empty)).count() == 0


def test_secrets_and_look_alikes(spark):
    key = hashlib.sha1(b"some fixed bytes").hexdigest()
    texts = [f'and then token = "{key}" of it', "card 4952935900253052 of it", "mail the.72@mail3.example.com now", "plain words only", None, f"commit {key} of it"]
    docs = documents(spark, texts * 8)
    found = op8_secrets.findings(docs).collect()
    assert {r.doc_id % 6 for r in found if r.is_secret} == {0}
    assert {r.doc_id % 6 for r in found} >= {0, 1, 5}
    assert sum(r.is_secret for r in found) == 8
    assert op8_secrets.candidates(documents(spark, [])).count() == 0


def test_spans_hash_alike_wherever_they_stand():
    texts = pa.array(["one two one", "", "two  one", "  "])
    data, offsets = textscan.raw_bytes(texts)
    starts, ends, first = textscan.word_runs(data, offsets)
    h = textscan.span_hashes(data, starts, ends)
    assert first.tolist() == [0, 3, 3, 5, 5] and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


def test_dictionary_counts_all_texts_and_covers_by_words(spark):
    # 1,500 texts, more than 400 words, each word in two texts.
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(1500)]
    docs = documents(spark, [f"{names[i]} {names[(i + 1) % 1500]} lonely{'abcdefghij'[i % 10] if i else 'zz'}" for i in range(1500)])
    words = op8_secrets.dictionary_of(docs)
    assert {r.w for r in words.collect()} == {*names, *(f"lonely{c}" for c in "abcdefghij")}
    tokens = spark.createDataFrame([(names[7] + "-1234567890" + names[1400],), ("zzzz1234zzzz1234",), (names[3].upper() + "q" * 5,)], "token string")
    got = {r.token: r.covered for r in op8_secrets.coverage(tokens, words).collect()}
    assert got == {names[7] + "-1234567890" + names[1400]: 10 / 21, names[3].upper() + "q" * 5: 0.5}
