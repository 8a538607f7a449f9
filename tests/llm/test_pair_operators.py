"""Operators on pairs and groups, against all-pairs brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from graphaxis.llm import blocking, components, op1_minhash, op2_lines, op5_mixing, op7_embeddings

WORDS = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(900)]


def closure(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(50, i) for i in range(51, 90)] + [(rng.randrange(100, 150), rng.randrange(100, 150)) for _ in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = closure(150, links)
    assert got == {i: want[i] for i in {x for pair in links for x in pair if pair[0] != pair[1]}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("in_tasks", [False, True])
def test_long_blocks_lose_no_link_between_components(spark, in_tasks):
    # One block of 90 items: guards within one of each other link; nearly all are one run.
    guards = [i % 40 for i in range(80)] + [1000 + i for i in range(10)]
    blocks = spark.createDataFrame([(7, i, g, 0) for i, g in enumerate(guards)], "key long, node long, g long, h long")
    payload = spark.createDataFrame([(i, g) for i, g in enumerate(guards)], "node long, payload long")
    close = lambda a, b: np.abs(a[0] - b[0]) <= 1
    linked = lambda a, b: np.abs(a.to_numpy()[:, None] - b.to_numpy()[None, :]) <= 1
    from pyspark.sql import functions as F

    close_sql = lambda g, h, g2, h2: F.abs(g - g2) <= 1
    got = {r.node: r.component for r in blocking.link(blocks, close, close_sql, payload, lambda pairs: pairs, linked if in_tasks else None).collect()}
    want = closure(90, [(i, j) for i, j in combinations(range(90), 2) if abs(guards[i] - guards[j]) <= 1])
    assert all(got.get(i, i) == want[i] for i in range(90))


def near_texts():
    rng = random.Random(2)
    texts = []
    for k in range(12):
        base = rng.choices(WORDS, k=200)
        texts.append(" ".join(base))
        for _ in range(k % 4):
            copy = list(base)
            copy[rng.randrange(200)] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())  # the same words
        texts.append(" ".join(base[:100] + rng.choices(WORDS, k=100)))  # a shared half
    return [*texts, None, "", " ", "one two", "one two", "long " * 3000]


def test_minhash_groups_are_the_brute_force_groups(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    rows = {r.doc_id: r for r in op1_minhash.groups(docs).collect()}
    idf = op1_minhash.word_frequencies(docs)
    import pyarrow as pa

    has = [i for i, t in enumerate(texts) if t and t.strip()]
    pairs = list(combinations(has, 2))
    left, right = pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs])
    same = op1_minhash.similarity(left, right, idf) >= op1_minhash.THRESHOLD
    want = closure(len(texts), [p for p, s in zip(pairs, same) if s])
    assert [rows[i].component_id for i in range(len(texts))] == want
    assert all(rows[i].kept == (want[i] == i) for i in rows)
    kept = op1_minhash.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_weighted_similarity_matches_sets(spark):
    import pyarrow as pa

    a, b = "p q r s t u v w", "p q r s t u x y"
    flat = np.ones(op1_minhash.COUNTERS)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(4)}
    want = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert op1_minhash.similarity(pa.array([a]), pa.array([b]), flat)[0] == pytest.approx(want)


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    n = 400
    shingles = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    wa, wb = rng.random(n) + 0.2, rng.random(n) + 0.2
    sampler = op1_minhash.Sampler(2000)
    got = sampler.sample(np.concatenate([shingles, shingles]), np.concatenate([wa, wb]), np.array([0, n, 2 * n]))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((got[:, 0] == got[:, 1]).mean() - want) < 0.04


def test_line_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    long = [" ".join(rng.choices(WORDS, k=300)) for _ in range(20)]
    close = [re.sub(r"\w+$", "otherword", line) for line in long[:5]]
    texts = ["\n".join(long[:10]), "\n".join([long[3].upper() + "!!", "short line", *close[:3]]), "\n".join(long[10:] + [long[12]]), "short line\nshort line", None, "", "\n".join(close[:2])]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in op2_lines.shortened(docs).collect()}
    assert out[0].text == texts[0] and out[1].text == "short line" and out[2].text == "\n".join(long[10:])
    assert out[3].text == "" and out[4].text is None and out[5].text == "" and out[6].text == ""
    assert out[1].n_chars == len("short line") and out[0].n_chars == 0
    rows = {r.doc_id: r for r in op2_lines.digests(docs).collect()}
    assert [rows[i].n_dropped for i in range(7)] == [0, 4, 1, 2, 0, 0, 2]
    assert op2_lines.digests(docs.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited_lines(rng, n, share):
    """Lines and copies with words replaced, put in and left out, up to ``share`` of the longer length."""
    out = []
    for _ in range(n):
        base = rng.choices(WORDS[:200], k=rng.choice([5, 6, 7, 8, 9, 10, 12, 14, 19, 20, 24, 40]))
        copy = list(base)
        for _ in range(rng.randint(1, max(1, int(share * len(base))))):
            at = rng.randrange(len(copy))
            kind = rng.randrange(3)
            copy[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(WORDS[:200])]
        out += [base, copy]
    return out


def test_line_groups_are_those_of_all_pairs(spark):
    rng = random.Random(14)
    lines = [x for x in edited_lines(rng, 130, 0.2) if len(x) >= op2_lines.LEAST_WORDS]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    alike = [(i, j) for i, j in combinations(range(len(lines)), 2) if 5 * edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))]
    assert len(alike) > 90
    want = closure(len(lines), alike)
    gone = {r.id for r in op2_lines.dropped_lines(docs).collect()}
    assert gone == {i for i in range(len(lines)) if want[i] != i}


def keys_of(lines, weights):
    hashes = {w: np.uint64(i * 7919 + 1) for i, w in enumerate(WORDS)}
    begin = np.cumsum([0, *map(len, lines)])
    words = op2_lines.mix(np.array([hashes[w] for x in lines for w in x], dtype=np.uint64))
    key, n = op2_lines._line_keys(words, begin, weights)
    assert n.max() <= 2 * op2_lines.MOST_KEYS
    return [set(k.tolist()) for k in np.split(key, np.cumsum(n)[:-1])], op2_lines._guards(words, begin)


@pytest.mark.parametrize("kind", ["even", "uneven"])
def test_lines_that_are_alike_share_a_key_and_pass_the_guard(kind):
    rng, draws = random.Random(15), np.random.default_rng(16)
    weights = np.ones(op2_lines.COUNTERS, np.float32) if kind == "even" else (draws.random(op2_lines.COUNTERS) ** 4 + 0.001).astype(np.float32)
    lines = edited_lines(rng, 3000, 0.25)
    keys, guard = keys_of(lines, weights)
    seen, long, lost = 0, 0, 0
    for i in range(0, len(lines), 2):
        a, b = lines[i], lines[i + 1]
        if min(len(a), len(b)) >= op2_lines.LEAST_WORDS and 5 * edits(a, b) <= max(len(a), len(b)):
            seen += 1
            if max(len(a), len(b)) <= op2_lines.PAIRS_TO:
                assert keys[i] & keys[i + 1]
            else:
                long, lost = long + 1, lost + (not keys[i] & keys[i + 1])
            assert op2_lines._guard(*(np.array([[g[j]] for g in guard]) for j in (i, i + 1))).all()
    assert seen > 1500 and long > 100 and lost <= 0.005 * long


@pytest.mark.parametrize("length", [30, 60, 200])
def test_long_lines_at_the_threshold_meet(length):
    """A fifth of the words replaced, the most that is still alike: less than one pair in a hundred is lost."""
    rng = random.Random(17)
    lines = []
    for _ in range(1500):
        base = rng.choices(WORDS, k=length)
        copy = list(base)
        for at in rng.sample(range(length), length // 5):
            copy[at] = rng.choice(WORDS)
        lines += [base, copy]
    keys, _ = keys_of(lines, np.ones(op2_lines.COUNTERS, np.float32))
    met = sum(bool(keys[i] & keys[i + 1]) for i in range(0, len(lines), 2))
    assert met >= 0.99 * 1500


def test_lines_are_kept_with_clashing_columns_repeated_ids_and_ties(spark):
    text = "one two three four five six\n\n---\nOne two three four five six!\ntail line"
    rows = [(7, text, "a", "b", "c", "d"), (7, text, "e", "f", "g", "h"), (None, text, "i", "j", "k", "l"), (3, "one two three four five seven", "m", "n", "o", "p"), (9, "x" * 200_000, "q", "r", "s", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, __id string, __split string, key string")
    out = sorted(op2_lines.shortened(docs).collect(), key=lambda r: r.gone)
    assert [tuple(r)[2:] for r in out] == [x[2:] for x in rows]
    # Of both rows with id 7 lines 0 and 3 go (document 3 has the first alike), of the null id none.
    assert [r.text for r in out] == ["\n---\ntail line"] * 2 + [text, rows[3][1], rows[4][1]]


def expected_targets(sizes):
    """Sharing by weight with caps, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3.0 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **capped}
        capped |= over


@pytest.mark.parametrize("shape", [{"a": 400, "b": 30, "c": 5, None: 60}, {"a": 10, "b": 10, "c": 10, "d": 3}])
def test_mix_meets_targets(spark, shape):
    rng = random.Random(9)
    rows = [(i, None if i == 3 else " ".join(rng.choices(WORDS, k=rng.randint(0, 300))), s, 0) for i, s in enumerate(s for s, n in shape.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    first, again = (sorted(op5_mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert [(r.doc_id, r.taken) for r in first] == [(r.doc_id, r.taken) for r in again]
    sizes = {}
    for r in first:
        text = rows[r.doc_id][1]
        assert r.size == len((text or "").split()) and r.taken <= 3 * r.size
        sizes[r.mixed_source] = sizes.get(r.mixed_source, 0) + r.size
    want = expected_targets(sizes)
    for source, target in want.items():
        own = [r for r in first if r.mixed_source == source]
        assert own[0].target == pytest.approx(target) and own[0].source_size == sizes[source]
        assert abs(sum(r.taken for r in own) - target) <= 2 * op5_mixing.BLOCK
    mixed = op5_mixing.materialised_mix(docs)
    assert mixed.columns == docs.columns
    by_doc: dict = {}
    for r in mixed.collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert by_doc == {r.doc_id: r.taken for r in first if r.taken}
    assert op5_mixing.mix(docs.limit(0)).count() == 0


def test_embedding_links_and_counts(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((60, 16))
    rows = [base[i // 10] + 0.06 * rng.standard_normal(16) * (i % 10 > 0) for i in range(300)] + [rng.standard_normal(16) for _ in range(200)]
    rows = [list(map(float, r)) for r in rows]
    labels = [i // 10 % 3 if i != 17 else None for i in range(500)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0] * 4, [1.0] * 4]
    data = [(i, r, l, "x") for i, (r, l) in enumerate(zip(rows + odd, labels + [1] * len(odd)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: r for r in op7_embeddings.cluster(df).collect()}
    x = np.array(rows, dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = [(i, j) for i, j in combinations(range(500), 2) if labels[i] is not None and labels[i] == labels[j] and x[i] @ x[j] >= 0.98] + [(506, 507)]
    want = closure(508, linked)
    degree = np.bincount(np.array(linked).reshape(-1), minlength=508)
    assert len(linked) > 300
    assert [got[i].n_links for i in range(508)] == degree.tolist()
    assert [got[i].component_id for i in range(508)] == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert op7_embeddings.cluster(df.limit(0)).count() == 0


def test_forest_recall_where_leaves_split(spark, monkeypatch):
    monkeypatch.setattr(op7_embeddings, "LEAF", 20)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((400, 64))
    rows = np.concatenate([base, base + 0.09 * rng.standard_normal(base.shape)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    close = [i for i in range(400) if unit[i] @ unit[i + 400] >= 0.98]
    df = spark.createDataFrame([(i, list(map(float, r)), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in op7_embeddings.cluster(df).collect()}
    found = [i for i in close if got[i] == got[i + 400]]
    assert len(close) > 300 and len(found) >= 0.97 * len(close)
