"""The pipeline's stages one after another on a small corpus with planted copies."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]
    lines = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(n))
    clean = [lines(12) for _ in range(30)]
    near = clean[0].replace(clean[0].split()[40], "changed", 1)
    shared = " ".join(rng.choices(words, k=20)) + "."
    texts = clean + [near, clean[1], "too short", clean[2] + "\n" + shared, lines(12) + "\n" + shared, None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id: r for r in now.collect()})
        assert k == 4 or now.columns == docs.columns, name
    assert set(seen[0]) == set(range(35)) - {32}
    assert not seen[1][34].text.endswith(shared) and seen[1][33].text.endswith(shared)
    assert set(range(30)) <= set(seen[2])
    assert seen[1][31].text == "" and 31 not in seen[3]  # all its lines stand in document 1
    assert len(seen[1][30].text.split("\n")) <= 1
    assert all(r.n_tokens == len(r.ids) for r in seen[4].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
