import numpy as np

import corpus_pipeline
from tests.llm import test_near_dedup, test_suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "part", "a.b"]


def corpus():
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}o" for a in "bcdfgh" for b in "aeiou" for c in "klmnpr"]
    passage = " ".join(rng.choice(words, 120))
    texts = []
    for i in range(90):
        own = list(rng.choice(words, rng.integers(30, 150)))
        if i % 9 == 0:
            own[3:3] = ["idiot", "scum", "moron"]
        if i % 10 == 5:
            own += passage.split()
        texts.append(" ".join(own))
    near = texts[1].split()
    near[7] = "changed"
    return [*texts, None, "", texts[2], texts[2].replace(" ", "\n", 3), " ".join(near), "$$$ ||| " * 60]


def test_stages_match_brute_force(spark, docs, tmp_path):
    spark.createDataFrame([(i, int(i % 9 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = corpus()
    frame = docs(texts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        state = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(state)
        if k < 4:
            assert out.columns == COLUMNS
    kept = [{r["doc_id"]: r["text"] for r in s.select("doc_id", "text").collect()} for s in seen[:4]]
    clean = {i: t for i, t in enumerate(texts) if not (i < 90 and i % 9 == 0) and i != len(texts) - 1}
    assert kept[0] == clean
    groups = {}
    for i, t in clean.items():
        groups.setdefault("".join((t or "").split()), []).append(i)
    unique = {min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in groups.values()}
    assert set(kept[1]) == unique
    ids = sorted(unique)
    verdict = test_near_dedup.brute([texts[i] for i in ids], ids, 5, 80, 100)
    assert set(kept[2]) == {i for i, (_, least) in verdict.items() if i == least}
    ids = sorted(kept[2])
    want = test_suffix_dedup.brute([texts[i] for i in ids], corpus_pipeline.SUBSTRING_BYTES)
    assert {i: len((kept[3][i] or "").encode()) for i in ids} == {i: n - gone for i, (n, gone, _, _) in zip(ids, want, strict=True)}
    assert any(gone for _, gone, _, _ in want)
    packed = seen[4].groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in packed} == {i: len((kept[3][i] or "").split()) + 1 for i in ids}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[4].collect()))


def test_empty(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
