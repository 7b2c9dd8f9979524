import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwarden.llm import near_dedup as nd


def brute(texts, ids, n, num, den):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        m = min(n, len(words))
        sets.append({tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if words else set())
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and den * inter >= num * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        g = find(i)
        least[g] = min(least.get(g, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def corpus():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(900)]
    boiler = list(rng.choice(vocabulary, 40))
    texts = [None, "", " \n", "one", "ONE", "one two", "One TWO", "É b c d", "é b c d"]
    for g in range(25):
        base = list(rng.choice(vocabulary, rng.integers(5, 260)))
        if g % 3 == 0:
            base += boiler
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 18)))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    base = list(rng.choice(vocabulary, 120))
    for i in range(90):  # a chain: each differs a little from the one before
        base[i] = f"chain{i}"
        texts.append(" ".join(base))
    for size in (700, 1500):  # sets larger than either sketch
        base = list(rng.choice(vocabulary, size))
        for edits in (0, 3, 12, 20, 26, 30, 60, 90):
            own = list(base)
            for at in rng.choice(size, edits * size // 700, replace=False):
                own[int(at)] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
    texts += ["word " * 20_000, "a b c " * 300, "a b c " * 200]
    return texts


@pytest.mark.parametrize(("shingle", "similarity"), [(3, (85, 100)), (5, (80, 100))])
def test_matches_brute_force(docs, monkeypatch, shingle, similarity):
    monkeypatch.setattr(nd, "HUBS", 2)  # several turns
    texts = corpus()
    ids = [int(x) for x in np.random.default_rng(0).permutation(len(texts))]
    rows = nd.near_duplicates(docs(texts, ids), shingle=shingle, similarity=similarity).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, ids, shingle, *similarity)
    assert len(rows) == len(texts)


def test_a_group_around_an_original_makes_few_pairs(docs, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]  # so few words that edits make shingles that others have too
    base = list(rng.choice(vocabulary, 150))
    texts = [" ".join(base)]
    for i in range(300):
        own = list(base)
        for at in rng.choice(150, i % 14, replace=False):
            own[int(at)] = str(rng.choice(vocabulary))
        texts.append(" ".join(own))
    made = []
    verify = nd._verify
    monkeypatch.setattr(nd, "_verify", lambda pairs, *rest: (made.append(pairs.count()), verify(pairs, *rest))[1])
    rows = nd.near_duplicates(docs(texts), shingle=3, similarity=(85, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, list(range(len(texts))), 3, 85, 100)
    assert made and sum(made) < len(texts) ** 2 / 20  # a tenth of all pairs


def test_two_texts_meet_where_their_lists_first_agree(spark):
    base = [3 * i for i in range(200)]
    sets = {1: base, 2: base[:199] + [900], 3: base[1:] + [901], 4: sorted([*base[:10], *base[12:], 902])}
    sketched = spark.createDataFrame([(n, len(x), x) for n, x in sets.items()], "node long, size long, sketch array<long>")
    entries = nd.inverted_lists(sketched, (80, 100), 512).withColumn("grp", F.col("node"))
    met = nd.meetings(entries, nd.hub_columns(entries, "grp"), (80, 100), 512).where("node < hub").select("node", "hub").collect()
    assert set(map(tuple, met)) == {(a, b) for a in sets for b in sets if a < b}
    assert len(met) <= 12  # without looking back they meet in each of the 38 lists or so that they share


def test_text_ids(spark):
    frame = spark.createDataFrame([("b", "one two three four five six"), ("a", "One two three four five six"), (None, "x")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["component_id"] or "") for r in nd.near_duplicates(frame).collect()) == [("", ""), ("a", "a"), ("b", "a")]
    assert sorted(r["doc_id"] or "" for r in nd.keep_rows(frame).collect()) == ["", "a"]


def test_rows_kept(docs):
    long = " ".join(f"t{i}" for i in range(60))
    frame = docs([long, long + " more", None, None, long, "other text"], [4, 2, 7, 8, None, 9])
    kept = nd.keep_rows(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8, 9]
    assert nd.keep_rows(docs([])).collect() == [] and nd.near_duplicates(docs([])).collect() == []


def test_pairs_with_a_low_estimate_are_still_compared(spark):
    shared, rest = np.arange(37), np.arange(37, 64)  # 37 of the 64 least values are shared: 0.58, over four deviations below 0.8
    common = np.concatenate([shared, np.arange(1000, 1000 + 75)])  # 112 of 139: 0.806
    a, b = (np.sort(np.concatenate([common, rest[i::2]])).tolist() for i in range(2))
    sets = spark.createDataFrame([(1, len(a), a), (2, len(b), b)], "node long, size long, set array<long>")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in nd._verify(pairs, sets, (80, 100), 64).collect()] == [(1, 2)]
    assert nd._verify(pairs, sets, (81, 100), 64).collect() == []
