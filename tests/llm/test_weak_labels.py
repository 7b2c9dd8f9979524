import numpy as np
import pytest

from spanwarden.llm import weak_labels as wl


def test_em_finds_the_labellers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.2
    right = np.array([0.95, 0.8, 0.7])
    votes = np.where(rng.random((len(truth), 3)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.1] = wl.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = wl.LabelModel.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03 and np.abs(np.array(model.accuracy()) - right).max() < 0.03
    guess = model.posterior(votes) > 0.5
    assert (guess == truth).mean() > (votes[:, 0] == truth).mean() - 0.01


def test_posterior_is_bayes_rule():
    model = wl.LabelModel(0.3, np.array([[[0.7, 0.2, 0.1], [0.1, 0.8, 0.1]], [[0.5, 0.1, 0.4], [0.3, 0.6, 0.1]]]))
    for a in range(3):
        for b in range(3):
            keep, reject = 0.7 * model.table[0, 0, a] * model.table[1, 0, b], 0.3 * model.table[0, 1, a] * model.table[1, 1, b]
            assert model.posterior(np.array([[a, b]]))[0] == pytest.approx(reject / (keep + reject))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    texts, toxic = [], []
    for i in range(600):
        own = list(rng.choice(words, rng.integers(30, 120)))
        bad = i % 6 == 0
        if bad:
            for w in rng.choice(["stupid", "idiot", "scum", "moron", "brakkoman", "brakkoter"], 4, replace=False):
                own.insert(int(rng.integers(len(own))), w)
        texts.append(" ".join(own))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(spark, docs, corpus):
    texts, toxic = corpus
    frame = docs(texts)
    notes = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2 == 0] + [(None, 1), (10**9, None)], "doc_id long, toxic int")
    model = wl.fit(frame, notes, sample_rows=400)
    got = {r["doc_id"]: r["kept"] for r in wl.classify(frame, model).collect()}
    held = [i for i in range(len(texts)) if i % 2]
    assert np.mean([got[i] == (not toxic[i]) for i in held]) > 0.97
    assert any(m.startswith(b"brakko") for m in model.marks)
    kept = wl.filter_rows(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_odd_rows(docs, corpus):
    texts = [None, "", " ", "x", "x", "long word " * 20_000, "$$$ ||| " * 50, *corpus[0][:60]]
    frame = docs(texts)
    model = wl.fit(frame)
    rows = wl.classify(frame, model).collect()
    assert len(rows) == len(texts) and not any(r["score"] is None for r in rows)
    empty = docs([])
    assert wl.classify(empty, wl.fit(empty)).collect() == [] and wl.filter_rows(empty, wl.fit(empty)).collect() == []
