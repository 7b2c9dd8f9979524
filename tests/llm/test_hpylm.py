import math
import zlib
from collections import Counter

import numpy as np
import pytest

from spanwarden.llm import hpylm


def corpus():
    rng = np.random.default_rng(8)
    tongues = [(["the", "of", "and"], [f"en{i}" for i in range(120)]), (["der", "die", "und"], [f"de{i}" for i in range(120)])]
    texts = []
    for i in range(260):
        short, long = tongues[i % 2]
        p = 1 / np.arange(1, len(long) + 1)
        texts.append(" ".join(str(rng.choice(short)) if rng.random() < 0.3 else str(rng.choice(long, p=p / p.sum())) for _ in range(int(rng.integers(5, 90)))))
    return [*texts, None, "", "THE Unseen-word of", "the unseen-word OF", "word " * 5000]


def base(texts):
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return {i: (h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, (t, h) in enumerate(zip(tokens, held, strict=True))}


@pytest.mark.parametrize("block", [300, 10**6])
def test_counts_match_brute_force_and_held_out_text_is_better_predicted(docs, block):
    texts = corpus()
    rows = hpylm.score(docs(texts), block_tokens=block).collect()
    want = base(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got[262] == pytest.approx(got[263])


def test_blocks_do_not_change_the_model(docs):
    texts = corpus()
    a, b = ({r["doc_id"]: r["score"] for r in hpylm.score(docs(texts), block_tokens=n).collect()} for n in (200, 10**6))
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    word = np.arange(50, dtype=np.int64) * 7 + 1
    dense = rng.poisson(0.7, (50, hpylm.CONTEXTS))
    dense[:, 0] += 1
    row, context = np.nonzero(dense)
    count = dense[row, context].astype(np.int64)
    customers, kinds = np.bincount(context, count, hpylm.CONTEXTS), np.bincount(context, minlength=hpylm.CONTEXTS).astype(float)
    history = [hpylm.Totals(np.append(customers, kinds.sum()), np.append(kinds, 50.0), 50, (0.6, 0.5))]
    for _ in range(hpylm.SWEEPS):
        *_, (tables, root_c, root_t) = hpylm._reseat(word, row, context, count, history)
        history.append(hpylm.Totals(np.append(customers, root_c.sum()), np.append(np.bincount(context, tables, hpylm.CONTEXTS), root_t.sum()), 50, (0.6, 0.5)))
    cells, roots = hpylm._probabilities(word, row, context, count, history)
    left = np.stack([a.backoff() for a in history[hpylm.BURN_IN + 1 :]])
    every = np.arange(hpylm.CONTEXTS)
    p = np.stack([hpylm._unseen(np.repeat(r[None, :], hpylm.CONTEXTS, 0), every, left) for r in roots])
    p[row, context] = cells
    nobody = np.array([a.root(np.zeros(1), np.zeros(1))[0] for a in history[hpylm.BURN_IN + 1 :]])
    unknown = hpylm._unseen(np.repeat(nobody[None, :], hpylm.CONTEXTS, 0), every, left)
    assert np.allclose(p.sum(axis=0) + unknown, 1, atol=1e-12)


def test_scores_are_the_models_probabilities(docs):
    """Every document's score against the predictive formula, cell by cell, from the seating of the same sweeps."""
    texts = corpus()
    table = docs(texts)
    words = hpylm.training_words(hpylm.blocks(table, block_tokens=10**6), 3)
    history = hpylm.sample(words)
    served, root = {}, {}  # (word, context) -> (customers, tables by sweep); word -> (customers, tables) by sweep
    for r in words.collect():
        contexts = [k for k in range(hpylm.CONTEXTS) if r["mask"] >> k & 1]
        n = np.frombuffer(r["counts"], "<u4").astype(np.int64)
        sweeps = list(hpylm._reseat(np.array([r["word"]]), np.zeros(len(n), np.int64), np.array(contexts), n, history[:-1]))[hpylm.BURN_IN :]
        root[r["word"]] = [(float(c[0]), float(t[0])) for _, c, t in sweeps]
        for i, u in enumerate(contexts):
            served[r["word"], u] = int(n[i]), [float(t[i]) for t, _, _ in sweeps]
    kept = history[hpylm.BURN_IN + 1 :]

    def p(word, u):
        total = 0.0
        for k, h in enumerate(kept):
            d0, d1 = h.discounts
            c, t = root.get(word, [(0.0, 0.0)] * len(kept))[k]
            parent = (c - d1 * t + (hpylm.STRENGTH + d1 * h.tables[-1]) / (h.words + 1)) / (hpylm.STRENGTH + h.customers[-1])
            n, tables = served.get((word, u), (0, [0.0] * len(kept)))
            total += (n - d0 * tables[k] + (hpylm.STRENGTH + d0 * h.tables[u]) * parent) / (hpylm.STRENGTH + h.customers[u])
        return total / len(kept)

    def brute(text):
        total, u = 0.0, 0
        for w in [*(text or "").encode().lower().split(), b""]:
            key = hpylm._word_hash(w) if w else hpylm._END
            total += math.log10(p(key - 2**64 if key >= 2**63 else key, u))
            u = hpylm._class(w) or u
        return total

    got = {r["doc_id"]: r["score"] for r in hpylm.score(table, block_tokens=700).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute(t), rel=3e-7), i


def test_seating_follows_the_process():
    n = 4000
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(977)
    tables = hpylm.seat(np.full(n, 12), 0.5, np.full(n, 0.8), hpylm.mix64(seeds))
    mean = 1.0
    chances = {1: 1.0}
    for seated in range(1, 12):
        following = {}
        for t, p in chances.items():
            new = 0.8 / (0.8 + seated - 0.5 * t)
            following[t + 1] = following.get(t + 1, 0) + p * new
            following[t] = following.get(t, 0) + p * (1 - new)
        chances = following
    mean = sum(t * p for t, p in chances.items())
    assert abs(tables.mean() - mean) < 0.08
    assert (hpylm.seat(np.array([0, 1, 5]), 0.5, np.full(3, 1e-12), seeds[:3]) == [0, 1, 1]).all()


def test_odd_tables(docs):
    assert hpylm.score(docs([])).collect() == []
    rows = hpylm.score(docs(["a b", "a b"], [None, None])).collect()
    assert len(rows) == 2 and rows[0]["score"] == rows[1]["score"] and not rows[0]["held_out"]
