import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanwarden.llm import hpylm, registry, word_lm


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    follows = {w: [str(x) for x in rng.choice(words, 3)] for w in words}  # each word decides what comes next
    texts = []
    for _ in range(240):
        text = [str(rng.choice(words))]
        for _ in range(int(rng.integers(3, 60))):
            text.append(str(rng.choice(follows[text[-1]])) if rng.random() < 0.9 else str(rng.choice(words)))
        texts.append(" ".join(text))
    return [*texts, None, "", "W1 Unseen w2", "w1 unseen W2", "word " * 3000]


def one(value):
    return np.array([value], np.uint64)


def brute(texts):
    """Scores by the predictive formula, cell by cell in dictionaries; the seatings are those of the same random numbers."""
    tokens = [[*(t or "").encode().lower().split(), b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    pairs = [list(zip([b"", *t[:-1]], t, strict=True)) for t in tokens]
    c = Counter(p for ps, h in zip(pairs, held, strict=True) if not h for p in ps)
    single, customers_of = Counter(), Counter()
    for (u, w), n in c.items():
        single[w] += n
        customers_of[u] += n
    key = {w: hpylm._word_hash(w) if w else hpylm._END for w in {x for p in c for x in p}}
    kinds, size = Counter(w for _, w in c), len(single)
    rate = lambda values: min(0.95, max(0.05, (a := sum(x == 1 for x in values)) / max(1, a + 2 * sum(x == 2 for x in values))))
    discounts = rate(list(c.values())), rate(list(kinds.values()))
    tables, root_c, root_t = dict.fromkeys(c, 1), dict(kinds), dict.fromkeys(kinds, 1)
    total = defaultdict(float)
    root = word_lm.Root(sum(root_c.values()), sum(root_t.values()), size, discounts)
    kept = []
    for sweep in range(1, hpylm.SWEEPS + 1):
        tables_of = Counter()
        for (u, _), t in tables.items():
            tables_of[u] += t
        p = {w: (root_c[w] - discounts[1] * root_t[w] + root.base()) / (hpylm.STRENGTH + root.customers) for w in single}
        tables = {
            (u, w): int(hpylm.seat(np.array([n]), discounts[0], np.array([(hpylm.STRENGTH + discounts[0] * tables_of[u]) * p[w]]), hpylm.mix64(word_lm.pair_seeds(one(key[u]), one(key[w])) + np.uint64(sweep)))[0])
            for (u, w), n in c.items()
        }
        root_c = Counter()
        for (_, w), t in tables.items():
            root_c[w] += t
        root_t = {w: int(word_lm.reseat_root(np.array([root_c[w]]), root, one(key[w]), sweep)[0]) for w in single}
        root = word_lm.Root(sum(root_c.values()), sum(root_t.values()), size, discounts)
        if sweep > hpylm.BURN_IN:
            kept.append((tables, Counter(root_c), root_t, root))

    def chance(u, w):
        total = 0.0
        for t, rc, rt, r in kept:
            under = (rc.get(w, 0) - discounts[1] * rt.get(w, 0) + r.base()) / (hpylm.STRENGTH + r.customers)
            left = hpylm.STRENGTH + discounts[0] * sum(n for (v, _), n in t.items() if v == u)
            total += (c[u, w] - discounts[0] * t.get((u, w), 0) + left * under) / (hpylm.STRENGTH + customers_of[u])
        return total / len(kept)

    n = sum(single.values())
    scores = {i: sum(k * math.log10(chance(*p)) for p, k in Counter(ps).items()) for i, ps in enumerate(pairs)}
    counts = {i: (h, len(t), sum(single[w] > 0 for w in t), n) for i, (t, h) in enumerate(zip(tokens, held, strict=True))}
    bases = {i: sum(math.log10((single[w] + 0.5) / (n + 0.5 * (size + 1))) for w in t) for i, t in enumerate(tokens)}
    return scores, counts, bases, chance, single


@pytest.fixture(scope="module")
def expected():
    return brute(corpus())


@pytest.mark.parametrize("block", [400, 10**6])
def test_every_score_is_the_models_probability(docs, expected, block):
    scores, counts, bases, _, _ = expected
    rows = word_lm.score(docs(corpus()), block_tokens=block).collect()
    assert len(rows) == len(scores)
    for r in rows:
        i = r["doc_id"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == counts[i]
        assert r["base_score"] == pytest.approx(bases[i], rel=1e-9)
        assert r["score"] == pytest.approx(scores[i], rel=1e-6)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_probabilities_sum_to_one(expected):
    *_, chance, single = expected
    for u in (b"", b"w1", b"word", b"never"):
        assert sum(chance(u, w) for w in single) + chance(u, b"another") == pytest.approx(1)


def test_the_word_before_is_the_context(docs):
    """The query's model tells apart what follows a word; a model of few contexts does not."""
    assert registry.QUERIES["op4_pitman_yor"] is word_lm.op4_pitman_yor
    table = docs(corpus())
    own, few = ({r["doc_id"]: r["score"] for r in f(table).where("held_out AND doc_id < 240").collect()} for f in (word_lm.score, hpylm.score))
    assert sum(own.values()) > 0.75 * sum(few.values())


def test_odd_tables(docs):
    assert word_lm.score(docs([])).collect() == []
    rows = word_lm.score(docs(["a b", "a b"], [None, None])).collect()
    assert len(rows) == 2 and rows[0]["score"] == rows[1]["score"] and not rows[0]["held_out"]
    alone = word_lm.score(docs(["a b"], [next(i for i in range(99) if hpylm.held_out(i))])).collect()
    assert len(alone) == 1 and alone[0]["n_known"] == alone[0]["train_tokens"] == 0 and alone[0]["score"] == pytest.approx(0)
