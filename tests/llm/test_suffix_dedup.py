import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwarden.llm import suffix_dedup as sd


def brute(texts, length):
    """(bytes, removed, spans, sha256 of the rest) by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digest(row):
    spans = row["spans"]
    return (row["n_bytes"], sum(b - a for a, b in spans), len(spans), hashlib.sha256(bytes(row["kept"])).hexdigest())


def test_cover_is_a_difference_cover():
    assert {(a - b) % sd.V for a in sd.COVER for b in sd.COVER} == set(range(sd.V))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=600), st.integers(1, 40), st.integers(sd.V, 90))
def test_suffix_order_puts_what_agrees_next_to_each_other(bits, period, depth):
    raw = bytes(97 + b for b in bits) + (bytes(97 + b for b in bits[:period]) * 30)[:400]
    text = np.frombuffer(raw + bytes(1200), np.uint8)
    got = sd.suffix_order(text, np.arange(len(raw)))
    assert sorted(got.tolist()) == list(range(len(raw)))
    heads = [bytes(text[i : i + sd.V]) for i in got]
    assert heads == sorted(heads)
    keys = [(int(i) % sd.V, bytes(text[i : i + depth])) for i in got]
    assert len([1 for x, y in zip(keys, keys[1:], strict=False) if x != y]) + 1 == len(set(keys))


def make(rng, n):
    words = [f"{rng.integers(10**6):x}" for _ in range(300)]
    passage = " ".join(rng.choice(words, 160))
    texts = []
    for i in range(n):
        own = " ".join(rng.choice(words, rng.integers(1, 260)))
        kind = i % 7
        if kind == 0:
            own += " " + passage + " " + own[:50]
        elif kind == 1:
            own = own[: len(own) // 2] + passage[100:700] + own[len(own) // 2 :]
        elif kind == 2 and texts:
            own = texts[int(rng.integers(len(texts)))] or ""
            at = len(own) // 2
            own = own[:at] + "É" + own[at + 1 :]
        elif kind == 3:
            own = (own[: int(rng.integers(1, 90))] or "a") * 12
        texts.append(own)
    return [None, "", "short", "a" * 399, "a" * 400, "b" * 2000, *texts, texts[-1], texts[-1]]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_matches_brute_force(docs, hot):
    texts = make(np.random.default_rng(11), 60)
    rows = sd.remove(docs(texts), hot_runs=hot).collect()
    want = brute(texts, 400)
    assert {r["doc_id"]: digest(r) for r in rows} == dict(enumerate(want))


@pytest.mark.parametrize("most", [1024, 1])  # whole runs told apart by broadcast, or met in the join
def test_short_strings_and_repeated_rows(docs, monkeypatch, most):
    monkeypatch.setattr(sd, "MOST_FREQUENT", most)
    texts = ["abcabcabcxyz", "xyzabcabc", "qqqqqqqqqqqq", None, "unique text here", "unique text here"]
    rows = sd.remove(docs(texts, [0, 1, 2, None, 4, 4]), length=6, k=3).collect()
    assert sorted(digest(r) for r in rows) == sorted(brute(texts, 6))


def test_rows_keep_their_columns(docs):
    frame = docs(["x" * 50, "é" * 300, None])
    out = sd.strip_rows(frame)
    assert out.columns == frame.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "x" * 50, 1: "", 2: ""}
    assert sd.remove(docs([])).collect() == [] and sd.strip_rows(docs([])).collect() == []


def test_query_gives_text_where_a_cut_falls_inside_a_character(spark, docs, tmp_path):
    shared = " ".join(f"w{i * 7919 % 1000}" for i in range(120))
    texts = ["one é" + shared, "two ©" + shared + "é", "é" * 30, None]  # é and © end in the same byte, so the repeated string begins with it
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in sd.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (n_bytes, removed, spans, sha) in enumerate(brute(texts, 400)):
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (n_bytes, removed, spans, sha)
    assert rows[0]["kept_text"] == "one \ufffd" and rows[1]["kept_text"] == "two \ufffdé" and rows[2]["kept_text"] == "é" * 30 and rows[3]["kept_text"] == ""
