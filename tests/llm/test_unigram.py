import itertools
import math

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwarden.llm import unigram as ug

PATH = public_tokenizers.path("piece_bpe_32k.model")


def small(extra=()):
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "aba", "é", "▁▁", "b▁" if extra else "bb"]
    n = len(pieces)
    scores = [0.0] * 257 + [-2.0, -1.5, -1.25, -2.75, -3.0, -2.5, -4.0, -6.0, -3.5, -2.0]
    return ug.Vocabulary([p.encode() for p in pieces], scores, [i > 256 for i in range(n)], list(range(1, 257)), 0)


def brute(v, text):
    """Best score over all segmentations of the marked text."""
    word = ug.MARK + text.replace(" ", ug.MARK)
    known = {p.decode(): s for p, s, n in zip(v.pieces, v.scores, v.normal, strict=True) if n}
    best = -math.inf
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in known or len(p) == 1 for p in parts):
            best = max(best, sum(known.get(p, v.unknown_score) for p in parts))
    return best


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("ab é☃ "), min_size=1, max_size=9), st.booleans())
def test_score_is_the_best_of_all_segmentations(text, crossing):
    v = small(crossing)
    codec = ug.Codec(v)
    assert v.splits != crossing
    ids, score = codec.encode(text)
    assert abs(score - brute(v, text)) < 1e-9
    assert codec.decode(ids) == text


def test_trie_finds_every_prefix():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"\xff\x00": 4, b"\x00": 5}
    trie = ug.DoubleArray(keys)
    for data in (b"abcd", b"\xff\x00", b"\x00\x00", b"zz", b""):
        assert list(trie.prefixes(data, 0)) == [(len(k), v) for k, v in sorted(keys.items(), key=lambda x: len(x[0])) if data.startswith(k)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_with_the_public_vocabulary(text):
    codec = _codec()
    ids, _ = codec.encode(text)
    assert codec.decode(ids) == text.replace(ug.MARK, " ")


def _codec(cache=[]):
    if not cache:
        cache.append(ug.Codec(ug.load(PATH)))
    return cache[0]


def test_ids_are_those_of_the_public_library(tmp_path):
    """The public library's own unigram Viterbi over the same pieces. Scores below -40,000 are raised to that: the library adds in 32 bits."""
    import pyarrow.parquet as pq
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), ug.Codec(ug.load(path))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    lines = [" ".join(words[i : i + 60]) for t in texts if t for words in [t.split()] for i in range(0, len(words), 60)]
    lines += ["Hello world", "a b", "two  marks", " edge ", "naïve façade", "x" * 300, "tab\tnew", "snow ☃ 𝄞", "日本語の文"]
    assert len(lines) > 500
    for line in lines:
        ids, _ = codec.encode(line)
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == library.encode(line), line
        assert library.decode(got) == codec.decode(ids) == line


def test_table(docs):
    texts = [None, "", " ", "plain words", "same", "same", "x" * 20_000, "tab\tnew\nline  two", "snow ☃ 𝄞"]
    v = _codec().vocabulary
    rows = {r["doc_id"]: r for r in ug.decode(ug.encode(docs(texts), v), v).collect()}
    assert {i: r["text"] for i, r in rows.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert rows[0]["n_pieces"] == rows[1]["n_pieces"] == 0 and rows[4]["ids"] == rows[5]["ids"]
    assert ug.encode(docs([]), v).collect() == []
