import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwarden.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3000), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, percentile):
    data = b"".join(ts.pack_blocks(np.array(values, np.uint32), percentile))
    got, at = [], 0
    while at < len(data):
        block, at = ts.unpack_block(data, at)
        got += block.tolist()
    assert got == values


@pytest.mark.parametrize("text", ["", " ", "a  b", "don 't stop's", " lead and trail ", "x\n y \n\n z\t q", "é ñ ß|| ## <|endoftext|> end", "　wide nb sp", "12 345 a1 \x1f b", "a.\nB c,\nd\n\ne\r\nf \ng\n h", "x\n"])
def test_chunks_give_the_library_ids(text):
    encoder = ts.Encoder(PATH)
    for _ in range(2):
        got = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1'\n\t.s é"), max_size=30))
def test_chunks_on_random_texts(text):
    encoder = _encoder()
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def _encoder(cache=[]):
    if not cache:
        cache.append(ts.Encoder(PATH))
    return cache[0]


def test_files_read_back(spark, docs, tmp_path):
    texts = ["b word again", None, "", "long " * 30_000, "same", "same"]
    frame = docs(texts, [5, 9, None, 1, 3, 3])
    manifest = ts.encode_corpus(frame, f"file://{tmp_path}/ids", PATH)
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in ts.read_corpus(manifest).collect()]
    want, start = [], 0
    for i, t in sorted(zip([5, 9, None, 1, 3, 3], texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = _encoder().tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, ids))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_empty_table(docs, tmp_path):
    manifest = ts.encode_corpus(docs([]), f"file://{tmp_path}/none", PATH)
    assert ts.read_corpus(manifest).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé 1'\n.,s!<\xa0日"), max_size=40), max_size=12))
def test_texts_of_one_batch(texts):
    """Chunks that are looked up once for all texts of a batch give what the library gives for each text."""
    encoder = _encoder()
    encoder.known.clear()
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts[::-1])] == want[::-1]
