"""SentencePiece unigram encoding and decoding.

Pieces with log scores are held in a double-array trie over UTF-8 bytes. A text is normalised (a marker in front, spaces as
markers), and Viterbi finds the segmentation with the greatest sum of log scores; a character that no piece covers costs the
least score minus UNKNOWN_PENALTY and falls back to its byte pieces. Decoding joins the pieces, turns markers into
spaces and takes the first marker off.

The best segmentation of a text is the join of the best segmentations of its marked words if no piece has a marker after another
character; that is checked when the vocabulary is loaded, and words are then remembered in a bounded memo. Otherwise the
text is one word. Everything that is sent to executors (trie, scores, pieces) is bounded by the vocabulary.

The vocabulary's file is a parameter. Its figures are taken as the log scores, as they are (`stored`), so a file of the BPE kind gives its
negative merge ranks; `zipf` turns rank r into the log probability under Zipf's law, 1 / (r + 1) normalised.

Defined cases: a null text encodes like an empty one, to no pieces; a marker character inside a text decodes to a space, which
`round_trip` allows for; characters that the vocabulary lacks come back through bytes; ties go to the segmentation whose last
piece is longest; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie over byte strings as two integer arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free, many, queue = 1, 1, deque([(0, tree)])
        while queue:
            at, node = queue.popleft()
            value[at] = node.get(-1, -1)
            labels = sorted(c for c in node if c >= 0)
            if not labels:
                continue
            if len(check) - many < 2 * size or len(check) - free < 2 * size:
                base, check, value = base + [0] * 4 * size, check + [-1] * 4 * size, value + [-1] * 4 * size
            if len(labels) == 1:  # only children fill the holes
                while check[free] >= 0 or free <= labels[0]:
                    free += 1
                spot = free - labels[0] - 1
            else:  # families look on from where the last one found room
                spot = many
                while any(check[spot + c + 1] >= 0 for c in labels):
                    spot += 1
                many = max(many, spot - 128)
            base[at] = spot
            for c in labels:
                check[spot + c + 1] = at
            queue.extend((spot + c + 1, node[c]) for c in labels)
        self.base, self.check, self.value = base + [0] * 258, check + [-1] * 258, value + [-1] * 258

    def prefixes(self, data: bytes, start: int):
        """(end, value) of every key that is a prefix of data[start:], shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for end in range(start, len(data)):
            child = base[node] + data[end] + 1
            if check[child] != node:
                return
            node = child
            if value[node] >= 0:
                yield end + 1, value[node]


@dataclass
class Vocabulary:
    """Pieces by id with log scores; `byte_ids[b]` is the piece of byte b or -1."""

    pieces: list[bytes]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unknown: int
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        self.trie = DoubleArray({p: i for i, p in enumerate(self.pieces) if self.normal[i] and p})
        self.unknown_score = min((s for s, n in zip(self.scores, self.normal, strict=True) if n), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p.decode("utf-8", "replace")) for p, n in zip(self.pieces, self.normal, strict=True) if n)
        out = [p.replace(MARK.encode(), b" ") if n else b"" for p, n in zip(self.pieces, self.normal, strict=True)]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                out[i] = bytes([b])
        out[self.unknown] = " ⁇ ".encode()
        self.decoded = out


def load(path: str, scores: str = "stored") -> Vocabulary:
    """The vocabulary of a SentencePiece model file; `scores` is `stored` or `zipf` (see above)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
    byte_ids = [-1] * 256
    for i in ids:
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
    log = [float(model.get_score(i)) for i in ids]
    if scores == "zipf":
        own = sorted((i for i in ids if normal[i]), key=lambda i: (-log[i], i))
        total = math.log(sum(1 / (r + 1) for r in range(len(own))))
        for rank, i in enumerate(own):
            log[i] = -math.log(rank + 1) - total
    elif scores != "stored":
        raise ValueError("scores is 'stored' or 'zipf'")
    return Vocabulary([model.id_to_piece(i).encode() for i in ids], log, normal, byte_ids, model.unk_id())


def viterbi(vocabulary: Vocabulary, word: str) -> tuple[list[int], float]:
    """Ids and score of the best segmentation of a normalised string."""
    data = word.encode()
    n = len(data)
    best, back = [-math.inf] * (n + 1), [(-1, -1)] * (n + 1)
    best[0] = 0.0
    scores, unknown, trie = vocabulary.scores, vocabulary.unknown_score, vocabulary.trie
    base, check, value = trie.base, trie.check, trie.value
    for start in range(n):
        here = best[start]
        if here == -math.inf:
            continue
        lead = data[start]
        next_char = start + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        whole, node = False, 0
        for end in range(start, n):  # walk the trie: every piece that begins here
            child = base[node] + data[end] + 1
            if check[child] != node:
                break
            node = child
            piece = value[node]
            if piece >= 0:
                total = here + scores[piece]
                if end + 1 == next_char:
                    whole = True
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (start, piece)
        if not whole and here + unknown > best[next_char]:
            best[next_char], back[next_char] = here + unknown, (start, -1)
    ids: list[int] = []
    at = n
    while at:
        start, piece = back[at]
        if piece >= 0:
            ids.append(piece)
        else:
            own = [vocabulary.byte_ids[b] for b in data[start:at]]
            ids += own[::-1] if min(own) >= 0 else [vocabulary.unknown]
        at = start
    return ids[::-1], best[n]


class Codec:
    """Encodes and decodes texts; remembers words, in two generations of up to LIMIT, so that frequent ones stay."""

    LIMIT = 200_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})")
        self.known: dict[str, tuple[bytes, float]] = {}
        self.old: dict[str, tuple[bytes, float]] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Codec:
        """The vocabulary's codec in this process, so that tasks share what it remembers."""
        if not hasattr(vocabulary, "_codec"):
            vocabulary._codec = cls(vocabulary)
        return vocabulary._codec

    def _word(self, rest: str) -> tuple[bytes, float]:
        """Of a mark and what follows it."""
        found = self.known.get(rest) or self.old.get(rest)
        if found is None:
            ids, score = viterbi(self.vocabulary, MARK + rest)
            found = np.array(ids, "<u4").tobytes(), score
        if len(rest) <= 64:
            if len(self.known) >= self.LIMIT:
                self.known, self.old = {}, self.known
            self.known[rest] = found
        return found

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian uint32 ids, and the sum of log scores."""
        if not text:
            return b"", 0.0
        if not self.vocabulary.splits:
            return self._word(text.replace(" ", MARK))
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            words = [w[1:] for w in self.cut.split(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        parts = [self.known.get(w) or self._word(w) for w in words]
        return b"".join([p[0] for p in parts]), math.fsum([p[1] for p in parts])

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.vocabulary.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), n_pieces, score. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [codec.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), pa.array([len(x[0]) // 4 for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())],
                    names=["doc_id", "ids", "n_pieces", "score"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_pieces long, score double")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of `encoded`, which has `ids`, and the decoded `text`; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    names = [c for c in encoded.columns if c != "text"]

    def run(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            text = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(text, pa.string())], names=[*names, "text"])

    schema = encoded.select(*[f"`{n}`" for n in names], F.lit(None).cast("string").alias("text")).schema
    return encoded.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def op10_unigram(spark, sf_dir: str) -> DataFrame:
    """Encode every document, decode it again, and give what the ids hold."""
    import public_tokenizers

    vocabulary = load(public_tokenizers.path("piece_bpe_32k.model"))
    back = decode(encode(documents(spark, sf_dir), vocabulary), vocabulary)
    return back.select("doc_id", "n_pieces", "score", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def digest(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
