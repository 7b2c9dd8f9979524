"""Token-id files in patched frame-of-reference blocks.

`encode_corpus` range-partitions documents by id, encodes them, and each task writes one file; `read_corpus` reads the files
back. A file holds blocks of BLOCK ids: the block's minimum is subtracted, the rest is packed at the bit width that the
PERCENTILE-th value needs, and values that do not fit are kept whole in an exception list. A document table (id, number
of tokens) and an index of block starts follow, so that a reader can start at any block.

File (little-endian): MAGIC | blocks | document ids int64 | null flags u8 | token counts u64 | block starts u64 | footer.
Block: minimum u32 | values u16 | width u8 | exceptions u16 | packed bits | exception positions u16 | exception values u32.
Footer: ids u64 | documents u64 | blocks u64 | start of the document table u64 | start of the block index u64 | MAGIC.

Files are written under a temporary name and moved, one name an attempt, and the manifest lists only the files of tasks that ended
well; a lost executor costs a rewrite of its file. Paths are URIs that `pyarrow.fs` opens, in the shared folder.

Defined cases: a null text is an empty document, which has the end id alone; a null document id sorts first; rows with the same id stay apart,
ordered by text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, scratch_path

MAGIC = b"SWPFOR01"
BLOCK = 1024
PERCENTILE = 0.9
END_ID = 2
_HEAD = struct.Struct("<IHBH")
_FOOT = struct.Struct("<QQQQQ8s")
_BLOCKS_AT_ONCE = 128
_BYTES_AT_ONCE = 8 << 20


def pack_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Encode uint32 values as blocks of BLOCK (the last may be shorter)."""
    out: list[bytes] = []
    whole = len(values) // BLOCK
    for at in range(0, whole, _BLOCKS_AT_ONCE):
        out += _pack_rows(values[at * BLOCK : min(whole, at + _BLOCKS_AT_ONCE) * BLOCK].reshape(-1, BLOCK), percentile)
    if len(values) % BLOCK:
        out += _pack_rows(values[whole * BLOCK :].reshape(1, -1), percentile)
    return out


def _pack_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    n = rows.shape[1]
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    k = min(n - 1, int(percentile * n))
    widths = np.frexp(np.partition(rest, k, axis=1)[:, k].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        part = rest[own]
        if width:
            bits = ((part[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        over = (part >> np.uint32(width)) > 0 if width < 32 else np.zeros(part.shape, bool)
        for j, i in enumerate(own.tolist()):
            at = np.flatnonzero(over[j])
            body = packed[j].tobytes() if width else b""
            out[i] = _HEAD.pack(int(least[i]), n, width, len(at)) + body + at.astype("<u2").tobytes() + part[j][at].astype("<u4").tobytes()
    return out


def unpack_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The block's uint32 values and where the next block starts."""
    least, n, width, odd = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        values = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    else:
        values = np.zeros(n, np.uint32)
    at += size
    if odd:
        where = np.frombuffer(data, "<u2", odd, at)
        values[where] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return values + np.uint32(least), at + 6 * odd


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """String -> ids, filled by `make`. Two generations: what is asked for again moves on when the older one is dropped."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Encodes texts with a `tokenizers` file, each space-separated chunk of a batch once.

    The byte-level pre-tokeniser always starts a new piece at a space between two other characters, so a text may be cut there
    without changing its ids. Texts that hold an added token, or control characters on whose class libraries differ, go to the library whole.
    Of texts that hold other spaces, the ids of chunks are remembered; a chunk of plain letters and one run of plain marks is two pieces to the
    pre-tokeniser, and so is remembered as two.
    """

    LIMIT = 300_000
    LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?$%&*#|]"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rare = re.compile(r"[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
        self.unclear = re.compile(r"[\x1c-\x1f\x85\u180e\u200b]")
        self.odd = re.compile(r"(?<!\S) | (?!\S)")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.marked = re.compile(f"({self.LETTERS}+)({self.MARKS}*)")
        self.alphabet = {b: chr(c) for b, c in _byte_alphabet().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaces, self.feeds = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        for leads, byte in ((self.spaces, 0x20), (self.feeds, 0x0A)):
            leads[[i for token, i in vocabulary.items() if token.startswith(self.alphabet[byte])]] = True
        self.known: dict[str, bytes] = {}
        self.pieces = _Memo(self._piece, self.LIMIT)
        self.chunks = _Memo(self._chunk, self.LIMIT)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of what the pre-tokeniser leaves in one piece: straight to the library's model, in the byte-level alphabet."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return struct.pack("<%dI" % len(tokens), *[t.id for t in tokens])

    def _word(self, space: str, word: str) -> bytes:
        if found := self.marked.fullmatch(word):
            return self.pieces[space + found[1]] + self.pieces[found[2]] if found[2] else self.pieces[space + word]
        return self.library(space + word)

    def _chunk(self, chunk: str) -> bytes:
        """Of a space and then the chunk. A line feed between two other characters is a piece of its own."""
        if "\n" in chunk and "" not in (lines := chunk.split("\n")) and not self.rare.search(chunk):
            feed = self.pieces["\n"]
            return feed.join([self._word(" ", lines[0]), *[self._word("", line) for line in lines[1:]]])
        return self._word(" ", chunk)

    def split(self, text: str) -> list[str] | str | None:
        """The text cut at spaces, the text itself where every space and line feed is a cut, or None where the library has to see the whole text."""
        if any(t in text for t in self.added):
            return None
        odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace()
        if self.rare.search(text):
            if self.unclear.search(text):
                return None
            odd = True
        return self.cut.split(text) if odd else text

    def spaced(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without spaces, each with the space before it, or from the line feed on that it begins with.

        The library gets many new ones in one text, where each one's first token alone begins with a space or with a line feed.
        """
        if len(self.known) >= 2 * self.LIMIT:
            self.known.clear()
        found = list(map(self.known.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        for mark, leads in ((" ", self.spaces), ("\n", self.feeds)):
            own = [i for i in new if (chunks[i][:1] == "\n") == (mark == "\n")]
            for at in range(0, len(own), 10_000):
                part = [chunks[i] for i in own[at : at + 10_000]]
                joined = " " + " ".join(part) if mark == " " else "".join(part)
                ids = np.zeros(0, "<u4") if any(t in joined for t in self.added) else np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                starts = np.flatnonzero(leads[ids])
                if len(starts) == len(part):
                    data, ends = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
                    made = [data[s:e] for s, e in zip(ends, ends[1:], strict=False)]
                else:
                    made = [self.library(x if mark == "\n" else " " + x) for x in part]
                self.known.update(zip(part, made, strict=True))
                for i, one in zip(own[at : at + 10_000], made, strict=True):
                    found[i] = one
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text. Chunks that the texts share are looked up once."""
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            parts = self.split(text)
            if parts is None:
                out[i] = self.library(text)
            elif parts is text:
                if text:
                    plain.append(i)
            else:
                out[i] = b"".join([self.library(parts[0]) if parts[0] else b"", *map(self.chunks.__getitem__, parts[1:])])
        if not plain:
            return out
        cut = pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        starts, chunks = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        first = np.zeros(len(chunks), bool)
        first[starts[:-1]] = True  # has no space before it
        index = chunks.indices.to_numpy()
        heads = [self.library(x) for x in chunks.dictionary.take(pa.array(index[first])).to_pylist()]
        # A chunk of letters and marks is two entries, any other one and an empty one.
        both = pc.match_substring_regex(chunks.dictionary, rf"^\n?{self.LETTERS}+{self.MARKS}*$")
        words = pc.if_else(both, pc.replace_substring_regex(chunks.dictionary, f"{self.MARKS}+$", ""), chunks.dictionary).dictionary_encode()
        marks = pc.if_else(both, pc.replace_substring_regex(chunks.dictionary, rf"^\n?{self.LETTERS}+", ""), "").dictionary_encode()
        ids = self.spaced(words.dictionary.to_pylist())
        after = [self.pieces[x] if x else b"" for x in marks.dictionary.to_pylist()]
        entries = np.empty((len(chunks), 2), np.int64)
        entries[:, 0] = words.indices.to_numpy()[index]
        entries[:, 1] = marks.indices.to_numpy()[index] + len(ids)
        entries[first, 0] = len(ids) + len(after) + np.arange(len(heads))
        entries[first, 1] = len(ids) + len(after) + len(heads)
        whole = pa.array([*ids, *after, *heads, b""], pa.large_binary()).take(pa.array(entries.ravel()))
        at = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1)[2 * starts].tolist()
        data = memoryview(whole.buffers()[2])
        for i, s, e in zip(plain, at, at[1:], strict=False):
            out[i] = bytes(data[s:e])
        return out


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder a worker process: its memo serves all tasks that the process runs."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Streams documents into one file."""

    def __init__(self, sink):
        self.sink, self.at, self.n = sink, 0, 0
        self.rest, self.starts, self.ids, self.nulls, self.counts = b"", [], [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, data: bytes) -> None:
        for block in pack_blocks(np.frombuffer(data, "<u4")):
            self.starts.append(self.at)
            self._put(block)

    def add(self, doc_ids: list, tokens: list[bytes]) -> None:
        self.ids += [0 if i is None else i for i in doc_ids]
        self.nulls += [i is None for i in doc_ids]
        self.counts += [len(t) // 4 for t in tokens]
        data = b"".join([self.rest, *tokens])
        whole = len(data) // (4 * BLOCK) * 4 * BLOCK
        self.rest = data[whole:]
        self.n += sum(len(t) for t in tokens) // 4
        self._blocks(data[:whole])

    def close(self) -> None:
        self._blocks(self.rest)
        table = self.at
        self._put(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.counts, "<u8").tobytes())
        index = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(_FOOT.pack(self.n, len(self.ids), len(self.starts), table, index, MAGIC))


def read_documents(data: bytes):
    """(document id or None, uint32 ids) of each document of a file, in file order, a bounded number of blocks at a time."""
    n_ids, n_docs, n_blocks, table, index, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if magic != MAGIC or data[:8] != MAGIC:
        raise ValueError("not a token file")
    ids = np.frombuffer(data, "<i8", n_docs, table)
    nulls = np.frombuffer(data, np.uint8, n_docs, table + 8 * n_docs)
    counts = np.frombuffer(data, "<u8", n_docs, table + 9 * n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks, index)
    held, have, block = [], 0, 0
    for doc in range(n_docs):
        need = int(counts[doc])
        while have < need:
            values, _ = unpack_block(data, int(starts[block]))
            held.append(values)
            have, block = have + len(values), block + 1
        joined = np.concatenate(held) if len(held) != 1 else held[0]
        yield None if nulls[doc] else int(ids[doc]), joined[:need]
        held, have = [joined[need:]], have - need


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_corpus(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids as files below `folder`, in ascending id order. Returns the manifest: file, its first token's position, counts.

    The manifest has one row a file, so collecting it to sum the starts is bounded by the number of partitions.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    placed = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches):
        from pyspark import TaskContext

        encoder = writer = sink = None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if writer is None:
                filesystem, base = _open(folder)
                filesystem.create_dir(base, recursive=True)
                encoder = encoder_for(tokenizer_path)
                name = f"{base}/ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                sink = filesystem.open_output_stream(name + ".part")
                writer = Writer(sink)
            step = min(2048, max(1, batch.num_rows * _BYTES_AT_ONCE // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tokens = encoder.encode(part.column("text").to_pylist())
                writer.add(part.column("id").to_pylist(), [t + end for t in tokens])
        if writer is None:
            return
        writer.close()
        sink.close()
        filesystem.move(name + ".part", name + ".pfor")
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [f"{name.rpartition('/')[2]}.pfor"], "n_ids": [writer.n], "n_docs": [len(writer.ids)], "n_bytes": [writer.at]})

    made = placed.mapInArrow(write, "part long, file string, n_ids long, n_docs long, n_bytes long").collect()
    start, manifest = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append((len(manifest), f"{folder}/{r['file']}", start, r["n_ids"], r["n_docs"], r["n_bytes"]))
        start += r["n_ids"]
    return docs.sparkSession.createDataFrame(manifest, "file_no int, file string, start long, n_ids long, n_docs long, n_bytes long")


def read_corpus(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian uint32, as binary). One file a task at a time."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                filesystem, path = _open(uri)
                with filesystem.open_input_file(path) as source:
                    data = source.read()
                rows, size = [], 0
                for doc_id, ids in read_documents(data):
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return manifest.repartition(max(1, manifest.count()), "file_no").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and give the digest of each document."""
    import public_tokenizers

    manifest = encode_corpus(documents(spark, sf_dir), scratch_path(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_corpus(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def digest(ids: list[int]) -> int:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
