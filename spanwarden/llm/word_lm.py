"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs, its seating sampled by Gibbs.

Words are the dishes. There is one restaurant for each preceding word (the end of a text precedes the next one's first word); all share one parent, the root,
whose base is uniform over the training vocabulary and one unknown word. In a restaurant with discount d and strength s,
P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u), where c counts customers and t tables, and each table of a restaurant is a customer of the root. A sweep
reseats the customers of every word in every restaurant given the restaurant's tables and the root's probabilities (`hpylm.seat`), then those of the root.
The predictive probabilities of the sweeps after BURN_IN are averaged.

Documents are read in blocks of about BLOCK_TOKENS tokens. A block sends each of its distinct pairs once, dealt by the preceding word, so a restaurant lies whole
in one part; it gets back each pair's log probability (rounded to 32 bits) and its word's count, in the order in which it sent them. Parts keep their pairs in files in
the shared folder. In each sweep a part sends each of its distinct words once with the sum of its tables, dealt by word, and gets back the
root's customers and tables of that word; only the totals of the root come to the driver. Random numbers are a hash of (pair, sweep, customer), so a lost task
seats its words as before. Counts and statistics are of all training documents.

Defined cases: as in `hpylm`.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, mix64, partitions, scratch_path, stash
from .hpylm import _END, BURN_IN, STRENGTH, SWEEPS, _word_hash, held_out, seat
from .token_store import _open

BLOCK_TOKENS = 3_000_000
_U = np.uint64
#: Arrays of many numbers, which are kept by byte planes.
_PLANES = ("own", "rest", "where", "token", "tables", "count", "total")
_ROWS = "block long, part long, first long, file string, data binary"
_MAIL = "to long, sender long, file string, sums array<double>, data binary"


def _row(schema: list[str], **columns) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "file": pa.string(), "sums": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) for c in schema], names=schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string. Whole numbers take as many bytes as the greatest of them asks for, the first bytes of all first."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind == "f":
            head += [len(a), 0]
            body.append(a.astype("<f4").tobytes())
        else:
            width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            head += [len(a), width]
            body += [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, k]).tobytes() for k in range(width)]
    data = b"".join(body)
    return np.array([len(head), *head, len(data)], "<u4").tobytes() + pa.Codec("zstd").compress(data, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    """uint64 arrays, and float64 ones of what were fractions."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, "<u4", n + 1, 4).tolist()
    body, at, out = pa.Codec("zstd").decompress(data[4 * n + 8 :], head[-1], asbytes=True), 0, []
    for size, width in zip(head[1:-1:2], head[2:-1:2], strict=True):
        if width:
            whole = np.zeros((size, 8), np.uint8)
            whole[:, :width] = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size).T
            out.append(whole.view("<u8").ravel())
        else:
            out.append(np.frombuffer(body, "<f4", size, at).astype(np.float64))
        at += size * (width or 4)
    return out


class Block:
    """Documents of one block as pairs of words."""

    def __init__(self):
        self.index: dict[bytes, int] = {b"": 0}  # no word is empty: that is the end
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, text: bytes) -> None:
        index, words = self.index, text.lower().split()
        self.ids.append(np.fromiter((index.setdefault(w, len(index)) for w in [*words, b""]), np.int64, len(words) + 1))
        self.docs.append((doc_id, held_out(doc_id), len(words) + 1))
        self.tokens += len(words) + 1

    def finish(self, block: int, parts: int, folder: str):
        """Rows of pairs, one a part, and one that names the file of the documents, whose tokens are numbers of pairs."""
        ids, size = np.concatenate(self.ids), len(self.index)
        sizes = np.array([d[2] for d in self.docs])
        train = np.repeat(np.array([not d[1] for d in self.docs]), sizes)
        pairs, where = np.unique(np.concatenate([[0], ids[:-1]]) * size + ids, return_inverse=True)  # each text ends in 0
        counts = np.bincount(where, train, len(pairs)).astype("<u4")
        hashes = np.array([_word_hash(w) if w else _END for w in self.index], _U)
        before, word = hashes[pairs // size], hashes[pairs % size]
        part = (mix64(before) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        where = rank[where].astype("<u4")
        before, word, counts, part = before[order], word[order], counts[order], part[order]
        none = np.array([d[0] is None for d in self.docs])
        file = _save(folder, id=np.array([d[0] or 0 for d in self.docs], np.int64), none=none, held=np.array([d[1] for d in self.docs]), size=sizes, token=where)
        names = _names(_ROWS)
        yield _row(names, block=[block], part=[None], first=[None], file=[file], data=[None])
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            heads = np.append(0, np.flatnonzero(before[s + 1 : e] != before[s : e - 1]) + 1)  # pairs of one preceding word are neighbours
            words, own = np.unique(word[s:e], return_inverse=True)
            yield _row(names, block=[block], part=[int(part[s])], first=[s], file=[None], data=[_pack(before[s:e][heads], np.diff(np.append(heads, e - s)), words, own, counts[s:e])])


def _pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Preceding word, word and count of a block's pairs of one part."""
    before, lengths, words, own, counts = _unpack(data)
    return np.repeat(before, lengths.astype(np.int64)), words[own.astype(np.int64)], counts.astype(np.int64)


def blocks(docs: DataFrame, parts: int, folder: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        from pyspark import TaskContext

        own, number = Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, data in zip(batch.column("id").to_pylist(), batch.column("data"), strict=True):
                own.add(doc_id, data.as_py())
                if own.tokens >= block_tokens:
                    yield from own.finish(number, parts, folder)
                    own, number = Block(), number + 1
        if own.docs:
            yield from own.finish(number, parts, folder)

    return rows.mapInArrow(run, _ROWS)


def _save(folder: str, **arrays) -> str:
    """Write arrays to a new file below `folder`; its name. A file counts once a row that names it has been written."""
    filesystem, base = _open(folder)
    filesystem.create_dir(base, recursive=True)
    raw = io.BytesIO()
    np.savez(raw, **{k: np.frombuffer(_pack(a), np.uint8) if k in _PLANES else a for k, a in arrays.items()})
    name = f"{folder}/{uuid.uuid4().hex}.npz"
    with filesystem.open_output_stream(_open(name)[1]) as sink:
        sink.write(len(raw.getvalue()).to_bytes(8, "little") + pa.Codec("zstd").compress(raw.getvalue(), asbytes=True))
    return name


def _load(name: str) -> dict[str, np.ndarray]:
    filesystem, path = _open(name)
    with filesystem.open_input_file(path) as source:
        data = source.read()
    held = np.load(io.BytesIO(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)))
    return {k: _unpack(held[k].tobytes())[0].astype(np.int64) if k in _PLANES else held[k] for k in held.files}


def _drop(names) -> None:
    for name in names:
        filesystem, path = _open(name)
        filesystem.delete_file(path)


def _groups(batches, key: str):
    """(key, rows as dictionaries) of each run of rows with one key."""
    own, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != own and held:
                yield own, held
                held = []
            own = row[key]
            held.append(row)
    if held:
        yield own, held


def _column(rows: list[dict], read=_unpack) -> list[np.ndarray]:
    """The arrays of all rows, joined."""
    return [np.concatenate(x) for x in zip(*(read(r["data"]) for r in rows), strict=True)]


def _mail(owner: int, bounds: list[tuple[int, int, int]], arrays: list[np.ndarray], file: str | None, sums: list[float]):
    """A row to each receiver (receiver, from, to) with its share of the arrays, and one without receiver for the driver."""
    names = _names(_MAIL)
    for to, s, e in bounds:
        yield _row(names, to=[to], sender=[owner], file=[None], sums=[None], data=[_pack(*(a[s:e] for a in arrays))])
    yield _row(names, to=[None], sender=[owner], file=[file], sums=[sums], data=[None])


class Root:
    """The root's totals after a sweep: customers and tables; the vocabulary's size and the discounts (restaurants', root's)."""

    def __init__(self, customers: float, tables: float, words: int, discounts: tuple[float, float]):
        self.customers, self.tables, self.words, self.discounts = customers, tables, words, discounts

    def base(self) -> float:
        return (STRENGTH + self.discounts[1] * self.tables) / (self.words + 1)

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discounts[1] * tables + self.base()) / (STRENGTH + self.customers)


def predictive(count, tables, rest, size: int, root: np.ndarray, discount: float) -> np.ndarray:
    """P(w | u) of pairs: their customers, tables and restaurants (of `size`), and the root's probability of their words."""
    left = (STRENGTH + discount * np.bincount(rest, tables, size)) / (STRENGTH + np.bincount(rest, count, size))
    return (count - discount * tables) / (STRENGTH + np.bincount(rest, count, size))[rest] + left[rest] * root


def pair_seeds(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) + word)


def reseat(count, tables, rest, size: int, root: np.ndarray, discount: float, seeds: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs after a sweep, given those before it."""
    out, seen = np.zeros(len(count)), np.flatnonzero(count)
    weight = (STRENGTH + discount * np.bincount(rest, tables, size))[rest[seen]] * root[seen]
    out[seen] = seat(count[seen], discount, weight, mix64(seeds[seen] + _U(sweep)))
    return out


def reseat_root(customers: np.ndarray, before: Root, word: np.ndarray, sweep: int) -> np.ndarray:
    return seat(customers, before.discounts[1], np.full(len(customers), before.base()), mix64(word + _U(0xABCDEF + sweep)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    spark = docs.sparkSession
    parts = partitions(spark)
    folder = scratch_path(spark, "lm-state")
    def dealt(rows: DataFrame, to: str, order: str) -> DataFrame:
        return rows.repartition(parts, to).sortWithinPartitions(to, order)

    def mailed(rows: DataFrame) -> DataFrame:
        return dealt(rows.where("to IS NOT NULL"), "to", "sender")

    def passed(rows: DataFrame, task, tag: str) -> tuple[DataFrame, dict[int, str], np.ndarray]:
        """Rows for the next receivers, the senders' files (a row a part), and the sums of their numbers."""
        out = stash(rows.mapInArrow(task, _MAIL), tag)
        told = out.where("to IS NULL AND sums IS NOT NULL").select("sender", "file", "sums").collect()
        spark._jvm.System.gc()  # else the shuffle's files stay until the driver happens to collect its garbage
        return out, {r["sender"]: r["file"] for r in told}, np.array([r["sums"] for r in told]).sum(axis=0) if told else np.zeros(6)

    def gather(batches):
        """A part's pairs: merges those of all blocks, and asks for its words."""
        for part, rows in _groups(batches, "part"):
            if part is None:
                yield _row(_names(_MAIL), to=[None] * len(rows), sender=[r["block"] for r in rows], file=[r["file"] for r in rows], sums=[None] * len(rows), data=[None] * len(rows))
                continue
            read = [_pairs(r["data"]) for r in rows]
            sizes = [len(x[0]) for x in read]
            before, word, count = (np.concatenate(x) for x in zip(*read, strict=True))
            del read
            _, at, where = np.unique(pair_seeds(before, word), return_index=True, return_inverse=True)
            total = np.bincount(where, count, len(at)).astype(np.int64)
            firsts, rest = np.unique(before[at], return_inverse=True)
            words, own = np.unique(word[at], return_inverse=True)
            target = (mix64(words + _U(0x5851F42D4C957F2D)) % _U(parts)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words, own, target = words[order], rank[own], target[order]
            cuts = [0, *(np.flatnonzero(np.diff(target)) + 1).tolist(), len(target)]
            bounds = [(int(target[s]), s, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            order = np.lexsort((own, rest))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rest, own, total, where = rest[order], own[order], total[order], rank[where]
            file = _save(folder, before=firsts, rest=rest, word=words, own=own, count=total, where=where, bounds=np.array(bounds), block=np.array([r["block"] for r in rows]), first=np.array([r["first"] for r in rows]), size=np.array(sizes))
            seen = np.bincount(own, total, len(words)).astype("<i8"), np.bincount(own, total > 0, len(words)).astype("<i8")
            yield from _mail(part, bounds, [words, *seen], file, [float((total == 1).sum()), float((total == 2).sum())])

    def meet(batches):
        """A part's words: the counts of all, with a table for each pair and one in the root."""
        for to, rows in _groups(batches, "to"):
            word, count, kinds = _column(rows)
            words, where = np.unique(word, return_inverse=True)
            total, customers = (np.bincount(where, x, len(words)).astype(np.int64) for x in (count, kinds))
            tables = np.minimum(customers, 1)
            ends = np.cumsum([0, *(len(_unpack(r["data"])[0]) for r in rows)]).tolist()
            bounds = [(r["sender"], s, e) for r, s, e in zip(rows, ends[:-1], ends[1:], strict=True)]
            file = _save(folder, word=words, where=where, bounds=np.array(bounds))
            sums = [float(x) for x in (total.sum(), (total > 0).sum(), customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())]
            yield from _mail(to, bounds, [x[where].astype("<i8") for x in (customers, tables, total)], file, sums)

    asked, states, found = passed(dealt(blocks(docs, parts, folder, id_col, text_col, block_tokens), "part", "block"), gather, "lm-words")
    one, two = found[:2]
    texts = {r["sender"]: r["file"] for r in asked.where("to IS NULL AND sums IS NULL").select("sender", "file").collect()}
    answers, roots, (seen, size, customers, tables, root_one, root_two) = passed(mailed(asked), meet, "lm-answers")
    discounts = tuple(float(np.clip(a / max(1.0, a + 2 * b), 0.05, 0.95)) for a, b in ((one, two), (root_one, root_two)))
    root, seen, size, moods = Root(customers, tables, int(size), discounts), int(seen), int(size), {}

    def follow(part: int, rows: list[dict], sweep: int, root: Root, moods: dict[int, str]):
        """A part's state, its tables after the sweep before, its root probabilities, and the predictive ones summed so far."""
        state = _load(states[part])
        mood = _load(moods[part]) if moods else {"tables": np.minimum(state["count"], 1), "total": None, "sum": np.zeros(1, np.float32)}
        answer = [x.astype(np.int64) for x in _column(rows)]
        total = answer[2] if sweep == 1 else mood["total"]
        under = root.probability(answer[0], answer[1])[state["own"]]
        tables, rest, n = mood["tables"].astype(np.float64), state["rest"], len(state["before"])
        added = mood["sum"]
        if sweep - 1 > BURN_IN:
            added = added + predictive(state["count"], tables, rest, n, under, root.discounts[0])
        return state, tables, rest, n, under, added, total

    for sweep in range(1, SWEEPS + 1):

        def reseat_part(batches, sweep=sweep, root=root, moods=moods):
            for part, rows in _groups(batches, "to"):
                state, tables, rest, n, under, added, total = follow(part, rows, sweep, root, moods)
                seeds = pair_seeds(state["before"][rest], state["word"][state["own"]])
                tables = reseat(state["count"], tables, rest, n, under, root.discounts[0], seeds, sweep)
                file = _save(folder, tables=tables.astype(np.int64), total=total, sum=added.astype(np.float32))
                yield from _mail(part, [tuple(x) for x in state["bounds"].tolist()], [np.bincount(state["own"], tables, len(state["word"])).astype("<i8")], file, [0.0])

        def reseat_words(batches, sweep=sweep, root=root):
            for to, rows in _groups(batches, "to"):
                state = _load(roots[to])
                customers = np.bincount(state["where"], _column(rows)[0], len(state["word"])).astype(np.int64)
                tables = reseat_root(customers, root, state["word"], sweep)
                yield from _mail(to, [tuple(x) for x in state["bounds"].tolist()], [x[state["where"]].astype("<i8") for x in (customers, tables)], None, [float(customers.sum()), float(tables.sum())])

        sums, latest, _ = passed(mailed(answers), reseat_part, "lm-tables")
        _drop(moods.values())
        moods = latest
        answers, _, (customers, tables, *_) = passed(mailed(sums), reseat_words, "lm-answers")
        root = Root(customers, tables, size, discounts)

    def answer(batches):
        """Of each block's pairs: log probability and the word's count."""
        for part, rows in _groups(batches, "to"):
            state, *_, added, total = follow(part, rows, SWEEPS + 1, root, moods)
            log_p, count, at = np.log10(added / (SWEEPS - BURN_IN)), total[state["own"]], 0
            for block, first, n in zip(state["block"].tolist(), state["first"].tolist(), state["size"].tolist(), strict=True):
                own = state["where"][at : at + n]
                at += n
                yield _row(["block", "first", "data"], block=[block], first=[first], data=[_pack(log_p[own], count[own])])

    together = dealt(mailed(answers).mapInArrow(answer, "block long, first long, data binary"), "block", "first")

    def look_up(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for block, rows in _groups(batches, "block"):
            log_p, count = _column(rows)
            own = _load(texts[block])
            token = own["token"]
            starts = np.cumsum(own["size"]) - own["size"]
            n = len(starts)
            base = np.log10((count + 0.5) / (seen + 0.5 * (size + 1)))
            sums = [np.add.reduceat(x[token], starts) for x in ((count > 0).astype(np.int64), base, log_p)]
            columns = [pa.array(own["id"], mask=own["none"]), pa.array(own["held"]), pa.array(own["size"]), pa.array(sums[0]), pa.array(np.full(n, seen)), pa.array(sums[1]), pa.array(sums[2])]
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            yield from (whole.slice(at, 10_000) for at in range(0, n, 10_000))

    out = together.mapInArrow(look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
