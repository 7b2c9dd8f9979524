"""Language-model scoring by a small Pitman-Yor model of a few contexts, its seating sampled by Gibbs. The query's model, with a restaurant for each word, is in `word_lm`.

Words are the dishes. Context restaurants, CONTEXTS of them, stand for the last short word (up to three letters a-z) before a word, by its hash; they
share one parent, the root restaurant, whose base is uniform over the training vocabulary and one unknown word. In a restaurant
with discount d and strength s, P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u), where c counts customers, t tables, and each table in a context is a
customer of the root. A sweep reseats the customers of every word in every restaurant given the other restaurants' totals and the parent's probability, as the
Chinese restaurant process seats them one by one (long queues in blocks that grow by a twentieth). The predictive probabilities of the sweeps after
BURN_IN are averaged.

Documents are read in blocks of about BLOCK_TOKENS tokens. A block sends each of its distinct words once, with its counts by context, so frequent words are
summed before they are shuffled; it gets back each word's training count and log probabilities (of the model itself, rounded to 32 bits), and scores its
documents by looking them up. Sweeps run on the
table of training words, dealt by word; they share only the restaurants' totals, two numbers a restaurant. Random numbers are a hash of (word, sweep,
restaurant, customer), so a lost task seats its words as before. Counts and statistics are of all training documents.

Defined cases: a null text is an empty one, whose only token is the end; a null id counts as an empty one when folds are dealt; words that training lacks get the unknown word's
share; repeated rows are scored each and count each; an empty table gives no rows; without training documents all words are unknown; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, stash

CONTEXTS = 16
SWEEPS, BURN_IN = 4, 2
STRENGTH = 1.0
BLOCK_TOKENS = 3_000_000
_END = 0x9E3779B97F4A7C15
_U = np.uint64


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _class(word: bytes) -> int:
    """The context that a word opens: 1 to CONTEXTS - 1 for a short word, else 0."""
    if len(word) <= 3 and word.isalpha() and word.isascii():
        return 1 + _word_hash(b"class " + word) % (CONTEXTS - 1)
    return 0


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Block:
    """Documents of one block: tokens as (word, context) pairs, and the block's distinct words."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.classes: list[int] = []
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id, text: bytes) -> None:
        index, words = self.index, text.lower().split()
        ids = np.fromiter((index.setdefault(w, len(index)) for w in [*words, b""]), np.int64, len(words) + 1)  # no word is empty: that is the end
        if len(index) > len(self.classes):
            self.classes += [_class(w) for w in _last(index, len(index) - len(self.classes))]
        kinds = np.array([self.classes[i] for i in ids.tolist()], np.int64)
        where = np.maximum.accumulate(np.where(kinds > 0, np.arange(len(kinds)), -1))
        before = np.concatenate([[-1], where[:-1]])
        self.pairs.append(ids * CONTEXTS + np.where(before >= 0, kinds[before], 0))
        self.docs.append((doc_id, held_out(doc_id), len(ids)))
        self.tokens += len(ids)

    def finish(self, block: int):
        """Rows of words and rows of documents."""
        sizes = np.array([d[2] for d in self.docs])
        train = np.repeat(np.array([not d[1] for d in self.docs]), sizes)
        pairs, where = np.unique(np.concatenate(self.pairs), return_inverse=True)
        counts = np.bincount(where, train, len(pairs)).astype("<u4")
        words = pairs // CONTEXTS
        first = np.flatnonzero(np.diff(words, prepend=-1))
        names = list(self.index)
        hashes = np.array([_word_hash(names[i]) if names[i] else _END for i in words[first].tolist()], _U)
        masks = np.bitwise_or.reduceat(1 << (pairs % CONTEXTS), first)
        offsets = np.append(first, len(pairs)).astype(np.int32) * 4
        packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(counts)])
        n = len(first)
        yield _batch(np.full(n, block, np.int64), hashes.view(np.int64), first, masks, packed, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()))
        ends = np.cumsum(sizes)
        own = [where[e - s : e].astype("<u4").tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        m = len(own)
        none = pa.nulls(m, pa.int64())
        yield _batch(np.full(m, block, np.int64), none, none, none, pa.nulls(m, pa.binary()), pa.array([d[0] for d in self.docs], pa.int64()), pa.array([d[1] for d in self.docs]), pa.array(own, pa.binary()))


def _last(index: dict, n: int) -> list[bytes]:
    from itertools import islice

    return list(islice(reversed(index), n))[::-1]


_NAMES = ["block", "word", "first", "mask", "counts", "id", "held", "tokens"]
_SCHEMA = "block long, word long, first long, mask long, counts binary, id long, held boolean, tokens binary"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_NAMES)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        from pyspark import TaskContext

        own, number = Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own.add(doc_id, data)
                if own.tokens >= block_tokens:
                    yield from own.finish(number)
                    own, number = Block(), number + 1
        if own.docs:
            yield from own.finish(number)

    return rows.mapInArrow(run, _SCHEMA)


def _expand(masks: np.ndarray, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, count) of each bit of the masks."""
    bits = (masks[:, None] >> np.arange(CONTEXTS)) & 1
    row, context = np.nonzero(bits)
    return row, context, np.frombuffer(b"".join(counts), "<u4").astype(np.int64)


def training_words(rows: DataFrame, parts: int) -> DataFrame:
    """word, mask, counts: one row a training word. Rows of a word arrive next to each other, one a block."""
    dealt = rows.where("word IS NOT NULL").select("word", "mask", "counts").repartition(parts, "word").sortWithinPartitions("word")

    def run(batches):
        held = None  # the last word of the batch before, summed
        for batch in batches:
            if not batch.num_rows:
                continue
            row, context, count = _expand(batch.column("mask").to_numpy(), batch.column("counts").to_pylist())
            key = batch.column("word").to_numpy()[row]
            if held is not None:
                key, context, count = (np.concatenate([a, b]) for a, b in zip(held, (key, context, count), strict=True))
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            cell, where = np.unique(group * CONTEXTS + context, return_inverse=True)
            total = np.bincount(where, count, len(cell)).astype(np.int64)
            first_of = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            word, ctx, which = key[first_of][cell // CONTEXTS], cell % CONTEXTS, cell // CONTEXTS
            keep = which < which[-1]
            held = word[~keep], ctx[~keep], total[~keep]
            yield _words(word[keep], ctx[keep], total[keep])
        if held is not None:
            yield _words(*held)

    return dealt.mapInArrow(run, "word long, mask long, counts binary")


def _words(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    seen = count > 0
    word, context, count = word[seen], context[seen], count[seen]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    masks = np.bitwise_or.reduceat(1 << context, first) if len(first) else np.zeros(0, np.int64)
    offsets = np.append(first, len(word)).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(count.astype("<u4"))])
    return pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(masks.astype(np.int64)), packed], names=["word", "mask", "counts"])


class Totals:
    """Restaurants' totals: customers and tables, contexts first and the root last; and the vocabulary's size and discounts."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, words: int, discounts: tuple[float, float]):
        self.customers, self.tables, self.words, self.discounts = customers, tables, words, discounts

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words under the root, from their customers and tables there."""
        d = self.discounts[1]
        return (customers - d * tables + (STRENGTH + d * self.tables[-1]) / (self.words + 1)) / (STRENGTH + self.customers[-1])

    def backoff(self) -> np.ndarray:
        """What each context leaves to its parent."""
        return (STRENGTH + self.discounts[0] * self.tables[:-1]) / (STRENGTH + self.customers[:-1])


def seat(customers: np.ndarray, discount: float, weight: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Tables at which `customers` of one dish sit, seated one by one: a new table has the odds weight to (seated - discount * tables)."""
    tables = np.minimum(customers, 1).astype(np.float64)
    order = np.argsort(-customers, kind="stable")
    n, w, s, t = customers[order], weight[order], seeds[order], tables[order]
    seated, step = 1, 0
    while len(n) and n[0] > seated:
        live = int(np.searchsorted(-n, -seated, "left"))
        block = np.minimum(n[:live] - seated, max(1, seated // 20))
        u = (mix64(s[:live] + _U(step * 0xD1342543DE82EF95 & (2**64 - 1))) >> _U(11)).astype(np.float64) / 2.0**53
        new = w[:live] / (w[:live] + np.maximum(seated - discount * t[:live], 1e-9))
        t[:live] += np.where(block == 1, u < new, np.floor(block * new + u))
        seated += max(1, seated // 20)
        step += 1
    tables[order] = np.minimum(t, n)
    return tables


def _reseat(word: np.ndarray, row: np.ndarray, context: np.ndarray, count: np.ndarray, history: list[Totals]):
    """Replay the sweeps: after each, (tables by word and context, root customers, root tables) of the batch's words."""
    n = len(word)
    total = history[0]
    root = np.full(n, 1.0 / (total.words + 1))
    seeds = mix64(word[row].view(_U) ^ (context.astype(_U) * _U(0x9E3779B97F4A7C15)))
    for k, total in enumerate(history):
        d0, d1 = total.discounts
        weight = (STRENGTH + d0 * total.tables[:-1])[context] * root[row]
        tables = seat(count, d0, weight, mix64(seeds + _U(k + 1)))
        customers = np.bincount(row, tables, n)
        base = np.full(n, (STRENGTH + d1 * total.tables[-1]) / (total.words + 1))
        root_tables = seat(customers.astype(np.int64), d1, base, mix64(word.view(_U) + _U(0xABCDEF + k)))
        yield tables, customers, root_tables
        if k + 1 < len(history):
            root = history[k + 1].root(customers, root_tables)


def sample(words: DataFrame) -> list[Totals]:
    """The totals before each sweep and after the last. Each pass returns one row a task."""

    def count(batches):
        for batch in batches:
            row, context, n = _expand(batch.column("mask").to_numpy(), batch.column("counts").to_pylist())
            once, twice = np.bincount(row, n, batch.num_rows), n
            stats = [batch.num_rows, (twice == 1).sum(), (twice == 2).sum(), (np.bincount(row, minlength=batch.num_rows) == 1).sum(), (np.bincount(row, minlength=batch.num_rows) == 2).sum(), int(once.sum())]
            yield pa.RecordBatch.from_pydict({"sums": pa.array([[float(x) for x in [*np.bincount(context, n, CONTEXTS), *np.bincount(context, minlength=CONTEXTS), *stats]]])})

    def summed(frame: DataFrame) -> np.ndarray:
        rows = frame.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([r["x"] for r in sorted(rows)]) if rows else np.zeros(0)

    first = summed(words.mapInArrow(count, "sums array<double>"))
    if not len(first):
        first = np.zeros(2 * CONTEXTS + 6)
    customers, kinds, (size, one, two, root_one, root_two, _) = first[:CONTEXTS], first[CONTEXTS : 2 * CONTEXTS], first[2 * CONTEXTS :]
    discounts = tuple(float(np.clip(a / max(1.0, a + 2 * b), 0.05, 0.95)) for a, b in ((one, two), (root_one, root_two)))
    history = [Totals(np.append(customers, kinds.sum()), np.append(kinds, size), int(size), discounts)]
    for _ in range(SWEEPS):
        seen = list(history)

        def sweep(batches, seen=seen):
            for batch in batches:
                row, context, n = _expand(batch.column("mask").to_numpy(), batch.column("counts").to_pylist())
                *_, (tables, root_customers, root_tables) = _reseat(batch.column("word").to_numpy(), row, context, n, seen)
                yield pa.RecordBatch.from_pydict({"sums": pa.array([[float(x) for x in [*np.bincount(context, tables, CONTEXTS), root_customers.sum(), root_tables.sum()]]])})

        sums = summed(words.mapInArrow(sweep, "sums array<double>")) if size else np.zeros(CONTEXTS + 2)
        history.append(Totals(np.append(customers, sums[CONTEXTS]), np.append(sums[:CONTEXTS], sums[CONTEXTS + 1]), int(size), discounts))
    return history


def _probabilities(word, row, context, count, history) -> tuple[np.ndarray, np.ndarray]:
    """P(word | context) at the given cells, averaged over the sweeps kept; and P(word) under the root, a column for each of these sweeps."""
    cells, roots = np.zeros(len(row)), []
    for k, (tables, customers, root_tables) in enumerate(_reseat(word, row, context, count, history[:-1])):
        if k < BURN_IN:
            continue
        after = history[k + 1]
        root, left = after.root(customers, root_tables), after.backoff()
        roots.append(root)
        cells += (count - after.discounts[0] * tables) / (STRENGTH + after.customers[:-1])[context] + root[row] * left[context]
    return cells / len(roots), np.stack(roots, axis=1)


def _unseen(roots: np.ndarray, context: np.ndarray, left: np.ndarray) -> np.ndarray:
    """P(word | context) where the context has not served the word: what each sweep's context leaves to the root, averaged over the sweeps."""
    return (roots * left.T[context]).mean(axis=1)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    parts = partitions(docs.sparkSession)
    rows = stash(blocks(docs, id_col, text_col, block_tokens), "lm-blocks")
    words = stash(training_words(rows, parts), "lm-words")
    history = sample(words)
    size, seen = history[0].words, int(history[0].customers[:-1].sum())
    left = np.stack([after.backoff() for after in history[BURN_IN + 1 :]])
    nobody = np.array([after.root(np.zeros(1), np.zeros(1))[0] for after in history[BURN_IN + 1 :]])  # the unknown word's roots
    kept = len(nobody)

    def model(batches):
        for batch in batches:
            word = batch.column("word").to_numpy()
            row, context, count = _expand(batch.column("mask").to_numpy(), batch.column("counts").to_pylist())
            cells, roots = _probabilities(word, row, context, count, history)
            under = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer((np.arange(len(word) + 1) * 8 * kept).astype(np.int32)), pa.py_buffer(roots.astype("<f8").tobytes())])
            first = np.searchsorted(row, np.arange(len(word) + 1)).astype(np.int32) * 8
            packed = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(first), pa.py_buffer(cells.astype("<f8"))])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.bincount(row, count, len(word)).astype(np.int64)), under, batch.column("mask"), packed], names=["word", "c", "roots", "own", "cells"])

    known = words.mapInArrow(model, "word long, c long, roots binary, own long, cells binary")
    wanted = rows.where("word IS NOT NULL").select("block", "word", "first", "mask")
    stranger = nobody.astype("<f8").tobytes()

    def answer(batches):
        """The asked words of a block, many in one row: first pair, mask, count, and a log probability for each pair."""
        held, rows_held = [], 0

        def packed():
            block, first, mask, c, own = (np.concatenate([h[i] for h in held]) for i in range(5))
            roots = np.frombuffer(b"".join(x or stranger for h in held for x in h[5]), "<f8").reshape(-1, kept)
            cells = np.frombuffer(b"".join(x for h in held for x in h[6]), "<f8")
            bits = (mask[:, None] >> np.arange(CONTEXTS)) & 1
            row, context = np.nonzero(bits)
            own_bits = (own[:, None] >> np.arange(CONTEXTS)) & 1
            kinds = own_bits.sum(axis=1)
            place = (np.cumsum(kinds) - kinds)[row] + (np.cumsum(own_bits, axis=1) - 1)[row, context]
            have = own_bits[row, context] == 1
            p = _unseen(roots[row], context, left)
            p[have] = cells[place[have]]
            log_p = np.log10(p).astype("<f4")
            ends = np.append(np.searchsorted(row, np.arange(len(block))), len(row))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for own_rows in np.split(order, cuts):
                pairs = _ranges(ends[own_rows], ends[own_rows + 1])
                yield int(block[own_rows[0]]), len(own_rows).to_bytes(8, "little") + first[own_rows].astype("<u4").tobytes() + mask[own_rows].astype("<u4").tobytes() + c[own_rows].astype("<u4").tobytes() + log_p[pairs].tobytes()

        def emit():
            out = list(packed())
            n = len(out)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([False] * n), pa.array([x[1] for x in out], pa.binary())], names=["block", "id", "held", "is_doc", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*(batch.column(x).to_numpy() for x in ("block", "first", "mask")), batch.column("c").fill_null(0).to_numpy(), batch.column("own").fill_null(0).to_numpy(), batch.column("roots").to_pylist(), [x or b"" for x in batch.column("cells").to_pylist()]))
            rows_held += batch.num_rows
            if rows_held >= 200_000:
                yield emit()
                held, rows_held = [], 0
        if held:
            yield emit()

    wide = "block long, id long, held boolean, is_doc boolean, payload binary"
    answered = wanted.join(known, "word", "left").select("block", "first", "mask", "c", "roots", "own", "cells").mapInArrow(answer, wide)
    texts = rows.where("word IS NULL").select("block", "id", "held", F.lit(True).alias("is_doc"), F.col("tokens").alias("payload"))
    together = answered.union(texts).repartition(parts, "block").sortWithinPartitions("block", "is_doc")

    def look_up(batches):
        block, held, tables = None, [], None

        def table():
            log_p, log_base, is_known = [], [], []
            at = []
            for data in held:
                n = int.from_bytes(data[:8], "little")
                first, mask, c = (np.frombuffer(data, "<u4", n, 8 + 4 * n * i).astype(np.int64) for i in range(3))
                bits = (mask[:, None] >> np.arange(CONTEXTS)) & 1
                row, context = np.nonzero(bits)
                at.append(first[row] + (np.cumsum(bits, axis=1) - 1)[row, context])
                log_p.append(np.frombuffer(data, "<f4", len(row), 8 + 12 * n))
                log_base.append(np.log10((c[row] + 0.5) / (seen + 0.5 * (size + 1))))
                is_known.append(c[row] > 0)
            at = np.concatenate(at)
            out = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), bool)
            for target, parts_ in zip(out, (log_p, log_base, is_known), strict=True):
                target[at] = np.concatenate(parts_)
            return out

        for batch in batches:
            ids = batch.column("block").to_numpy()
            is_doc = batch.column("is_doc").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(is_doc.astype(int)) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if ids[s] != block:
                    block, held, tables = ids[s], [], None
                if not is_doc[s]:
                    held += part.column("payload").to_pylist()
                    continue
                if tables is None:
                    tables, held = table(), []
                log_p, log_base, is_known = tables
                tokens = [np.frombuffer(t, "<u4") for t in part.column("payload").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held"), pa.array([len(t) for t in tokens], pa.int64()), pa.array([int(is_known[t].sum()) for t in tokens], pa.int64()), pa.array([seen] * len(tokens), pa.int64()), pa.array([float(log_base[t].sum()) for t in tokens]), pa.array([float(log_p[t].sum()) for t in tokens])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = together.mapInArrow(look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start..end of each pair, joined."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
