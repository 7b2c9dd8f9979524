"""Removal of repeated byte strings, by blockwise suffix sorting with a difference cover.

Every byte covered by a LENGTH-byte string that also starts anywhere else, in the same text or another, is removed. Strings are judged on
the input. Matches never cross texts.

Suffixes are dealt to buckets by the smallest hash of the K-byte strings in their first LENGTH bytes, so suffixes that agree on LENGTH bytes
share a bucket, and neighbouring suffixes mostly do too: a bucket gets runs of suffixes, each as one string. Buckets
whose hash occurs once in the corpus hold no repeat and are left out; they are counted with map-side sums. Within a task, buckets
are sorted a block of bounded size at a time: suffixes are ordered by their first V bytes, and ties are resolved by
the ranks of suffixes at a difference cover modulo V, computed before by doubling; for any two suffixes there is an offset below V at which
both have a rank, so a tie of any length costs one look-up. Neighbours in the order that agree on LENGTH bytes (a 64-bit hash
of them first, then the bytes themselves) are repeats.

Equal runs are collapsed before they are shuffled, and a bucket with over HOT_RUNS different runs (a passage met in a great many contexts) is not
sorted in one task: its runs are cut into pieces, dealt again by the bytes that all strings of a piece share, level by level down to single strings, which
agree if they are equal. No task gets a group without a bound.

Defined cases: a null text is an empty one; texts shorter than LENGTH lose nothing; rows repeated as a whole are occurrences
of each other's strings; a null id is an id like any other; an empty table gives no rows; other columns are carried by `strip_rows`, whatever their names. A
removal may cut through a character: `strip_rows` then drops the bytes left of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, mix64, partitions, stash

LENGTH = 400
K = 16
V = 13
#: A perfect difference set modulo 13: every residue is a difference of two of them.
COVER = (0, 1, 3, 9)
BLOCK_BYTES = 2 << 20
HOT_RUNS = 2_000
#: So many runs at most are broadcast: those with that share of all places or more.
MOST_FREQUENT = 1024
#: Starts in the pieces that hot buckets' runs are cut into, level by level; pieces of one start in one bucket are all equal.
STEPS = (32, 4, 1, 1)
_CHUNK = 1 << 25
_MASK = np.uint64((1 << 26) - 1)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position, as little-endian uint64; `data` is padded by the caller."""
    return np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, bucket, how far the smallest string lies behind the first start) of each run of neighbouring suffixes with the same smallest k-byte string.

    Only suffixes with at least `length` bytes are dealt. Which string is smallest depends on the suffix's first `length` bytes alone: the least truncated hash, then
    the leftmost.
    """
    firsts, counts, buckets, leads = [], [], [], []
    for at in range(0, len(data) - length + 1, _CHUNK):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, _CHUNK + length - 1), at)
        padded = np.zeros(len(part) + 16, np.uint8)
        padded[: len(part)] = part
        words = _words(padded)
        n = len(part) - k + 1
        if k == 16:
            hashes = mix64(words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(words[8 : n + 8]))
        else:
            hashes = mix64(words[:n] & np.uint64((1 << (8 * k)) - 1))
        least = _sliding_min((hashes & ~_MASK) | np.arange(n, dtype=np.uint64), length - k + 1)
        anchor = (least & _MASK).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        firsts.append(first + at)
        counts.append(np.diff(first, append=len(anchor)))
        buckets.append(hashes[anchor[first]])
        leads.append(anchor[first] - first)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(buckets), np.concatenate(leads)


def cover_ranks(text: np.ndarray, v: int = V, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """For each position in the cover (others hold 0), the rank of its suffix among those of the cover.

    `text` ends in at least 2 v zeros. Ranks by v bytes come from comparing; doubling then joins the ranks of two positions a multiple of v
    apart, for suffixes that still share a rank, until none do: the order is strict, so look-ups at different offsets agree.
    """
    inside = np.zeros(v, bool)
    inside[[c % v for c in cover]] = True
    limit = len(text) - 2 * v
    at = np.flatnonzero(inside[np.arange(limit) % v])
    words = _words(text)
    keys = [words[at + o].byteswap() for o in [*range(0, v - 7, 8), v - 8]]
    order = np.lexsort(keys[::-1])
    ranks = np.zeros(len(text) + 1, np.int64)
    own, new = at[order], np.zeros(len(at), bool)
    new[:1] = True
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    index = np.arange(len(own))
    ranks[own] = np.maximum.accumulate(np.where(new, index, 0)) + 1
    reach = v
    while True:
        alone = new & np.append(new[1:], True)
        own = own[~alone]
        if not len(own):
            return ranks
        near, far = ranks[own], own + reach
        far = np.where(far < limit, ranks[np.minimum(far, limit)], -far)  # beyond the end: the shorter suffix is the smaller
        sub = np.lexsort((far, near))
        own, near, far = own[sub], near[sub], far[sub]
        index = np.arange(len(own))
        group = np.ones(len(own), bool)
        group[1:] = near[1:] != near[:-1]
        new = group.copy()
        new[1:] |= far[1:] != far[:-1]
        ranks[own] = near + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        reach *= 2


#: The least offset that leads each residue modulo V into the cover.
_SHIFT = np.array([next(d for d in range(V) if (r + d) % V in COVER) for r in range(V)])


def suffix_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`starts` by their suffixes' first V bytes, then by residue modulo V, then by the rest: suffixes that agree on any length of V or more are
    neighbours if they have the same residue. `text` ends in at least 4 V zeros.
    """
    ranks = cover_ranks(text)
    words = _words(text)
    order = np.argsort(words[starts].byteswap(), kind="stable")
    starts = starts[order]
    key = words[starts]
    tied = np.zeros(len(starts) + 1, bool)  # tied[i]: start i agrees with start i - 1 so far
    tied[1:-1] = key[1:] == key[:-1]
    for offset in [*range(8, V - 7, 8), V - 8]:
        member = tied[:-1] | tied[1:]
        own = np.flatnonzero(member)
        if not len(own):
            return starts
        group = np.cumsum(~tied[:-1])[own]
        key = words[starts[own] + offset].byteswap()
        sub = np.lexsort((key, group))
        starts[own] = starts[own][sub]
        key = key[sub]
        same = np.zeros(len(own), bool)
        same[1:] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        tied[own] = same
    # What still agrees is ordered by residue modulo V, and within one by the ranks at the first offset that leads into the cover.
    own = np.flatnonzero(tied[:-1] | tied[1:])
    if len(own):
        group = np.cumsum(~tied[:-1])[own]
        residue = starts[own] % V
        starts[own] = starts[own][np.lexsort((ranks[starts[own] + _SHIFT[residue]], residue, group))]
    return starts


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hashes, over bytes replaced by random numbers, of the `length` bytes at each position that has so many."""
    power = np.full(len(text), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(len(text), pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[text] * power)])
    return (total[length:] - total[:-length]) * inverse[: len(text) - length + 1]


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of the pairs of starts agree on all `length` bytes.

    Pairs that follow each other (a + 1 and b + 1 after a and b) share all bytes but one at each end, so the first pair of such a row is compared in full and
    the others by their last byte; a row in which any of these differs is compared in full.
    """
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)

    def whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = np.ones(len(x), bool)
        for offset in range(length):
            at = np.flatnonzero(same) if offset % 64 == 0 else at
            same[at] &= text[x[at] + offset] == text[y[at] + offset]
        return same

    same = np.ones(len(a), bool)
    same[first] = whole(a[first], b[first])
    same[~first] = text[a[~first] + length - 1] == text[b[~first] + length - 1]
    row = np.cumsum(first) - 1
    doubtful = np.flatnonzero((np.bincount(row, weights=~same, minlength=1) > 0)[row]) if len(a) else np.zeros(0, np.int64)
    same[doubtful] = whole(a[doubtful], b[doubtful])
    out = np.empty(len(a), bool)
    out[order] = same
    return out


def repeated_starts(strings: list[bytes], starts: list[int], leads: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its first `starts` suffixes agree on `length` bytes with another suffix of the block.

    `leads` are the places of the strings' smallest k-byte strings. Padding puts them all at multiples of V, so that suffixes that agree have the same residue.
    """
    parts, origin, at = [], [], 0
    for s, lead in zip(strings, leads, strict=True):
        pad = -(at + lead) % V
        parts += [bytes(pad), s]
        origin.append(at + pad)
        at += pad + len(s)
    text = np.frombuffer(b"".join(parts) + bytes(length + 4 * V + 16), np.uint8)
    origin = np.array(origin)
    counts = np.array(starts)
    total = int(counts.sum())
    base = np.cumsum(counts) - counts
    at = np.repeat(origin - base, counts) + np.arange(total)
    order = suffix_order(text, at.copy())
    a, b = order[:-1], order[1:]
    marks = _window_hashes(text, length)
    alive = np.flatnonzero(marks[a] == marks[b])
    alive = alive[_equal(text, a[alive], b[alive], length)]
    found = np.zeros(len(text), bool)
    found[a[alive]] = True
    found[b[alive]] = True
    return [found[o : o + n] for o, n in zip(origin.tolist(), counts.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> bytes:
    """Maximal runs of true as pairs (start, end), int32."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges.astype("<i4").tobytes()


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Maximal byte spans covered by the strings that start in [starts, ends): rows (from, to)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    start, reach = starts[order], np.maximum.accumulate(ends[order] + length - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], axis=1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of id and text; rows repeated as a whole share it, and share their result."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row_id = F.col(f"`{id_col}`")
    return docs.select(F.xxhash64(row_id, text).alias("k1"), F.xxhash64(F.lit("key"), text, row_id).alias("k2"), text.cast("binary").alias("data"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_runs: int = HOT_RUNS, k: int = K) -> DataFrame:
    """k1, k2 (see `_keyed`), starts, ends: the ranges of starts of repeated strings in each text that has any."""
    keyed = _keyed(docs, id_col, text_col).select("k1", "k2", "data")

    def deal(batches):
        for batch in batches:
            rows = []
            for k1, k2, data in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if len(data) >= length:
                    bucket, n = np.unique(runs(data, length, k)[2], return_counts=True)
                    rows.append((k1, k2, bucket.view(np.int64), n))
            if rows:
                size = [len(r[2]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r[0] for r in rows], size)), pa.array(np.repeat([r[1] for r in rows], size)), pa.array(np.concatenate([r[2] for r in rows])), pa.array(np.concatenate([r[3] for r in rows]))],
                    names=["k1", "k2", "bucket", "n"],
                )

    dealt = stash(keyed.mapInArrow(deal, "k1 long, k2 long, bucket long, n long"), "suffix-buckets")
    shared = dealt.groupBy("bucket").agg(F.sum("n").alias("total")).where("total > 1").select("bucket")
    wanted = dealt.select("k1", "k2", "bucket").join(shared, "bucket").groupBy("k1", "k2").agg(F.collect_set("bucket").alias("buckets"))

    def cut(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, data, own in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("data").to_pylist(), batch.column("buckets"), strict=True):
                first, count, bucket, lead = runs(data, length, k)
                bucket = bucket.view(np.int64)
                for i in np.flatnonzero(np.isin(bucket, own.values.to_numpy())).tolist():
                    f, n = int(first[i]), int(count[i])
                    run = data[f : f + n + length - 1]
                    digest = hashlib.blake2b(run, digest_size=16).digest()
                    out.append((k1, k2, f, n, int(lead[i]), int(bucket[i]), digest, None if digest in seen else run))
                    seen.add(digest)
                if len(out) > 20_000:
                    yield _cut_batch(out)
                    out = []
            if out:
                yield _cut_batch(out)

    cuts = stash(keyed.join(wanted, ["k1", "k2"]).mapInArrow(cut, "k1 long, k2 long, first long, n int, lead int, bucket long, digest binary, run binary"), "suffix-runs")
    # Equal runs within a task were sent once; `bucket` and digest tell how many different ones remain, and how often each occurs.
    times = stash(cuts.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "suffix-times")
    level = cuts.where("run IS NOT NULL").select("bucket", "digest", "n", "lead", "run")
    partial, root = None, None  # root: a piece's digest -> the run that it is cut from, and where
    parts = partitions(docs.sparkSession)
    for step in STEPS:
        hot = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.approx_count_distinct("digest").alias("d")).where(F.col("d") > hot_runs).select("bucket", F.lit(True).alias("hot"))
        hot = stash(hot, "hot-buckets")
        dealt = level.join(hot, "bucket", "left")
        found = dealt.where("hot IS NULL").select("bucket", "digest", "n", "lead", "run").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks(length), "digest binary, ranges binary")
        if root is not None:
            whole_pieces = root.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")).where("c > 1").select("digest", "n")
            found = found.unionByName(whole_pieces.mapInArrow(_all_starts, "digest binary, ranges binary"))
            found = found.join(root.select("digest", "run_digest", "offset"), "digest").select(F.col("run_digest").alias("digest"), "offset", "ranges")
        else:
            found = found.select("digest", F.lit(0).alias("offset"), "ranges")
        partial = found if partial is None else partial.unionByName(found)
        if hot.isEmpty():
            break
        pieces = stash(dealt.where("hot").select("digest", "n", "lead", "run").dropDuplicates(["digest"]).mapInArrow(_cut_pieces(step, length), "parent binary, offset int, bucket long, digest binary, n int, lead int, run binary"), "suffix-pieces")
        above = root
        root = pieces.select("digest", "n", F.col("parent").alias("run_digest"), "offset")
        if above is not None:
            up = above.select(F.col("digest").alias("run_digest"), F.col("run_digest").alias("_top"), F.col("offset").alias("_more"))
            root = root.join(up, "run_digest").select("digest", "n", F.col("_top").alias("run_digest"), (F.col("offset") + F.col("_more")).alias("offset"))
        level = pieces.where("run IS NOT NULL").select("bucket", "digest", "n", "lead", "run")
    # A run that occurs twice as a whole is repeated at all its starts.
    whole = times.select("digest", F.lit(True).alias("whole"))
    places = cuts.select("k1", "k2", "first", "n", "digest")
    # All that is known of a run in one row, so that its places meet it in one join, whose hot runs can be split.
    known = whole.select("digest", "whole", F.lit(None).cast("struct<offset:int,ranges:binary>").alias("part")).unionByName(partial.select("digest", F.lit(None).cast("boolean").alias("whole"), F.struct(F.col("offset").cast("int").alias("offset"), "ranges").alias("part")))
    known = known.groupBy("digest").agg(F.max("whole").alias("whole"), F.collect_set("part").alias("parts"))
    known = known.withColumn("parts", F.when(F.col("whole"), F.array(F.lit(None).cast("struct<offset:int,ranges:binary>"))).otherwise(F.col("parts")))
    # Of the places, at most MOST_FREQUENT runs can each hold that share: they repeat as a whole, and are told apart by broadcast, so no key of the join is hot.
    least = max(2, -(-cuts.count() // MOST_FREQUENT))
    frequent = F.broadcast(stash(times.where(F.col("times") >= least).select("digest"), "suffix-frequent"))
    met = places.join(frequent, "digest", "left_anti").join(known, "digest").select("k1", "k2", "first", "n", "whole", F.explode("parts").alias("part"))
    spans = met.select("k1", "k2", "first", "n", "whole", F.col("part.offset").alias("offset"), F.col("part.ranges").alias("ranges"))
    often = places.join(frequent, "digest").select("k1", "k2", "first", "n", F.lit(True).alias("whole"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("binary").alias("ranges"))
    spans = spans.unionByName(often)
    at = F.when(F.col("whole"), F.col("first")).otherwise(F.col("first") + F.col("offset"))
    return spans.select("k1", "k2", F.struct(at.alias("first"), F.when(F.col("whole"), F.col("n")).alias("n"), F.when(F.col("whole").isNull(), F.col("ranges")).alias("ranges")).alias("span")).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _sort_blocks(length: int):
    """Buckets come next to each other; a block takes whole buckets until it has BLOCK_BYTES."""

    def finish(block: dict) -> pa.RecordBatch | None:
        flags = repeated_starts(*(list(x) for x in zip(*block.values(), strict=True)), length)
        rows = [(d, _ranges(f)) for d, f in zip(block, flags, strict=True) if f.any()]
        if rows:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["digest", "ranges"])
        return None

    def run(batches):
        block: dict[bytes, tuple[bytes, int, int]] = {}
        size, last = 0, None
        for batch in batches:
            for bucket, digest, n, lead, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "n", "lead", "run")), strict=True):
                if bucket != last and size > BLOCK_BYTES:
                    if (out := finish(block)) is not None:
                        yield out
                    block, size = {}, 0
                last = bucket
                if digest not in block:
                    block[digest] = text, n, lead
                    size += len(text)
        if block and (out := finish(block)) is not None:
            yield out

    return run


def _all_starts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([np.array([0, n], "<i4").tobytes() for n in batch.column("n").to_pylist()], pa.binary())], names=["digest", "ranges"])


def _cut_pieces(step: int, length: int):
    """Cut runs into pieces of up to `step` starts at fixed distances before the smallest string. A piece's bucket is a hash of the bytes that all strings
    starting in it share, so strings that agree stay together, and runs that share less than that are parted.
    """

    def run(batches):
        import xxhash

        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for parent, n, lead, text in zip(*(part.column(c).to_pylist() for c in ("digest", "n", "lead", "run")), strict=True):
                    start = 0
                    while start < n:
                        kind = (lead - start) // step
                        end = min(n, lead - kind * step + 1)
                        core = text[lead - kind * step : lead - kind * step - step + 1 + length]
                        piece = text[start : end + length - 1]
                        digest = hashlib.blake2b(piece + bytes([step]) + (lead - start).to_bytes(4, "little", signed=True), digest_size=16).digest()
                        bucket = xxhash.xxh3_64_intdigest(core, seed=(kind * 64 + step) & (2**64 - 1))
                        out.append((parent, start, bucket - (1 << 63), digest, end - start, lead - start, None if digest in seen else piece))
                        seen.add(digest)
                        start = end
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["parent", "offset", "bucket", "digest", "n", "lead", "run"])

    return run


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["k1", "k2", "first", "n", "lead", "bucket", "digest", "run"])


def _byte_spans(spans, length: int) -> np.ndarray:
    """Covered bytes of one text, from its repeated starts."""
    starts, ends = [], []
    for s in spans or []:
        if s["n"] is not None:
            starts.append(s["first"])
            ends.append(s["first"] + s["n"])
        else:
            pairs = np.frombuffer(s["ranges"], "<i4").astype(np.int64) + s["first"]
            starts += pairs[0::2].tolist()
            ends += pairs[1::2].tolist()
    return covered(np.array(starts, np.int64), np.array(ends, np.int64), length)


def _removed(docs: DataFrame, id_col: str, text_col: str, length: int, hot_runs: int, k: int = K) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, length, hot_runs, k)
    return _keyed(docs, id_col, text_col).join(stash(spans, "suffix-spans"), ["k1", "k2"], "left").select("rest", "data", "spans")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_runs: int = HOT_RUNS, k: int = K) -> DataFrame:
    """One row a text: its id, n_bytes, spans (removed byte ranges, from and to), kept (the other bytes)."""
    rows = _removed(docs, id_col, text_col, length, hot_runs, k).select(F.col(f"rest.`{id_col}`").alias(id_col), "data", "spans")
    schema = T.StructType([rows.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            data = batch.column("data").to_pylist()
            found = [_byte_spans(s, length) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(d) for d in data], pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.list_(pa.int64()))), pa.array([_without(d, f) for d, f in zip(data, found, strict=True)], pa.binary())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def _without(data: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return data
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def strip_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_runs: int = HOT_RUNS) -> DataFrame:
    """All rows and columns of `docs`, the text without its repeated strings; a null text becomes empty."""
    rows = _removed(docs, id_col, text_col, length, hot_runs)

    def run(batches):
        for batch in batches:
            kept = [_without(d, _byte_spans(s, length)).decode("utf-8", "ignore") for d, s in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(kept, pa.string())], names=["rest", "kept"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["rest"], T.StructField("kept", T.StringType())]))
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digests, and the kept bytes as text: a cut may fall inside a character, and what is left of that one reads as U+FFFD."""
    out = remove(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
