"""Best-fit packing of documents into sequences of several permitted lengths.

Documents become pieces of at most the largest length; pieces are dealt to shards by a hash of document and piece number, so that
no document, source or group can crowd a shard, and each shard is packed on its own. A shard takes its pieces in
descending order. A piece goes to the open bin with the least room that still holds it. If none does, a bin is opened at the
capacity with the least cost per token it is expected to hold, judged on the pieces still to come, all permitted lengths being compared.
At the end each bin is downsized to the smallest permitted length that holds its contents.

Only lengths are shuffled, never texts. Shards hold SHARD_PIECES pieces on average (the pieces are counted first), whatever the texts' lengths; more
input makes more shards. The loss from packing shards apart is at most the few unfilled bins at the end of each.

Defined cases: a null or empty text has one token, the end; a null id is packed like any other; repeated rows are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, documents

LENGTHS = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000
#: What a sequence costs besides its positions, in positions; and the weight of the quadratic part.
OVERHEAD, QUADRATIC = 16.0, 1 / 65536


def cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    """Of a sequence of this length, in positions: linear work, attention's quadratic work and a fixed part."""
    return capacity + quadratic * capacity * capacity + overhead


def pack(sizes: list[int], capacities: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) of each size, in the order given; sizes are 1 to the largest capacity.

    Ties are settled by order: equal sizes in the order given, equal rooms by the lowest bin number.
    """
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ascending = sorted(sizes)
    prefix = [0]
    for s in ascending:
        prefix.append(prefix[-1] + s)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins_by_room: dict[int, list[int]] = {}
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)

    def shelve(room: int, b: int) -> None:
        if room:
            if room not in bins_by_room:
                bins_by_room[room] = []
                insort(rooms, room)
            insort(bins_by_room[room], b)

    for done, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = bins_by_room[room]
            b = own.pop(0)
            if not own:
                del bins_by_room[room]
                rooms.pop(at)
        else:
            left = len(sizes) - done - 1  # these are ascending[:left]
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / _expected(size, c, ascending, prefix, left), c))
            b = len(used)
            used.append(0)
        placed[i] = (b, used[b])
        used[b] += size
        shelve(room - size, b)
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return [(b, offset, final[b]) for b, offset in placed]


def _expected(size: int, capacity: int, ascending: list[int], prefix: list[int], left: int) -> int:
    """Tokens that a bin opened for `size` holds at the end: the largest fitting of the pieces left, again and again."""
    held, top = size, left
    while held < capacity:
        top = bisect_left(ascending, capacity - held + 1, 0, top)
        if not top:
            break
        biggest = ascending[top - 1]
        first = bisect_left(ascending, biggest, 0, top)
        n = min(top - first, (capacity - held) // biggest)
        held += n * biggest
        top = first
    return held


def pieces(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """doc_id, piece, start, n_tokens: words and one end token, cut at multiples of the largest length."""
    n = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD_RE)) + 1
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), n.cast("long").alias("total"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / longest))))
    return cut.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("total") - F.col("piece") * longest).alias("n_tokens"))


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece, start, n_tokens, shard, bin, bin_offset, capacity. (shard, bin) names a sequence."""
    cut = pieces(docs, id_col, text_col, max(capacities))
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit("shard")), F.lit(shards)).cast("long"))

    def one_shard(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "n_tokens"], kind="stable").reset_index(drop=True)
        out = pack(frame["n_tokens"].tolist(), tuple(capacities))
        frame["bin"], frame["bin_offset"], frame["capacity"] = (list(x) for x in zip(*out, strict=True))
        return frame

    schema = dealt.select("*", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("capacity")).schema
    return dealt.groupBy("shard").applyInPandas(lambda key, f: one_shard(key, f)[schema.names], schema)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
