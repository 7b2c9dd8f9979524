"""Near-duplicate detection by bottom-k sketches.

A text's set is its distinct word shingles, hashed to 64 bits by one function. Its sketch is the k least hashes (the whole set if
that is smaller). Texts with equal sets are one class from the start, whatever their number.

Candidates come from inverted lists of sketch values, in two steps. A coarse sketch (K) sorts out the texts that have no partner: sets of the wanted
similarity share at least `least_overlap` values of their sketches, so a text with too many values that it alone holds has none. The others get a
fine sketch (FINE). With values ordered by how many sketches hold them, the first (held - least_overlap + 1) values of two linked sets have one in common
(prefix filter), and the first common one leaves each set enough values for the overlap that the two sizes ask for. So frequent values make entries only for
texts that hold little else, and two texts of a list become a pair only if the values from there on allow the similarity.

Lists are not expanded to all pairs. Each text is first compared with one leader, of those of its lists the one met most often; a list's leader is its text with
the fewest values of its own, which in a group of copies is about the original. That gathers groups of copies at one pair a text. Then the members outside
the largest group of a list still mixed take turns, in turns of fast growing size, at being compared with the members of other groups, until all have had theirs:
two texts that share a list and stay in different groups have been compared, or ruled out by their counts. A pair is sorted out if the similarity estimated on
the union's sketch is over six standard deviations below the threshold, and is else confirmed on the full sets. Confirmed links join groups.

Sketches that hold whole sets (in the fine step those of up to FINE * similarity values) lose no link; larger ones lose one with the chance that a sum of k draws, in either
step or in the estimate, falls six standard deviations low.

Defined cases: null and wordless texts have an empty set and are linked with nothing; fewer words than a shingle make one shingle of
all; rows with the same set are linked; ids may be of any type that sorts; a null id is larger than any other; rows repeated as a whole stay or go together; an empty
table gives no rows; other columns are kept by `keep_rows`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, documents, partitions, shingle_hashes, stash

K, FINE = 64, 512
#: Hubs of a list's first turn, and how many times as many come by the next.
HUBS, GROWTH = 32, 32
#: Entries before an entry that are looked at to tell whether two texts have met already.
BEFORE = 4
#: Links that a task takes while groups are joined.
TASK_ROWS = 100_000
SHINGLE, SIMILARITY = 5, (80, 100)


def least_overlap(size: int, k: int, similarity: tuple[int, int]) -> int:
    """Values that the sketch of a set of this size shares with that of any linked set."""
    num, den = similarity
    if size * den <= num * k:  # a linked set has at most k values, so both sketches are whole
        return max(1, -(-num * size // den))
    ratio = num / den
    return max(1, int(k * ratio - 6 * (k * ratio * (1 - ratio)) ** 0.5))


def _least(similarity: tuple[int, int], k: int) -> Column:
    """`least_overlap` of the column size."""
    num, den = similarity
    return F.when(F.col("size") * den <= num * k, F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") * num / den))).otherwise(F.lit(least_overlap(den * k, k, similarity)).cast("long"))


def _sets(batch, hashes: WordHashes, shingle: int) -> list[np.ndarray]:
    """Each text's set as sorted uint64. Only A-Z are lower-cased."""
    return [np.unique(shingle_hashes(hashes.of(d.lower().split()), shingle)) for d in batch.column("data").to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(data).alias("th"), data.alias("data"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """id, th (hash of the text), s1, s2 (128-bit digest of the set), size, sketch (the k least hashes)."""

    def run(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = _sets(part, hashes, shingle)
                digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in own], np.int64).reshape(-1, 2)
                heads = [s[:k].view(np.int64) for s in own]
                offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("th"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([len(s) for s in own], pa.int64()), sketch],
                    names=["id", "th", "s1", "s2", "size", "sketch"],
                )

    rows = _rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, s1 long, s2 long, size long, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of all nodes of `edges` (a, b): alternating large and small stars, each written.

    The tables of later steps are read in as many tasks as their rows ask for, so that a small graph takes few.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        size, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (size, total) == before:
            break
        before, tasks = (size, total), _tasks(edges, size)
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).coalesce(tasks)
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")).coalesce(tasks)
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = stash(small.distinct().coalesce(tasks), "edges")
    named = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stash(named.union(named.select(F.col("component").alias("node"), "component").distinct()), "components")


def _tasks(df: DataFrame, rows: int) -> int:
    return max(1, min(partitions(df.sparkSession), -(-rows // TASK_ROWS)))


def _verify(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], k: int) -> DataFrame:
    """The rows of `pairs` (a, b and perhaps others) whose sets have den * intersection >= num * union; the sketch estimate sorts most others out first."""
    num, den = similarity
    ratio = num / den
    lowest = ratio - 6 * (ratio * (1 - ratio) / k) ** 0.5
    names = pairs.columns

    def check(batches):
        for batch in batches:
            keep = []
            columns = []
            for name in ("sa", "sb"):
                lists = batch.column(name)
                columns.append((lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()))
            (xs, xo), (ys, yo) = columns
            for i in range(batch.num_rows):
                x, y = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                union = np.union1d(x[:k], y[:k])[:k]
                shared = len(np.intersect1d(np.intersect1d(union, x[:k], assume_unique=True), y[:k], assume_unique=True))
                if len(union) == k and shared < lowest * k:
                    keep.append(False)
                    continue
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return two.select(*names, "sa", "sb").mapInArrow(check, pairs.schema)


def promising(classes: DataFrame, similarity: tuple[int, int], k: int) -> DataFrame:
    """The rows of `classes` (node, size, sketch) that share enough values with others to be linked, without their sketches."""
    lone = classes.select("node", F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    known = classes.withColumn("held", F.size("sketch")).drop("sketch").join(lone, "node", "left")
    return known.where(F.col("held") - F.coalesce("lone", F.lit(0)) >= _least(similarity, k)).drop("held", "lone")


def inverted_lists(sketched: DataFrame, similarity: tuple[int, int], k: int) -> DataFrame:
    """value, node, size, own, left, before: the entries of the prefix filter. `own` counts the values that no other sketch holds, `left` those shared from this one on;
    `before` holds the node's BEFORE entries before this one. sketched: node, size, sketch."""
    values = sketched.select("node", "size", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")  # one sketch, at most k rows
    held = values.join(shared, "value").withColumn("held", F.count(F.lit(1)).over(own)).withColumn("least", _least(similarity, k)).where("held >= least")
    order = own.orderBy("df", "value")
    before = F.array_compact(F.array(*[F.lag("value", i + 1).over(order) for i in range(BEFORE)]))
    placed = held.withColumn("place", F.row_number().over(order)).withColumn("before", before).where("place <= held - least + 1")
    return placed.select("value", "node", "size", (F.least("size", F.lit(k)) - F.col("held")).alias("own"), (F.col("held") - F.col("place") + 1).alias("left"), "before")


def hub_columns(rows: DataFrame, grp: str) -> DataFrame:
    more = [F.col("before").alias("hub_before")] if "before" in rows.columns else []
    return rows.select("value", F.col("node").alias("hub"), F.col(grp).alias("hub_grp"), F.col("size").alias("hub_size"), F.col("left").alias("hub_left"), *more)


def meetings(members: DataFrame, hubs: DataFrame, similarity: tuple[int, int], k: int) -> DataFrame:
    """Members and hubs of one list and different groups that can be similar: their sizes, and the values they share from here on, allow it.

    Where hubs have `before`, those that meet in a list just before as well are left to that one: there, at most one is in the largest group, so the other has its turn.
    """
    num, den = similarity
    both = F.col("size") + F.col("hub_size")
    whole = F.greatest("size", "hub_size") <= k
    asked = F.when(whole, F.ceil(both * num / (num + den))).otherwise(F.lit(least_overlap(den * k, k, similarity)).cast("long"))
    able = (F.least("size", "hub_size") * den >= F.greatest("size", "hub_size") * num) & (F.least("left", "hub_left") >= asked)
    if "hub_before" in hubs.columns:
        able &= ~F.arrays_overlap("before", "hub_before")
    return members.join(hubs, "value").where((F.col("grp") != F.col("hub_grp")) & able)


def link(entries: DataFrame, sets: DataFrame, similarity: tuple[int, int], k: int = FINE) -> DataFrame:
    """(node, component) of the nodes linked with another. entries: as from `inverted_lists`; sets: node, size, set."""
    leaders = entries.groupBy("value").agg(F.min(F.struct("own", "node", "size", "left")).alias("h")).select("value", "h.*")
    met = meetings(entries.withColumn("grp", F.col("node")), hub_columns(leaders, "node"), similarity, k).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("b")).select(F.col("node").alias("a"), "b")
    groups = components(stash(_verify(best, sets, similarity, k), "links"))
    named = entries.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    kinds = named.groupBy("value", "grp").agg(F.count(F.lit(1)).alias("c"))
    mixed = kinds.groupBy("value").agg(F.max(F.struct("c", "grp")).alias("top"), F.sum("c").alias("members"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # A member's place among those outside the largest group, by a hash: places 0 to HUBS - 1 have the first turn, then GROWTH times as many have the next, and so on.
    place = (F.pmod(F.xxhash64("node", "value"), F.lit(1 << 30)) / float(1 << 30)) * (F.col("members") - F.col("top.c"))
    turn = F.when(F.col("grp") != F.col("top.grp"), F.floor(F.log(float(GROWTH), place / HUBS * (GROWTH - 1) + 1)).cast("int"))
    listed = stash(named.join(mixed, "value").select("value", "node", "size", "left", "before", turn.alias("turn")), "mixed-lists")
    last = listed.agg(F.max("turn")).first()[0]
    for now in range(0 if last is None else last + 1):
        named = listed.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
        # Of two that meet, a is the member: each pair is compared once a turn, under the labels of their groups.
        pairs = meetings(named, hub_columns(named.where(F.col("turn") == now), "grp"), similarity, k).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.least("grp", "hub_grp").alias("g"), F.greatest("grp", "hub_grp").alias("h")).distinct()
        found = stash(_verify(pairs, sets, similarity, k), "links")
        if not found.isEmpty():
            merged = components(found.select(F.col("g").alias("a"), F.col("h").alias("b")))
            now_in = merged.select(F.col("node").alias("_from"), F.col("component").alias("_to"))
            moved = groups.join(now_in, F.col("component") == F.col("_from"), "left").select("node", F.coalesce("_to", "component").alias("component"))
            # Nodes that were alone until now.
            fresh = merged.join(groups.select("node"), "node", "left_anti")
            groups = stash(moved.unionByName(fresh), "groups")
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, k: int = K, fine: int = FINE) -> DataFrame:
    """One row a text: id, th, n_shingles, component_id (the least id reachable over links, its own included).

    `similarity` is (numerator, denominator): linked if denominator * intersection >= numerator * union.
    """
    rows = stash(sketches(docs, id_col, text_col, shingle, k), "sketches")
    by_set = rows.where("size > 0").groupBy("s1", "s2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = stash(by_set.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    wanted = promising(classes.select("node", "size", "sketch", F.col("rep.id").alias("id"), F.col("rep.th").alias("th")), similarity, k)

    def full(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = _sets(part, hashes, shingle)
                offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("size"), lists], names=["node", "size", "set"])

    source = _rows(docs, id_col, text_col).alias("d")
    picked = source.join(wanted.alias("w"), (F.col("d.th") == F.col("w.th")) & F.col("d.id").eqNullSafe(F.col("w.id"))).select("w.node", "w.size", "d.data")
    sets = stash(picked.mapInArrow(full, "node long, size long, set array<long>").dropDuplicates(["node"]), "sets")
    entries = stash(inverted_lists(sets.select("node", "size", F.slice("set", 1, fine).alias("sketch")), similarity, fine), "inverted-lists")
    groups = link(entries, sets, similarity, fine)
    placed = classes.select("node", "s1", "s2", F.col("rep.id").alias("least")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(lowest, "component").select("s1", "s2", "component_id")
    out = rows.select("id", "th", "s1", "s2", "size").join(known, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), "th", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, k: int = K, fine: int = FINE) -> DataFrame:
    """The rows of `docs` whose id is the least of their group, with all their columns."""
    verdict = near_duplicates(docs, id_col, text_col, shingle, similarity, k, fine)
    gone = verdict.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")) == F.col("_th")), "left_anti")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir), shingle=3, similarity=(85, 100))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
