"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters and sorted externally, so that equal normalised texts become adjacent;
neighbours are then compared in full. The sort key is the first characters of the normalised text and its SHA-256 (a
bounded image of the content, so that the sampled splitters stay small however long the texts are), then the order in
which rows of a group are preferred. Because the preference is part of the key, a group of copies of any size may span many
partitions: nothing collects a group. Only the first and last run of each partition can touch a neighbour's, so
two rows a partition are enough to join the pieces of a group.

Defined cases: a null text counts as empty, and all empty texts are equal; a null id sorts last among equals; repeated
rows are equal rows, of which one stays; an empty table gives an empty result; other columns, whatever their names, are
carried by `keep_rows` and ignored by `classify`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, documents, stash

HEAD = 48


def normalise(text: Column) -> Column:
    """The text without its white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def _runs(keep_payload: bool, names: list[str]):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, last, run_no = [], None, -1  # all but the text itself: a few dozen bytes a row
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch.column("norm")
            first = np.ones(batch.num_rows, bool)
            first[1:] = ~pc.equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            if last is not None:
                first[0] = norm[0].as_py() != last
            last = norm[batch.num_rows - 1].as_py()
            runs = run_no + np.cumsum(first)
            run_no = int(runs[-1])
            rows = batch.select([n for n in batch.schema.names if n != "norm"])
            if keep_payload:
                rows, runs_kept = rows.filter(pa.array(first)), runs[first]
            else:
                runs_kept = runs
            held.append((rows, runs_kept, runs))
        if run_no < 0:
            return
        sizes = np.bincount(np.concatenate([x[2] for x in held]), minlength=run_no + 1)
        keeper: dict[int, tuple] = {}
        for rows, runs, _ in held:
            start = np.flatnonzero(np.diff(runs, prepend=-1 if not keeper else max(keeper)))
            ids = rows.column("_id")
            for i, r in zip(start.tolist(), runs[start].tolist(), strict=True):
                keeper.setdefault(r, ids[i].as_py())
        seen = -1
        for rows, runs, _ in held:
            if not len(runs):
                continue
            leads = np.diff(runs, prepend=seen) > 0
            seen = int(runs[-1])
            extra = {
                "keep": pa.array([keeper[r] for r in runs.tolist()], rows.schema.field("_id").type),
                "n": pa.array(sizes[runs].astype(np.int64)),
                "leads": pa.array(leads),
                "part": pa.array(np.full(len(runs), part, np.int32)),
                "run": pa.array(runs.astype(np.int64)),
                "edge": pa.array((runs == 0) | (runs == run_no)),
            }
            yield pa.RecordBatch.from_arrays([rows.column(n) for n in names] + list(extra.values()), names=names + list(extra))

    return run


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, payload: Column | None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    cols = [F.col(f"`{id_col}`").alias("_id"), normalise(text).alias("norm"), F.length(F.coalesce(text, F.lit(""))).alias("chars")]
    rows = docs.select(*cols, *([payload.alias("payload")] if payload is not None else []))
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("sha", F.sha2("norm", 256))
    order = [F.col("head"), F.col("sha"), F.col("chars").desc(), F.col("_id").asc_nulls_last()]
    names = ["_id", "sha"] + (["payload"] if payload is not None else [])
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "norm", "sha", *names[2:])
    schema = T.StructType(
        [placed.schema[n] for n in names]
        + [
            T.StructField("keep", placed.schema["_id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("leads", T.BooleanType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("run", T.LongType()),
            T.StructField("edge", T.BooleanType()),
        ]
    )
    return stash(placed.mapInArrow(_runs(payload is not None, names), schema), "content-sort")


def _joined_edges(runs: DataFrame) -> DataFrame:
    """For each first or last run of a partition: keeper, size, and whether it continues a run from before."""
    edges = runs.where("edge").groupBy("part", "run").agg(F.first("sha").alias("sha"), F.first("keep").alias("keep"), F.max("n").alias("n"))
    rows = sorted(edges.collect(), key=lambda r: (r["part"], r["run"]))  # two rows a partition at most
    chains: list[list] = []
    for r in rows:
        if chains and chains[-1][-1]["sha"] == r["sha"] and chains[-1][-1]["part"] != r["part"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    fixed = [(r["part"], r["run"], c[0]["keep"], sum(x["n"] for x in c), i > 0) for c in chains for i, r in enumerate(c)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("keep2", runs.schema["keep"].dataType), T.StructField("n2", T.LongType()), T.StructField("continues", T.BooleanType())])
    return F.broadcast(runs.sparkSession.createDataFrame(fixed, schema))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Of equal texts the longest original, then the smallest id, stays."""
    runs = _sorted_runs(docs, id_col, text_col, None)
    known = F.col("n2").isNotNull()
    return runs.join(_joined_edges(runs), ["part", "run"], "left").select(
        F.col("_id").alias(id_col),
        F.when(known, F.col("keep2")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n2", "n").alias("group_size"),
        (F.col("leads") & ~F.coalesce("continues", F.lit(False))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    runs = _sorted_runs(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = runs.join(_joined_edges(runs), ["part", "run"], "left").where(F.col("leads") & ~F.coalesce("continues", F.lit(False)))
    return kept.select("payload.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
