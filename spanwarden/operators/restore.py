"""Restoring tokens at egress: scan, look up, splice. The lookup is the only join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions.spans import MATCH, find, let, splice
from . import policy as P
from .check import DECISION
from .vault import lookup


class InvariantViolation(RuntimeError):
    """Restoring anywhere but at egress."""


def token_spans(text: Column) -> Column:
    """Tokens of all four shapes, by start and then longer first; of overlapping ones the first stays."""
    every = F.concat(*[find(text, p) for p in (C.LABEL_TOKEN, C.EMAIL_TOKEN, C.PHONE_TOKEN, C.CARD_TOKEN)])
    ordered = F.array_sort(F.transform(every, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("e"), m["value"].alias("value"))))

    def step(kept: Column, m: Column) -> Column:
        clear = (F.size(kept) == 0) | (m["start"] >= F.element_at(kept, -1)["end"])
        return F.when(clear, F.concat(kept, F.array(F.struct(m["start"].alias("start"), (-m["e"]).alias("end"), m["value"].alias("value"))).cast(MATCH))).otherwise(kept)

    return F.aggregate(ordered, F.array().cast(MATCH), step)


def restore(df: DataFrame, text_col: str, keys: list[str], vault: DataFrame, boundary: dict, master: bytes, workflow_col: str | None = None, workflow: str = "default", agent: str = "default", now: Column | None = None, enforce_policy: dict | None = None) -> DataFrame:
    """All columns of `df`, and restored and decisions (detokenize, or restore_miss where the vault has no live record; the hash is the token's).

    Tokens are looked up exploded, with one shuffle on (workflow_id, token), and gathered again by the keys, the workflow and two hashes of the text; the tokens are
    bounded by the text. So keys may repeat or be null: rows alike in all of these share their restored text, and the others stay apart.
    """
    if boundary.get("kind") != "egress":
        raise InvariantViolation("restore is for egress boundaries only")
    key = P.boundary_key(boundary)
    if enforce_policy is not None and P.resolve_one(P.compile_policy(enforce_policy), "email", key, agent)[0] != "detokenize":
        raise InvariantViolation("the sink's policy does not restore")
    flow = F.coalesce(F.nullif(F.col(f"`{workflow_col}`"), F.lit("")), F.lit("default")) if workflow_col else F.lit(workflow)
    # Inside a struct nulls are equal.
    row = F.struct(*[F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(keys)], F.col("_flow").alias("flow"), F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit("row"), "_text").alias("h2"))
    rows = df.withColumn("_text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn("_flow", flow).withColumn("_row", row)
    marks = rows.select("_row", F.col("_flow").alias("workflow_id"), F.explode(let(F.col("_text"), token_spans)).alias("m")).select("_row", "workflow_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("token"))
    found = lookup(vault, marks.distinct(), master, now)
    hit = F.col("value").isNotNull()
    decision = F.struct(
        F.when(hit, F.lit("detokenize")).otherwise(F.lit("restore_miss")).alias("action"), F.coalesce("entity", F.lit("unknown")).alias("entity"), F.lit(key).alias("boundary_key"), F.lit("egress").alias("boundary_kind"), F.lit(agent).alias("agent"),
        F.lit("restore").alias("rule"), F.lit("").alias("path"), F.col("start"), F.col("end"), F.sha2("token", 256).alias("content_hash"), F.lit(None).cast("string").alias("applied_as"),
    ).cast(DECISION)
    per_row = found.groupBy("_row").agg(F.collect_list(F.struct("start", "end", F.coalesce("value", "token").alias("replacement"))).alias("_pieces"), F.array_sort(F.collect_list(F.struct("start", decision.alias("d")))).alias("_d"))
    joined = rows.join(per_row, "_row", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(F.col("_pieces").isNull(), F.col(f"`{text_col}`")).otherwise(splice(F.col("_text"), F.col("_pieces"))).alias("restored"),
        F.coalesce(F.transform("_d", lambda x: x["d"]), F.array().cast(f"array<{DECISION}>")).alias("decisions"),
    )
