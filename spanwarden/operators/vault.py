"""The token vault as a table: insert if absent, look up, expire, purge; values are encrypted at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import TTL_SECONDS
from ..functions.tokens import decrypt, encrypt

SCHEMA = "workflow_id string, token string, entity string, ciphertext string, created_at timestamp, expires_at timestamp"


class VaultError(RuntimeError):
    """Two different values under one token, in strict mode."""


def records(checked: DataFrame, order: str | None = None) -> DataFrame:
    """One row a vault put: workflow_id, token, entity, value, seq (order of arrival)."""
    seq = F.col(f"`{order}`").cast("long") if order else F.lit(0).cast("long")
    return checked.select(seq.alias("seq"), F.explode("puts").alias("p")).select("seq", "p.*")


def first_writes(puts: DataFrame) -> DataFrame:
    """workflow_id, token, entity, value, collision: the first value of each token wins; `collision` tells that another differs.

    Grouping by token sums on the map side, so a value that a third of the rows hold shuffles once a task.
    """
    return puts.groupBy("workflow_id", "token").agg(F.min_by(F.struct("entity", "value"), F.struct("seq", "value")).alias("f"), F.min("value").alias("lo"), F.max("value").alias("hi")).select("workflow_id", "token", "f.entity", "f.value", (F.col("lo") != F.col("hi")).alias("collision"))


def insert_if_absent(vault: DataFrame, puts: DataFrame, master: bytes, now: Column | None = None, ttl_seconds: int = TTL_SECONDS, strict: bool = False) -> DataFrame:
    """The rows to append: tokens that the vault does not hold, or holds expired. `vault_status` is ok, collision (between new values), or collision_with_stored: such a row repeats what is stored and is not to be appended (`write` leaves it out)."""
    at = now if now is not None else F.current_timestamp()
    held = lookup(vault, first_writes(puts), master, at, "held_")
    stays = F.col("held_entity").isNotNull()
    against = stays & F.col("held_value").isNotNull() & (F.col("collision") | (F.col("held_value") != F.col("value")))
    if strict:
        held = held.withColumn("value", F.when(against | (F.col("collision") & ~stays), F.raise_error(F.lit("vault: two values under one token"))).otherwise(F.col("value")))
    # A live token is not written again, unless another value came under it: then a row tells, and what is stored stays.
    new = held.where(~stays | against)
    return new.select(
        "workflow_id", "token", F.coalesce("held_entity", "entity").alias("entity"), encrypt(F.coalesce("held_value", "value"), master).alias("ciphertext"), at.alias("created_at"),
        (at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"), F.when(stays, F.lit("collision_with_stored")).when(F.col("collision"), F.lit("collision")).otherwise(F.lit("ok")).alias("vault_status"),
    )


def lookup(vault: DataFrame, wanted: DataFrame, master: bytes, now: Column | None = None, prefix: str = "") -> DataFrame:
    """`wanted` (workflow_id, token, ...) with entity and value (their names prefixed), null where missing, expired or corrupt. Of records appended twice the first counts."""
    at = now if now is not None else F.current_timestamp()
    live = vault.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    first = live.groupBy("workflow_id", "token").agg(F.min(F.struct("created_at", "ciphertext", "entity")).alias("_first"))
    return wanted.join(first, ["workflow_id", "token"], "left").withColumn(f"{prefix}entity", F.col("_first.entity")).withColumn(f"{prefix}value", decrypt(F.col("_first.ciphertext"), master)).drop("_first")


def purge(vault: DataFrame, workflow_id: str) -> DataFrame:
    """The vault without one workflow's records."""
    return vault.where(F.col("workflow_id") != workflow_id)


def sweep(vault: DataFrame, now: Column | None = None) -> DataFrame:
    """The vault without expired records."""
    at = now if now is not None else F.current_timestamp()
    return vault.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))


def write(vault: DataFrame, path: str, buckets: int = 64) -> None:
    """Append records to a Parquet table laid out by a hash of the workflow, so that look-ups and purges prune."""
    if "vault_status" in vault.columns:
        vault = vault.where("vault_status <> 'collision_with_stored'")
    vault.withColumn("workflow_bucket", F.pmod(F.xxhash64("workflow_id"), F.lit(buckets))).write.mode("append").partitionBy("workflow_bucket").parquet(path)
