"""Audit events: building, ingesting, querying; policy versions; API keys. Events never hold values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .check import DECISION

EVENT = f"env_id string, id string, type string, workflow_id string, ts_ms long, decisions array<{DECISION}>, ingested_at timestamp"
WIRE = "struct<events:array<struct<type:string,workflowId:string,timestamp:bigint,decisions:array<struct<action:string,entity:string,boundary:struct<kind:string,provider:string,name:string,direction:string,server:string,tool:string,sink:string>,identity:struct<agent:string>,rule:string,span:struct<path:string,start:int,end:int>,contentHash:string,appliedAs:string>>>>>"
MAX_LIMIT, DEFAULT_LIMIT = 1000, 100


class QueryError(ValueError):
    """Bad query parameters."""


def events(checked: DataFrame, workflow: Column, ts_ms: Column | None = None, kind: str = "check") -> DataFrame:
    """One event for each checked row that has a decision."""
    at = ts_ms if ts_ms is not None else F.unix_millis(F.current_timestamp())
    return checked.where(F.size("decisions") > 0).select(F.lit(kind).alias("type"), workflow.alias("workflow_id"), at.alias("ts_ms"), "decisions")


def to_jsonl(found: DataFrame) -> DataFrame:
    """One line of JSON an event, in column `value`; write it with `format("text")`."""
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def write_jsonl(found: DataFrame, path: str) -> None:
    to_jsonl(found).write.mode("append").text(path)


def fan_out(sinks) -> callable:
    """A `foreachBatch` function that hands a batch to every sink; a sink that fails does not fail the batch. Failures are counted on the function."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for sink in sinks:
            try:
                sink(batch, batch_id)
            except Exception:  # noqa: BLE001  auditing is off the data path
                run.failures += 1

    run.failures = 0
    return run


def ingest(batches: DataFrame, env_id: str, body_col: str = "body") -> DataFrame:
    """Events rebuilt from JSON batches by an allow-list: unknown keys and claims are dropped, hashes are lower-cased hex of 64 digits.

    A batch with any malformed event is rejected as a whole: it gives one row with type `rejected` and no decisions.
    """
    parsed = batches.withColumn("_p", F.from_json(F.col(f"`{body_col}`"), WIRE))

    def decision_ok(d: Column) -> Column:
        return (
            F.coalesce(d["action"].isin("allow", "mask", "tokenize", "block", "review", "detokenize", "restore_miss"), F.lit(False)) & d["entity"].isNotNull() & d["rule"].isNotNull() & d["identity"]["agent"].isNotNull()
            & F.coalesce(d["boundary"]["kind"].isin("model", "tool", "mcp", "telemetry", "egress"), F.lit(False)) & F.coalesce(F.lower(d["contentHash"]).rlike("^[0-9a-f]{64}$"), F.lit(False)) & d["span"]["start"].isNotNull() & d["span"]["end"].isNotNull()
        )

    def event_ok(e: Column) -> Column:
        return F.coalesce(e["type"].isin("check", "restore"), F.lit(False)) & e["workflowId"].isNotNull() & e["timestamp"].isNotNull() & e["decisions"].isNotNull() & F.forall(F.coalesce(e["decisions"], F.array()), decision_ok)

    good = parsed.withColumn("_ok", F.col("_p.events").isNotNull() & F.forall(F.col("_p.events"), event_ok))
    from .policy import boundary_key_column

    def rebuilt(d: Column) -> Column:
        return F.struct(
            d["action"].alias("action"), d["entity"].alias("entity"), boundary_key_column(d["boundary"]).alias("boundary_key"), d["boundary"]["kind"].alias("boundary_kind"), d["identity"]["agent"].alias("agent"), d["rule"].alias("rule"),
            F.coalesce(d["span"]["path"], F.lit("")).alias("path"), d["span"]["start"].alias("start"), d["span"]["end"].alias("end"), F.lower(d["contentHash"]).alias("content_hash"), F.when(d["appliedAs"] == "mask", F.lit("mask")).alias("applied_as"),
        ).cast(DECISION)

    rejected = F.array(F.struct(F.lit("rejected").alias("type"), F.lit(None).cast("string").alias("workflowId"), F.lit(None).cast("long").alias("timestamp"), F.array().cast(f"array<{DECISION}>").alias("decisions")))
    accepted = F.transform(F.col("_p.events"), lambda e: F.struct(e["type"].alias("type"), e["workflowId"].alias("workflowId"), e["timestamp"].alias("timestamp"), F.transform(e["decisions"], rebuilt).alias("decisions")))
    rows = good.select(F.explode(F.when(F.coalesce("_ok", F.lit(False)), accepted).otherwise(rejected)).alias("e"))
    return rows.select(F.lit(env_id).alias("env_id"), F.expr("uuid()").alias("id"), F.col("e.type").alias("type"), F.col("e.workflowId").alias("workflow_id"), F.col("e.timestamp").alias("ts_ms"), F.col("e.decisions").alias("decisions"), F.current_timestamp().alias("ingested_at"))


@dataclass(frozen=True)
class AuditQuery:
    """Each filter is met if some decision meets it; filters are independent of each other."""

    entity: str | None = None
    boundary_kind: str | None = None
    agent: str | None = None
    content_hash: str | None = None
    rule: str | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @classmethod
    def parse(cls, params: dict[str, str]) -> AuditQuery:
        """From text parameters: limit defaults to 100 and is cut at 1000; limit below 1 or a negative or fractional offset is an error."""

        def whole(name, default, least):
            raw = params.get(name, str(default))
            if not raw.lstrip("-").isdigit() or int(raw) < least:
                raise QueryError(f"{name}: an integer of at least {least} is expected")
            return int(raw)

        names = {"entity": "entity", "boundaryKind": "boundary_kind", "identity": "agent", "contentHash": "content_hash", "rule": "rule"}
        return cls(limit=min(MAX_LIMIT, whole("limit", DEFAULT_LIMIT, 1)), offset=whole("offset", 0, 0), **{v: params[k] for k, v in names.items() if params.get(k)})


def _equals(name: str, value: str):
    return lambda d: d[name] == value


def query(found: DataFrame, env_id: str, q: AuditQuery, seq: str = "id") -> DataFrame:
    """Events of one environment that match, newest first (ties by `seq`), one page."""
    rows = found.where(F.col("env_id") == env_id)
    for name in ("entity", "boundary_kind", "agent", "content_hash"):
        if (value := getattr(q, name)) is not None:
            rows = rows.where(F.exists("decisions", _equals(name, value)))
    if q.rule is not None:
        rows = rows.where(F.exists("decisions", lambda d: d["rule"].contains(q.rule)))
    return rows.orderBy(F.col("ts_ms").desc(), F.col(seq)).offset(q.offset).limit(q.limit)


def latest_policy(versions: DataFrame) -> DataFrame:
    """env_id, version, document: the greatest version of each environment."""
    return versions.groupBy("env_id").agg(F.max("version").alias("version"), F.max_by("document", "version").alias("document"))


def publish(versions: DataFrame, env_id: str, document: str) -> DataFrame:
    """The row to append: the environment's next version."""
    return versions.where(F.col("env_id") == env_id).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version")).select(F.lit(env_id).alias("env_id"), "version", F.lit(document).alias("document"))


def environment_of(keys: DataFrame, environments: DataFrame) -> DataFrame:
    """`keys` (api_key) with the environment whose stored hash it has, or null. environments: env_id, key_hash."""
    return keys.withColumn("key_hash", F.sha2("api_key", 256)).join(environments.select("env_id", "key_hash"), "key_hash", "left").drop("key_hash")


# Queries over audit events that are made of the events table.


def sample_events(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    entity = F.element_at(F.array(*[F.lit(x) for x in ("email", "phone", "api_key")]), (F.col("user_id") % 3 + 1).cast("int"))
    one = F.struct(
        F.lit("mask").alias("action"), entity.alias("entity"), F.concat(F.lit("tool:"), "event_type", F.lit(":in")).alias("boundary_key"), F.when(F.col("event_id") % 2 == 0, "tool").otherwise("model").alias("boundary_kind"),
        F.concat(F.lit("agent"), F.col("user_id") % 5).alias("agent"), F.concat(F.lit("boundaries."), "event_type", F.lit(".entities"),).alias("rule"), F.lit("").alias("path"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.sha2(F.col("user_id").cast("string"), 256).alias("content_hash"), F.lit(None).cast("string").alias("applied_as"),
    ).cast(DECISION)
    return e.select(F.concat(F.lit("env"), F.col("user_id") % 4).alias("env_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.lit("check").alias("type"), F.concat(F.lit("w"), "user_id").alias("workflow_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.array(one).alias("decisions"))


def _page(q):
    return lambda spark, d: query(sample_events(spark, d), "env1", q).select("id", "ts_ms", "workflow_id")


def _page_sql(where, limit=100, offset=0):
    return f"SELECT lpad(event_id::VARCHAR, 12, '0') AS id, epoch_us(ts) // 1000 AS ts_ms, 'w' || user_id AS workflow_id FROM events WHERE user_id % 4 = 1 AND {where} ORDER BY ts_ms DESC, id LIMIT {limit} OFFSET {offset}"


def _versions(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("env"), F.col("o_custkey") % 100).alias("env_id"), F.col("o_orderkey").alias("version"), F.concat(F.lit("doc"), "o_orderkey").alias("document"))


def audit_counts(spark, d):
    rows = sample_events(spark, d).select("env_id", F.explode("decisions").alias("x"))
    return rows.groupBy("env_id", F.col("x.entity").alias("entity"), F.col("x.boundary_kind").alias("boundary_kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "audit_query_entity": _page(AuditQuery(entity="phone", limit=1000)),
    "audit_query_kind_page": _page(AuditQuery(boundary_kind="tool", limit=50, offset=20)),
    "audit_query_rule": _page(AuditQuery(rule="click", limit=1000)),
    "audit_query_agent": _page(AuditQuery(agent="agent1", limit=1000)),
    "audit_counts": audit_counts,
    "latest_policy": lambda spark, d: latest_policy(_versions(spark, d)),
    "publish_version": lambda spark, d: publish(_versions(spark, d), "env7", "next"),
}
ORACLE = {
    "audit_query_entity": _page_sql("user_id % 3 = 1", 1000),
    "audit_query_kind_page": _page_sql("event_id % 2 = 0", 50, 20),
    "audit_query_rule": _page_sql("event_type LIKE '%click%'", 1000),
    "audit_query_agent": _page_sql("user_id % 5 = 1", 1000),
    "audit_counts": "SELECT 'env' || user_id % 4 AS env_id, ['email', 'phone', 'api_key'][user_id % 3 + 1] AS entity, CASE WHEN event_id % 2 = 0 THEN 'tool' ELSE 'model' END AS boundary_kind, count(*) AS n FROM events GROUP BY ALL",
    "latest_policy": "SELECT 'env' || o_custkey % 100 AS env_id, max(o_orderkey) AS version, 'doc' || max(o_orderkey) AS document FROM orders GROUP BY 1",
    "publish_version": "SELECT 'env7' AS env_id, coalesce(max(o_orderkey), 0) + 1 AS version, 'next' AS document FROM orders WHERE o_custkey % 100 = 7",
}
