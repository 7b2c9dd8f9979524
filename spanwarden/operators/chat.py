"""Chat bodies, tool calls, hook events and request-response pairs: projecting text out of them and writing it back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import check as ck

BODY = "struct<model:string,stream:boolean,messages:array<struct<role:string,content:string>>>"
PART = "array<struct<type:string,text:string>>"
COMPLETION = "struct<choices:array<struct<index:int,text:string,message:struct<role:string,content:string>>>>"
RPC_BLOCKED = -32001


def body_texts(body: Column) -> Column:
    """Texts of a chat request: a message's string content, or its text parts; media are skipped."""
    messages = F.from_json(body, BODY)["messages"]

    def one(m: Column, i: Column) -> Column:
        base = F.concat(F.lit("/messages/"), i.cast("string"), F.lit("/content"))
        parts = F.from_json(m["content"], PART)
        listed = F.filter(F.transform(parts, lambda p, j: F.struct(F.concat(base, F.lit("/"), j.cast("string"), F.lit("/text")).alias("path"), p["text"].alias("text"), p["type"].alias("t"))), lambda x: (x["t"] == "text") & x["text"].isNotNull())
        plain = F.array(F.struct(base.alias("path"), m["content"].alias("text")))
        is_list = F.coalesce(m["content"].startswith("["), F.lit(False)) & parts.isNotNull()
        out = F.when(is_list, F.transform(listed, lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text")))).otherwise(plain)
        return F.when(m["content"].isNull(), F.array().cast("array<struct<path:string,text:string>>")).otherwise(out)

    return F.coalesce(F.flatten(F.transform(messages, one)), F.array().cast("array<struct<path:string,text:string>>"))


def body_model(body: Column) -> Column:
    return F.coalesce(F.from_json(body, BODY)["model"], F.lit("unknown"))


def completion_text(body: Column) -> Column:
    """All choices' texts in one string."""
    return F.array_join(F.transform(F.from_json(body, COMPLETION)["choices"], lambda c: F.coalesce(c["message"]["content"], c["text"], F.lit(""))), "")


def reapply_completion(body: Column, text: Column) -> Column:
    """The body with the text in its first choice and the others blank; all else (ids, usage, tool calls) as it was. A body that is no object is unchanged."""
    return _reapplied(body, text)


@F.pandas_udf(StringType())
def _reapplied(bodies: pd.Series, texts: pd.Series) -> pd.Series:
    def one(body, text):
        try:
            tree = json.loads(body)
            choices = tree["choices"]
        except (KeyError, TypeError, ValueError):
            return body
        for i, choice in enumerate(choices if isinstance(choices, list) else ()):
            own = text if i == 0 else ""
            if isinstance(choice, dict):
                if isinstance(choice.get("text"), str):
                    choice["text"] = own
                if isinstance(choice.get("message"), dict):
                    choice["message"]["content"] = own
        return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(b, t) for b, t in zip(bodies, texts, strict=True)], dtype=object)


def prompt_texts(prompt: list[dict]) -> list[tuple[str, str]]:
    """(pointer, text) of a model prompt: system strings; text, reasoning and tool-result parts of the others. Files, calls and media are skipped."""
    out = []
    for i, m in enumerate(prompt):
        if isinstance(m.get("content"), str):
            out.append((f"/{i}/content", m["content"]))
            continue
        for j, p in enumerate(m.get("content") or []):
            if p.get("type") in ("text", "reasoning"):
                out.append((f"/{i}/content/{j}/text", p["text"]))
            elif p.get("type") == "tool-result":
                result = p.get("output", {})
                if result.get("type") == "text":
                    out.append((f"/{i}/content/{j}/output/value", result["value"]))
                elif result.get("type") == "json":
                    from .jsonscan import walk

                    out += [(f"/{i}/content/{j}/output/value{path}", t) for path, is_key, t in walk(result["value"]) if not is_key]
                elif result.get("type") == "content":
                    out += [(f"/{i}/content/{j}/output/value/{k}/text", x["text"]) for k, x in enumerate(result["value"]) if x.get("type") == "text"]
    return out


def check_bodies(df: DataFrame, body_col: str, keys: list[str], ctx: ck.Context) -> DataFrame:
    """One row a text of a chat request, checked at the boundary of the body's model: key columns, path, and what `check` gives."""
    from dataclasses import replace

    rows = df.select(*[F.col(f"`{k}`") for k in keys], body_model(F.col(f"`{body_col}`")).alias("model"), F.explode(body_texts(F.col(f"`{body_col}`"))).alias("x")).select(*keys, "model", "x.path", "x.text")
    return ck.check(rows, "text", replace(ctx, boundary_col="model"))


def pair_calls(requests: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Tool calls with their responses: an inner join on the id; of repeated ids each request meets each response."""
    return requests.withColumnRenamed("body", "request").join(responses.withColumnRenamed("body", "response"), key)


def check_calls(df: DataFrame, server: str, ctx: ck.Context) -> DataFrame:
    """Paired calls (id, tool, request, response): arguments checked going out, results coming in, as boundaries mcp:server/tool; `rpc_error` is set where one is blocked."""
    from dataclasses import replace

    own = replace(ctx, boundary_col="_boundary", boundary=None)
    df = df.withColumn("_boundary", F.concat(F.lit(f"mcp:{server}/"), "tool"))
    names = ("output", "blocked", "block_entity", "block_rule", "block_message", "decisions", "puts")
    for col, suffix in (("request", "out"), ("response", "in")):
        df = ck.check(df, col, own).withColumnsRenamed({n: f"{n}_{suffix}" for n in names})
    return df.drop("_boundary").withColumn("rpc_error", F.when(F.col("blocked_out") | F.col("blocked_in"), F.lit(RPC_BLOCKED)))


def check_hooks(df: DataFrame, ctx: ck.Context) -> DataFrame:
    """Hook events (hook_event_name, session_id, tool_name, tool_input, tool_response as text): `verdict` is deny, update, silent or audit.

    Before a tool runs its input is checked going out: a block denies, a change updates; afterwards the response is only audited.
    """
    from dataclasses import replace

    before = F.col("hook_event_name") == "PreToolUse"
    rows = df.withColumn("_text", F.when(before, F.col("tool_input")).otherwise(F.col("tool_response"))).withColumn("_boundary", F.concat(F.lit("tool:"), "tool_name", F.when(before, F.lit(":out")).otherwise(F.lit(":in"))))
    out = ck.check(rows, "_text", replace(ctx, boundary_col="_boundary", workflow_col="session_id"))
    verdict = F.when(~before, F.lit("audit")).when(F.col("blocked"), F.lit("deny")).when(~F.col("output").eqNullSafe(F.col("_text")), F.lit("update")).otherwise(F.lit("silent"))
    return out.withColumn("verdict", verdict).drop("_text", "_boundary")


def violation(checked: DataFrame) -> DataFrame:
    """type, entity, rule of blocked rows."""
    return checked.where("blocked").select(F.lit("policy_violation").alias("type"), F.col("block_entity").alias("entity"), F.col("block_rule").alias("rule"))


def workflow_of(*columns: str) -> Column:
    """The first of the columns that is set, else "default"."""
    return F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in columns], F.lit("default"))


def chat_projection(spark, d):
    """Conversations as chat requests, and the texts taken out of them again."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    bodies = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return bodies.select("conv_id", F.posexplode(body_texts(body)).alias("i", "x")).select("conv_id", F.col("i").cast("long").alias("i"), "x.path", "x.text")


def rpc_pairing(spark, d):
    """Event pairs by id as request and response: even event ids ask, the next odd one answers."""
    e = spark.read.parquet(f"{d}/events.parquet")
    asked = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("body"))
    answered = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("id"), F.col("props").alias("body"))
    return pair_calls(asked, answered)




QUERIES = {"chat_projection": chat_projection, "rpc_pairing": rpc_pairing}
ORACLE = {
    "chat_projection": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, '/messages/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) || '/content' AS path, text FROM conversations WHERE text IS NOT NULL",
    "rpc_pairing": "SELECT a.event_id AS id, a.event_type AS request, b.props AS response FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0",
}
