"""The check: detect, resolve, collapse, rewrite; decisions are an ordinary nested column and never hold a value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.catalogue import NER, PII, SECRETS
from ..functions.spans import DECIDED, collapse, let, splice
from . import policy as P
from .detect import Recognizer, builtin, columns_first, detect

DECISION = "struct<action:string,entity:string,boundary_key:string,boundary_kind:string,agent:string,rule:string,path:string,start:int,end:int,content_hash:string,applied_as:string>"
PUT = "struct<workflow_id:string,token:string,entity:string,value:string>"


RESULTS = ("output", "blocked", "block_entity", "block_rule", "block_message", "decisions", "puts")


@dataclass(frozen=True)
class Context:
    """What a check needs besides the text. `boundary` and `agent` are values or, as columns, differ by row."""

    boundary: dict | None = None
    boundary_col: str | None = None
    agent: str | None = None
    agent_col: str | None = None
    workflow: str = "default"
    workflow_col: str | None = None
    policy: dict = field(default_factory=P.default_policy)
    recognizers: tuple[Recognizer, ...] | None = None
    apply_block_as: str | None = None
    strict: bool = False
    threshold: float = 0.6
    master: bytes | None = None


def _known(ctx: Context) -> list[str]:
    own = [e for r in (ctx.recognizers or builtin()) for e in r.entities]
    return list(dict.fromkeys([*SECRETS, *PII, *NER, *own]))


def _literal_rules(ctx: Context) -> Column:
    """entity -> (action, format, rule) for a boundary and agent that all rows share."""
    rules, key = P.compile_policy(ctx.policy), P.boundary_key(ctx.boundary)
    pairs = []
    for entity in _known(ctx):
        action, fmt, rule = P.resolve_one(rules, entity, key, ctx.agent)
        pairs += [F.lit(entity), F.struct(F.lit(action).alias("action"), F.lit(fmt).cast("string").alias("format"), F.lit(rule).alias("rule"))]
    return F.create_map(*pairs)


def _joined_rules(df: DataFrame, ctx: Context) -> DataFrame:
    """`df` with `_rules`, the map of its row's boundary and agent: resolved on distinct pairs and joined back."""
    agent = F.coalesce(F.nullif(F.col(f"`{ctx.agent_col}`"), F.lit("")), F.lit("default")) if ctx.agent_col else F.lit(ctx.agent or "default")
    key = F.col(f"`{ctx.boundary_col}`") if ctx.boundary_col else F.lit(P.boundary_key(ctx.boundary))
    df = df.withColumn("_check_key", key).withColumn("_check_agent", agent)
    triples = df.select(F.col("_check_key").alias("boundary_key"), F.col("_check_agent").alias("agent")).distinct().withColumn("entity", F.explode(F.array(*[F.lit(e) for e in _known(ctx)])))
    resolved = P.resolve(triples, ctx.policy).groupBy("boundary_key", "agent").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("action", "format", "rule")))).alias("_check_rules"))
    return df.join(resolved.withColumnsRenamed({"boundary_key": "_check_key", "agent": "_check_agent"}), ["_check_key", "_check_agent"], "left")


def check(df: DataFrame, text_col: str, ctx: Context) -> DataFrame:
    """All columns of `df`, and output, blocked, block_entity, block_rule, block_message, decisions, puts.

    `output` is null where the row is blocked. `puts` are the vault records to insert. A null text passes unchanged with no decision. Without row-wise boundaries or
    agents nothing is shuffled or joined. A column of `df` that has the name of a result gives way to it; names that begin with `_check_` are for the check alone.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in RESULTS]
    df, recognizers = columns_first(df, text_col, ctx.recognizers or builtin())
    if ctx.boundary_col or ctx.agent_col:
        rows, rules, key, agent = _joined_rules(df, ctx), F.col("_check_rules"), F.col("_check_key"), F.col("_check_agent")
    else:
        rows, rules, key, agent = df, _literal_rules(ctx), F.lit(P.boundary_key(ctx.boundary)), F.lit(ctx.agent or "default")
    workflow = F.coalesce(F.nullif(F.col(f"`{ctx.workflow_col}`"), F.lit("")), F.lit("default")) if ctx.workflow_col else F.lit(ctx.workflow)
    text = F.col(f"`{text_col}`")
    as_mask = ctx.apply_block_as == "mask"
    pads = F.lit(0) if ctx.master is None else K.workflow_pads(ctx.master, ctx.workflow, workflow if ctx.workflow_col else None)
    result = let(
        detect(text, recognizers, ctx.threshold),
        lambda s: F.when(F.size(s) > 0, let(pads, lambda w: let(_decided(s, rules, ctx.strict), lambda items: _applied(text, items, key, agent, workflow, w, as_mask, ctx)))),
    )
    rows = rows.withColumn("_check_r", result)
    touched = F.col("_check_r").isNotNull()
    blocked = touched & F.col("_check_r.blocked")
    message = F.concat(F.lit("Blocked by data policy: "), F.col("_check_r.first.entity"), F.lit(" may not be sent to "), key, F.lit(" (rule: "), F.col("_check_r.first.rule"), F.lit(")"))
    return rows.select(
        *kept,
        F.when(blocked, F.lit(None).cast("string")).when(touched, F.col("_check_r.output")).otherwise(text).alias("output"),
        F.coalesce(blocked, F.lit(False)).alias("blocked"),
        F.when(blocked, F.col("_check_r.first.entity")).alias("block_entity"),
        F.when(blocked, F.col("_check_r.first.rule")).alias("block_rule"),
        F.when(blocked, message).alias("block_message"),
        F.coalesce(F.col("_check_r.decisions"), F.array().cast(f"array<{DECISION}>")).alias("decisions"),
        F.when(blocked | ~touched, F.array().cast(f"array<{PUT}>")).otherwise(F.col("_check_r.puts")).alias("puts"),
    )


def _decided(found: Column, rules: Column, strict: bool) -> Column:
    items = F.transform(
        found,
        lambda s: let(rules[s["entity"]], lambda r: F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["path"].alias("path"), s["value"].alias("value"), r["action"].alias("action"), r["format"].alias("format"), r["rule"].alias("rule")).cast(DECIDED)),
    )
    return let(items, lambda i: collapse(i, P.rank, strict))


def _applied(text: Column, items: Column, key: Column, agent: Column, workflow: Column, pads: Column, as_mask: bool, ctx: Context) -> Column:
    blocks = F.filter(items, lambda s: s["action"] == "block")

    def decision(s: Column) -> Column:
        return F.struct(
            s["action"].alias("action"), s["entity"].alias("entity"), key.alias("boundary_key"), P.kind_column(key).alias("boundary_kind"), agent.alias("agent"), s["rule"].alias("rule"), s["path"].alias("path"),
            s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("content_hash"), F.when((s["action"] == "block") & F.lit(as_mask), F.lit("mask")).alias("applied_as"),
        ).cast(DECISION)

    ordered = F.transform(F.array_sort(F.transform(items, lambda s, i: F.struct(s["start"].alias("start"), s["path"].alias("path"), i.alias("i"), s.alias("s")))), lambda x: decision(x["s"]))
    if ctx.master is None:
        wanted = F.lit(False)
        token = lambda s: K.mask(s["entity"])
        needs = F.exists(items, lambda s: s["action"] == "tokenize")
        guard = F.when(needs & F.lit(_tokenizes(ctx)), F.raise_error(F.lit("a master key is needed to tokenize"))).otherwise(F.lit(""))
    else:
        wanted, guard = F.lit(True), F.lit("")
        token = lambda s: K.replacement(s["entity"], K.token_id(pads, s["entity"], s["value"]), s["format"], s["value"])
    pieces = F.transform(
        F.filter(items, lambda s: s["action"].isin("mask", "tokenize") | ((s["action"] == "block") & F.lit(as_mask))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), s["action"].alias("action"), s["value"].alias("value"), F.when(s["action"] == "tokenize", token(s)).otherwise(K.mask(s["entity"])).alias("replacement")),
    )

    def finish(p: Column) -> Column:
        puts = F.transform(F.filter(p, lambda x: (x["action"] == "tokenize") & wanted), lambda x: F.struct(workflow.alias("workflow_id"), x["replacement"].alias("token"), x["entity"].alias("entity"), x["value"].alias("value"))).cast(f"array<{PUT}>")
        first = F.element_at(F.array_sort(F.transform(blocks, lambda s: F.struct(s["start"].alias("start"), s["entity"].alias("entity"), s["rule"].alias("rule")))), 1)
        stop = (F.size(blocks) > 0) & F.lit(not as_mask)
        return F.struct(F.when(~stop, F.concat(guard, splice(text, p))).alias("output"), stop.alias("blocked"), F.when(F.size(blocks) > 0, first).alias("first"), ordered.alias("decisions"), puts.alias("puts"))

    return let(pieces, finish)


def _tokenizes(ctx: Context) -> bool:
    return any(r[9] == "tokenize" for r in P.compile_policy(ctx.policy))


def check_pair(df: DataFrame, args_col: str, result_col: str, tool: str, ctx: Context) -> DataFrame:
    """A tool call's arguments, checked as they go out, and its result, checked as it comes in: suffixed _out and _in."""
    from dataclasses import replace

    names = ("output", "blocked", "block_entity", "block_rule", "block_message", "decisions", "puts")
    for col, direction in ((args_col, "out"), (result_col, "in")):
        own = replace(ctx, boundary={"kind": "tool", "name": tool, "direction": direction}, boundary_col=None)
        df = check(df, col, own).withColumnsRenamed({n: f"{n}_{direction}" for n in names})
    return df


def decisions(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One row a decision; fields that share a name with a key are left out."""
    rows = checked.select(*[F.col(f"`{k}`") for k in keys], F.explode("decisions").alias("d"))
    fields = [f.name for f in rows.schema["d"].dataType.fields if f.name not in keys]
    return rows.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"d.{f}") for f in fields])
