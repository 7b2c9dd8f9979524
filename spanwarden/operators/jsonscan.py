"""Schemaless JSON payloads: leaves and keys with pointers, checks, and rebuilding.

Walking and rebuilding a tree of unknown shape is the one place of the engine that runs Python, in Arrow batches.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import check as ck

MAX_DEPTH = 32


def pointer(path: str, part) -> str:
    """RFC 6901: ~ as ~0 and / as ~1."""
    return f"{path}/{str(part).replace('~', '~0').replace('/', '~1')}"


def walk(value, path: str = "", depth: int = 0):
    """(path, is_key, text) of every string leaf and every object key, depth first; nothing below MAX_DEPTH."""
    if isinstance(value, str):
        yield path, False, value
    elif depth < MAX_DEPTH and isinstance(value, list):
        for i, x in enumerate(value):
            yield from walk(x, pointer(path, i), depth + 1)
    elif depth < MAX_DEPTH and isinstance(value, dict):
        for k, x in value.items():
            yield pointer(path, k), True, k
            yield from walk(x, pointer(path, k), depth + 1)


def parse(raw: str) -> tuple[object, bool]:
    """(tree, whether an object of it names a key twice); of such a key the last value counts. ValueError for malformed text."""
    twice = False

    def pairs(found):
        nonlocal twice
        tree = dict(found)
        twice |= len(tree) < len(found)
        return tree

    return json.loads(raw, object_pairs_hook=pairs), twice


def get(value, path: str) -> str | None:
    """The string at a pointer, or None."""
    for part in path.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            value = value[int(part)] if isinstance(value, list) else value[part]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return value if isinstance(value, str) else None


def put(value, path: str, text: str):
    """The tree with the string at a pointer replaced; the root for an empty one."""
    if not path:
        return text
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    node = value
    for p in parts[:-1]:
        node = node[int(p)] if isinstance(node, list) else node[p]
    node[int(parts[-1]) if isinstance(node, list) else parts[-1]] = text
    return value


def checkable(column: Column) -> Column:
    """JSON text that can be checked: null as {}, arrays and primitives wrapped as {"value": ...}."""
    text = F.trim(column)
    return F.when(column.isNull() | (text == "null"), F.lit("{}")).when(text.startswith("{"), text).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}")))


def leaves(df: DataFrame, json_col: str, keys: list[str], whole: bool = False) -> DataFrame:
    """key columns, path, is_key, text: one row a string leaf or object key. Null and malformed payloads have none; with `whole`, a malformed one is a single leaf, path "", and `at` numbers a payload's rows."""
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{json_col}`").cast("string").alias("_json"))

    def run(batches):
        for batch in batches:
            at, place, paths, is_key, texts = [], [], [], [], []
            for i, raw in enumerate(batch.column("_json").to_pylist()):
                try:
                    found = list(walk(parse(raw)[0])) if raw is not None else []
                except (ValueError, RecursionError):
                    found = [("", False, raw)] if whole else []
                for j, (p, k, t) in enumerate(found):
                    at.append(i), place.append(j), paths.append(p), is_key.append(k), texts.append(t)
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            last = [pa.array(place, pa.int32())] if whole else []
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(paths, pa.string()), pa.array(is_key, pa.bool_()), pa.array(texts, pa.string()), *last], names=[*keys, "path", "is_key", "text", *["at"] * whole])

    schema = df.select(*[F.col(f"`{k}`") for k in keys], F.lit("").alias("path"), F.lit(True).alias("is_key"), F.lit("").alias("text"), *[F.lit(0).alias("at")] * whole).schema
    return rows.mapInArrow(run, schema)


def check_json(df: DataFrame, json_col: str, keys: list[str], ctx: ck.Context) -> DataFrame:
    """`df` with output (JSON, null if blocked), blocked, block_entity, block_rule, decisions; leaves are rewritten, key hits are only reported.

    `keys` name rows, and none of path, is_key, text, at. The block reported is the first by place in its leaf, then by the leaf's place in the payload. A malformed payload is checked as one
    text. Of a key that an object names twice the last value counts, and the others leave the output, also where nothing else is rewritten. The leaves of a payload are gathered again by
    key; a payload bounds their number.
    """
    checked = ck.check(leaves(df, json_col, keys, whole=True), "text", ctx)
    touched = checked.where(F.size("decisions") > 0)
    located = F.transform("decisions", lambda d: d.withField("path", F.col("path")))
    start = F.array_min(F.transform(F.filter("decisions", lambda d: d["action"] == "block"), lambda d: d["start"]))
    first = F.min(F.when(F.col("blocked"), F.struct(start.alias("start"), F.col("at"), F.col("block_entity"), F.col("block_rule"))))
    per = touched.groupBy(*keys).agg(
        F.collect_list(F.when(~F.col("is_key") & ~F.col("blocked"), F.struct("path", "output"))).alias("_edits"),
        F.transform(F.array_sort(F.flatten(F.collect_list(F.transform(located, lambda d, i: F.struct(d["start"].alias("start"), F.col("at"), i.alias("i"), d.alias("d")))))), lambda x: x["d"]).alias("decisions"),
        F.max("blocked").alias("blocked"),
        first.alias("_first"),
    )
    names = [c for c in df.columns if c not in ("output", "blocked", "block_entity", "block_rule", "decisions")]
    match = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    joined = df.alias("l").join(per.alias("r"), match, "left")

    def run(batches):
        for batch in batches:
            out = []
            for raw, edits, stop in zip(*(batch.column(c).to_pylist() for c in ("_json", "_edits", "blocked")), strict=True):
                if stop or raw is None:
                    out.append(None if stop else raw)
                    continue
                try:
                    tree, twice = parse(raw)
                except (ValueError, RecursionError):
                    out.append(edits[0]["output"] if edits else raw)
                    continue
                if not edits and not twice:
                    out.append(raw)
                    continue
                for e in edits or ():
                    tree = put(tree, e["path"], e["output"])
                out.append(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
            keep = [c for c in batch.schema.names if c not in ("_json", "_edits")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "output"])

    wide = joined.select(
        *[F.col(f"l.`{c}`") for c in names], F.coalesce("r.blocked", F.lit(False)).alias("blocked"), F.col("r._first.block_entity").alias("block_entity"), F.col("r._first.block_rule").alias("block_rule"),
        F.coalesce("r.decisions", F.array().cast(f"array<{ck.DECISION}>")).alias("decisions"), F.col(f"l.`{json_col}`").cast("string").alias("_json"), F.col("r._edits").alias("_edits"),
    )
    schema = wide.drop("_json", "_edits").withColumn("output", F.lit(None).cast("string")).schema
    return wide.mapInArrow(run, schema)


def json_leaves(spark, d):
    """String leaves and keys of events.props, each wrapped in a nested payload."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit('{"a/b":{"t":["'), "event_type", F.lit('"]},"props":'), "props", F.lit("}")).alias("j"))
    return leaves(e, "j", ["event_id"])


QUERIES = {"json_leaves": json_leaves}
ORACLE = {
    "json_leaves": """WITH k AS (SELECT event_id, event_type, unnest(json_keys(props)) AS key FROM events)
      SELECT event_id, '/a~1b' AS path, true AS is_key, 'a/b' AS text FROM events UNION ALL SELECT event_id, '/a~1b/t', true, 't' FROM events UNION ALL SELECT event_id, '/a~1b/t/0', false, event_type FROM events
      UNION ALL SELECT event_id, '/props', true, 'props' FROM events UNION ALL SELECT event_id, '/props/' || key, true, key FROM k"""
}
