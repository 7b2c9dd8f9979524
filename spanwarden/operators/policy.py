"""Policies: validation, compilation to a rule table, and resolution of (entity, boundary, agent) triples.

A policy is a plain dict: defaults.action, entities, boundaries (pattern -> entities), identities (agent -> entities, boundaries),
dangerouslyAllowSecrets. Compiled, it is a small table of rules; resolving is a broadcast join of distinct triples with it and a `min_by` over the
order of precedence. The table's size is the policy's, not the data's.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalogue import ACTION_RANK, NER, PII, PRESERVABLE, SECRETS

RULE_SCHEMA = "agent string, scope int, pattern string, kind string, is_glob boolean, pattern_len int, regex string, entity_key string, entity_spec int, action string, format string, allow_secrets boolean, path string"
ACTIONS = ("allow", "mask", "tokenize", "block", "review", "detokenize")


class PolicyError(ValueError):
    """A document that is not a policy; the message names the key path, never a value."""


class ReviewNotImplemented(NotImplementedError):
    """The action `review` has no execution."""


def default_policy() -> dict:
    """Secrets and URLs with credentials are blocked, structured personal data becomes tokens, egress restores, the rest passes."""
    entities = {e: "block" for e in SECRETS} | {e: "tokenize" for e in ("email", "phone", "credit_card", "iban", "ssn")} | {"url_credentials": "block"}
    return {"defaults": {"action": "allow"}, "entities": entities, "boundaries": {"egress:*": {"entities": {"*": "detokenize"}}}}


def recommended_ner_policy(action: str = "tokenize") -> dict:
    """A fragment for the classes that a named-entity model gives; never merged by itself."""
    return {"entities": {e: action for e in NER}}


def kind_of(key: str) -> str:
    for kind in ("tool", "mcp", "egress"):
        if key.startswith(kind + ":"):
            return kind
    return "telemetry" if key == "telemetry" else "model"


def boundary_key(boundary: dict) -> str:
    """The key of a boundary: model -> provider, tool:name:direction, mcp:server/tool, telemetry, egress:sink."""
    kind = boundary["kind"]
    if kind == "model":
        return boundary["provider"]
    if kind == "tool":
        return f"tool:{boundary['name']}:{boundary['direction']}"
    if kind == "mcp":
        return f"mcp:{boundary['server']}/{boundary['tool']}"
    if kind == "egress":
        return f"egress:{boundary['sink']}"
    return "telemetry"


def boundary_key_column(b: Column) -> Column:
    """The same over a struct column with fields kind, provider, name, direction, server, tool, sink."""
    return (
        F.when(b["kind"] == "model", b["provider"])
        .when(b["kind"] == "tool", F.concat(F.lit("tool:"), b["name"], F.lit(":"), b["direction"]))
        .when(b["kind"] == "mcp", F.concat(F.lit("mcp:"), b["server"], F.lit("/"), b["tool"]))
        .when(b["kind"] == "egress", F.concat(F.lit("egress:"), b["sink"]))
        .otherwise(F.lit("telemetry"))
    )


def kind_column(key: Column) -> Column:
    out = F.when(key == "telemetry", F.lit("telemetry"))
    for kind in ("tool", "mcp", "egress"):
        out = out.when(key.startswith(kind + ":"), F.lit(kind))
    return out.otherwise(F.lit("model"))


def glob_regex(pattern: str) -> str:
    """`*` is any run of characters; the rest is literal."""
    return "(?s)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z"


def normalise_rule(rule) -> dict:
    return {"action": rule} if isinstance(rule, str) else dict(rule)


def validate(policy: dict) -> None:
    """Raise PolicyError, with the path of the offending key, unless this is a policy that can be compiled."""

    def closed(value, keys, path):
        if not isinstance(value, dict):
            raise PolicyError(f"{path}: an object is expected")
        for k in value:
            if k not in keys:
                raise PolicyError(f"{path}.{k}: unknown key".lstrip("."))

    def rules(entities, path, egress):
        if not isinstance(entities, dict):
            raise PolicyError(f"{path}: an object is expected")
        for entity, rule in entities.items():
            at = f"{path}.{entity}"
            if isinstance(rule, dict):
                closed(rule, ("action", "format", "dangerouslyAllowSecrets"), at)
            elif not isinstance(rule, str):
                raise PolicyError(f"{at}: an action or an object is expected")
            rule = normalise_rule(rule)
            action(rule.get("action"), at, egress)
            if rule.get("format") not in (None, "preserve", "label"):
                raise PolicyError(f"{at}.format: preserve or label is expected")

    def action(name, path, egress):
        if name not in ACTIONS:
            raise PolicyError(f"{path}: unknown action")
        if name == "review":
            raise ReviewNotImplemented(f"{path}: review is not implemented")
        if name == "detokenize" and not egress:
            raise PolicyError(f"{path}: detokenize is for egress boundaries only")

    def boundaries(found, path):
        if not isinstance(found, dict):
            raise PolicyError(f"{path}: an object is expected")
        for pattern, body in found.items():
            closed(body, ("entities",), f"{path}.{pattern}")
            rules(body.get("entities", {}), f"{path}.{pattern}.entities", kind_of(pattern) == "egress")

    closed(policy, ("version", "defaults", "entities", "boundaries", "identities", "dangerouslyAllowSecrets"), "")
    if "defaults" in policy:
        closed(policy["defaults"], ("action",), "defaults")
        action(policy["defaults"].get("action", "allow"), "defaults.action", False)
    rules(policy.get("entities", {}), "entities", False)
    boundaries(policy.get("boundaries", {}), "boundaries")
    for agent, body in policy.get("identities", {}).items():
        closed(body, ("entities", "boundaries"), f"identities.{agent}")
        rules(body.get("entities", {}), f"identities.{agent}.entities", False)
        boundaries(body.get("boundaries", {}), f"identities.{agent}.boundaries")


def warnings(policy: dict) -> list[str]:
    """Paths of rules that ask to keep the shape of a class that cannot."""
    return [r[12] for r in compile_policy(policy) if r[10] == "preserve" and r[7] not in PRESERVABLE]


def compile_policy(policy: dict) -> list[tuple]:
    """The rule table (RULE_SCHEMA). Scopes: 0 identity and boundary, 1 identity, 2 boundary, 3 entity, 4 default."""
    validate(policy)
    free = bool(policy.get("dangerouslyAllowSecrets"))
    spec = {"block-pii": 1, "*": 2}
    out = []

    def add(agent, scope, pattern, entities, path):
        for entity, raw in entities.items():
            rule = normalise_rule(raw)
            place = (pattern, kind_of(pattern), "*" in pattern, len(pattern), glob_regex(pattern)) if pattern is not None else (None, None, False, 0, None)
            out.append((agent, scope, *place, entity, spec.get(entity, 0), rule["action"], rule.get("format"), free or bool(rule.get("dangerouslyAllowSecrets")), f"{path}.{entity}"))

    for agent, body in policy.get("identities", {}).items():
        for pattern, b in body.get("boundaries", {}).items():
            add(agent, 0, pattern, b.get("entities", {}), f"identities.{agent}.boundaries.{pattern}.entities")
        add(agent, 1, None, body.get("entities", {}), f"identities.{agent}.entities")
    for pattern, b in policy.get("boundaries", {}).items():
        add(None, 2, pattern, b.get("entities", {}), f"boundaries.{pattern}.entities")
    add(None, 3, None, policy.get("entities", {}), "entities")
    out.append((None, 4, None, None, False, 0, None, "*", 2, policy.get("defaults", {}).get("action", "allow"), None, free, "defaults.action"))
    return out


def rule_table(spark: SparkSession, policy: dict) -> DataFrame:
    return spark.createDataFrame(compile_policy(policy), RULE_SCHEMA)


def resolve(triples: DataFrame, policy: dict) -> DataFrame:
    """`triples` (entity, boundary_key, agent; null or empty agents are "default") with action, format and rule.

    The join is with a broadcast table of the policy's rules. Pass distinct triples; their number follows the vocabulary of classes, boundaries and agents.
    """
    rules = F.broadcast(rule_table(triples.sparkSession, policy).alias("r"))
    t = triples.withColumn("_agent", F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("default"))).alias("t")
    applies = (
        (F.col("r.agent").isNull() | (F.col("r.agent") == F.col("t._agent")))
        & (F.col("r.pattern").isNull() | ((F.col("r.kind") == kind_column(F.col("t.boundary_key"))) & F.expr("t.boundary_key rlike r.regex")))
        & ((F.col("r.entity_spec") == 2) | ((F.col("r.entity_spec") == 1) & F.col("t.entity").isin(*PII, *NER)) | ((F.col("r.entity_spec") == 0) & (F.col("r.entity_key") == F.col("t.entity"))))
    )
    order = F.struct("r.scope", F.when(F.col("r.is_glob"), 1).otherwise(0).alias("g"), (-F.col("r.pattern_len")).alias("l"), F.col("r.pattern"), "r.entity_spec")
    rule = F.struct("r.action", "r.format", F.col("r.path").alias("rule"), "r.allow_secrets")
    picked = t.join(rules, applies, "inner").groupBy("t.entity", "t.boundary_key", "t.agent").agg(F.min_by(rule, order).alias("w"), F.min_by(F.when(F.col("r.action") == "block", rule), F.when(F.col("r.action") == "block", order)).alias("b"))
    # A secret may not be let through by a rule without the escape hatch while any block applies.
    guarded = F.col("entity").isin(*SECRETS) & (F.col("w.action") == "allow") & ~F.col("w.allow_secrets") & F.col("b").isNotNull()
    return picked.select("entity", "boundary_key", "agent", *[F.when(guarded, F.col(f"b.{f}")).otherwise(F.col(f"w.{f}")).alias(f) for f in ("action", "format", "rule")])


def resolve_one(rules: list[tuple], entity: str, key: str, agent: str | None) -> tuple[str, str | None, str]:
    """(action, format, rule) of one triple, on the driver; for boundaries that are the same for all rows."""
    agent = agent or "default"

    def applies(r) -> bool:
        if r[0] not in (None, agent) or (r[2] is not None and (r[3] != kind_of(key) or not re.match(r[6].replace(r"\z", r"\Z"), key))):
            return False
        return r[8] == 2 or (r[8] == 1 and entity in PII + NER) or (r[8] == 0 and r[7] == entity)

    found = sorted((r for r in rules if applies(r)), key=lambda r: (r[1], r[4], -r[5], r[2] or "", r[8]))
    best = found[0]
    if entity in SECRETS and best[9] == "allow" and not best[11]:
        best = next((r for r in found if r[9] == "block"), best)
    return best[9], best[10], best[12]


def rank(action: Column) -> Column:
    out = F.lit(0)
    for name, value in ACTION_RANK.items():
        out = F.when(action == name, F.lit(value)).otherwise(out)
    return out


class PolicySource:
    """A policy from a loader, kept after a failure: the last good copy, or the fallback before any. `load` returns (etag, document) or None if unchanged."""

    def __init__(self, load: Callable[[str | None], tuple[str, dict] | None], fallback: dict | None = None):
        self._load, self._etag, self._lock = load, None, threading.Lock()
        self._policy = fallback or default_policy()
        self.failures = 0

    def current(self) -> dict:
        """Poll once and return the policy to use; never raises."""
        with self._lock:
            try:
                if (found := self._load(self._etag)) is not None:
                    validate(found[1])
                    self._etag, self._policy = found
            except Exception:  # noqa: BLE001  a bad document or an unreachable plane keeps the last good copy
                self.failures += 1
            return self._policy


def load_config(text: str) -> dict:
    """A configuration document of version 1 (a policy) or 2 (policy and recognizers), from JSON."""
    data = json.loads(text)
    version = data.get("version", 1)
    if version not in (1, 2):
        raise PolicyError("version: 1 or 2 is expected")
    policy = data.get("policy", {k: v for k, v in data.items() if k not in ("version", "recognizers")}) or default_policy()
    validate(policy)
    return {"version": version, "policy": policy, "recognizers": data.get("recognizers", []) if version == 2 else []}
