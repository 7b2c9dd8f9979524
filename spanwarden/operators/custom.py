"""Custom recognizers: safety rules for patterns, pattern recognizers, vectorised functions, and a table function for SQL."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions.spans import SPANS, find, spans
from .detect import Recognizer, RecognizerError, builtin, columns_first, detect

# Limits on pattern sources.
MAX_SOURCE, MAX_REPEAT = 512, 64
_failed: set[str] = set()
_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}\Z")


def _tokens(source: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a pattern: open, close, class, repeat, escape, char."""
    parts = re.compile(
        r"(?P<escape>\\(?:k<[^>]*>|k'[^']*'|.))|(?P<klass>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<open>\((?:\?(?:<[=!]|[=!:>]|P?<[^>]*>|[a-z-]*:)?)?)|(?P<close>\))|(?P<repeat>[*+?]\??|\{\d*,?\d*\}\??)|(?P<char>.)",
        re.S,
    )
    for m in parts.finditer(source):
        yield m.lastgroup, m.group()


def _upper(repeat: str) -> float:
    """The most times that a quantifier repeats."""
    if repeat[0] in "*+":
        return float("inf")
    if repeat[0] == "?":
        return 1
    low, comma, high = repeat.strip("?").strip("{}").partition(",")
    return float(high) if high else float("inf") if comma else float(low or 0)


def validate_pattern(source: str, index: int = 0) -> None:
    """Raise RecognizerError, which names the rule and never the source, unless the pattern is safe to run on any text.

    Rules: at most 512 characters; no back-references; no quantified group that holds a quantifier; on groups, no unbounded quantifier
    or bound above 64, and no brace bound above 64 anywhere; no quantifier inside a look-behind.
    """

    def refuse(rule: str):
        raise RecognizerError(f"pattern {index}: {rule}")

    if len(source) > MAX_SOURCE:
        refuse(f"longer than {MAX_SOURCE} characters")
    found = list(_tokens(source))
    if any(kind == "escape" and re.match(r"\\[1-9k]", text) for kind, text in found):
        refuse("it refers back to a group")
    groups: list[list] = []  # [is a look-behind, holds a quantifier]
    closed = None
    for kind, text in found:
        if kind == "repeat":
            upper = _upper(text)
            if any(g[0] for g in groups):
                refuse("it repeats something inside a look-behind")
            if closed is not None:
                if closed[1]:
                    refuse("a repeated group repeats something itself")
                if upper > MAX_REPEAT:
                    refuse(f"more than {MAX_REPEAT} repeats, or no bound on a group's repeats")
            elif text[0] == "{" and upper > MAX_REPEAT:
                refuse(f"more than {MAX_REPEAT} repeats, or no bound on a group's repeats")
            for g in groups:
                g[1] = True
        closed = None
        if kind == "open":
            groups.append([text.startswith("(?<=") or text.startswith("(?<!"), False])
        elif kind == "close" and groups:
            closed = groups.pop()
            if closed[1] and groups:
                groups[-1][1] = True


def validate_entity(name: str) -> None:
    if not _NAME.match(name):
        raise RecognizerError("entity names are lower-case words of up to 64 characters")
    if name in C.SECRETS + C.PII + C.NER:
        raise RecognizerError("that is a built-in class")


def pattern_recognizer(entity: str, patterns: list[str], confidence: float = 0.8, recognizer_id: str | None = None) -> Recognizer:
    """A class of its own from patterns in the JVM's dialect without capturing groups; at most 256 matches a pattern and text."""
    validate_entity(entity)
    for i, p in enumerate(patterns):
        validate_pattern(p, i)

    def scan(text: Column) -> Column:
        return F.concat(*[spans(F.slice(find(text, p), 1, C.MAX_MATCHES), entity, confidence, recognizer_id or entity) for p in patterns])

    return Recognizer(recognizer_id or entity, (entity,), scan)


def from_config(items: list[dict]) -> tuple[Recognizer, ...]:
    """Recognizers from configuration: objects with entity, patterns and perhaps confidence and id."""
    return tuple(pattern_recognizer(x["entity"], x["patterns"], x.get("confidence", 0.8), x.get("id")) for x in items)


def function_recognizer(recognizer_id: str, entities: tuple[str, ...], scan: Callable[[str], list[tuple[str, int, int, float]]], tier: int = 0) -> Recognizer:
    """Spans from a Python function of one text, run in Arrow batches. A text on which it fails has none: detection goes on without it."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return [{"entity": e, "start": s, "end": t, "confidence": c, "recognizer": recognizer_id, "path": "", "value": text[s:t]} for e, s, t, c in scan(text or "")]
            except Exception as failure:  # noqa: BLE001  a failing recognizer is left out, the others go on
                if recognizer_id not in _failed:  # once a worker, by its id and never with the text
                    _failed.add(recognizer_id)
                    logging.getLogger(__name__).warning("recognizer %s failed: %s", recognizer_id, type(failure).__name__)
                return []

        return texts.map(one)

    return Recognizer(recognizer_id, entities, run, tier, python=True)


def detect_with_functions(df, text_col: str, recognizers: tuple[Recognizer, ...]):
    """`df` with column `spans`: built-in and custom expressions and functions together, merged."""
    rows, ready = columns_first(df, text_col, (*builtin(), *recognizers))
    return rows.withColumn("spans", detect(F.col(f"`{text_col}`"), ready)).select(*[F.col(f"`{c}`") for c in df.columns if c != "spans"], "spans")


def register_table_function(spark: SparkSession, name: str = "scan_spans", patterns: dict[str, str] | None = None) -> None:
    """A SQL table function: `SELECT * FROM t, LATERAL scan_spans(t.text)` gives entity, start, end of pattern matches."""
    wanted = patterns or {"email": C.EMAIL}

    class Scan:
        def __init__(self):
            self.compiled = {e: re.compile(p, re.ASCII) for e, p in wanted.items()}

        def eval(self, text: str):
            for entity, pattern in self.compiled.items():
                for m in pattern.finditer(text or ""):
                    if m.end() > m.start():
                        yield entity, m.start(), m.end()

    spark.udtf.register(name, F.udtf(Scan, returnType="entity string, start int, end int"))
