"""Rule-based quality filter as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column that is true where a text is rejected. On a bounded sample the cascade times every rule and counts
what it rejects, and orders rules by rejections per second of cost; the plan then tests them in that order in one CASE, which
stops at the first that rejects. The order changes what a row costs, never its verdict, which is the conjunction of all rules.

The metrics that rules share are computed once a row. They need no shuffle: repeated three-word windows are found inside the row by
sorting (hash bits, position) packed in one long, whose neighbours are then compared word by word.

Defined cases: a null text has no words, so its counts are 0 and it is rejected; repeated rows are judged each; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_RE, documents

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
SAMPLE_ROWS = 2_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once a row however often the body names it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(words: Column, count: Column) -> Column:
    """Words in windows that occur twice or more, for at least WINDOW words."""

    def at(position: Column, k: int) -> Column:
        return F.get(words, position.cast("int") + k)

    def same_words(a: Column, b: Column) -> Column:
        return (at(a, 0) == at(b, 0)) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2))

    def with_mask(mask: Column) -> Column:
        high = F.bitwise_not(mask)
        packed = F.transform(F.slice(words, F.lit(1), count - (WINDOW - 1)), lambda word, i: F.xxhash64(word, at(i, 1), at(i, 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def repeated(keys: Column) -> Column:
            def twin(x: Column, other: Column) -> Column:
                return F.coalesce((x.bitwiseAND(high) == other.bitwiseAND(high)) & same_words(x.bitwiseAND(mask), other.bitwiseAND(mask)), F.lit(False))

            found = F.filter(keys, lambda x, i: twin(x, F.get(keys, i - 1)) | twin(x, F.get(keys, i + 1)))
            starts = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("at"))
            return F.aggregate(starts, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])

        return let(F.sort_array(packed), repeated)

    bits = F.length(F.bin(count.cast("long")))
    return let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, with_mask)


def metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return let(F.size(words), lambda n: F.struct(n.cast("long").alias("n_words"), F.when(n >= WINDOW, _windows(words, n)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    word_part = let(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)), of_words)
    line_part = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE)), of_lines)
    return let(
        word_part,
        lambda w: let(
            line_part,
            lambda line: F.struct(
                w["n_words"].alias("n_words"),
                (F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                line["n_lines"].alias("n_lines"),
                line["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
            ),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """`rejects(text, metrics)` is true where the text is to go."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: n_words < 50, or over half of the words in repeated windows: these two are the base verdict.
BASE = Rule("base", lambda t, m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]))
RULES = (
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda t, m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("duplicate_lines", lambda t, m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("letters", lambda t, m: 10 * F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")) < 7 * m["n_words"]),
    Rule("digits", lambda t, m: 10 * F.regexp_count(t, F.lit("[0-9]")) > 3 * m["word_chars"]),
    Rule("ellipsis_lines", lambda t, m: 10 * F.regexp_count(t, F.lit(r"(\.\.\.|…)[\x20\x09\x0D]*(\n|\z)")) > 3 * m["n_lines"]),
    Rule("bullet_lines", lambda t, m: 10 * F.regexp_count(t, F.lit(r"(\A|\n)[\x20\x09]*[-•*][\x20\x09]")) > 9 * m["n_lines"]),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds) by rejections per cost, best first, measured on a sample of about `sample_rows` rows.

    The sample only sets the order of evaluation. It is bounded whatever the size of the table.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("t"))
    total = rows.count()
    sample = rows.sample(min(1.0, sample_rows / max(1, total)), seed=7).select("t", metrics(F.col("t")).alias("m")).persist()
    try:
        n = max(1, sample.count())

        def measure(column: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.count(F.when(column, 1))).first()[0]
            return time.perf_counter() - began, hits

        idle = min(measure(F.lit(False))[0] for _ in range(2))
        found = []
        for rule in rules:
            runs = [measure(rule.rejects(F.col("t"), F.col("m"))) for _ in range(2)]
            found.append((rule, runs[0][1] / n, max(1e-4, min(r[0] for r in runs) - idle)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of `docs`, and a struct column `quality`: the metrics, base_failed, kept. Rules run in the measured order."""
    ordered = [BASE] + [r for r, _, _ in order_rules(docs, rules, text_col, sample_rows)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def verdict(m: Column) -> Column:
        chain = F.when(ordered[0].rejects(text, m), F.lit(False))
        for rule in ordered[1:]:
            chain = chain.when(rule.rejects(text, m), F.lit(False))
        fields = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
        return F.struct(*[m[f].alias(f) for f in fields], BASE.rejects(text, m).alias("base_failed"), chain.otherwise(F.lit(True)).alias("kept"))

    return docs.withColumn("quality", let(metrics(text), verdict))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = cascade(documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("doc_id", *[f"quality.{f}" for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM ws),
tri AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
m AS (
  SELECT d.doc_id, t, len(w)::BIGINT AS n_words,
    (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ws USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
    OR 10 * len(regexp_extract_all(t, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 7 * n_words
    OR 10 * len(regexp_extract_all(t, '[0-9]')) > 3 * word_chars
    OR 10 * len(regexp_extract_all(t, '(\.\.\.|…)[\x20\x09\x0D]*(\n|\z)')) > 3 * n_lines
    OR 10 * len(regexp_extract_all(t, '(\A|\n)[\x20\x09]*[-•*][\x20\x09]')) > 9 * n_lines AS rule_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM b
"""
