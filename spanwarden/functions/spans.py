"""Span arrays as column expressions: finding matches with offsets, merging, collapsing, splicing.

Offsets count characters from 0, end excluded. No step leaves the row, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import DEFAULT_THRESHOLD

MATCH = "array<struct<start:int,end:int,value:string>>"
SPAN = "struct<entity:string,start:int,end:int,confidence:double,recognizer:string,path:string,value:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def find(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches of a pattern, in order; matches without a character are left out.

    One pass of the pattern puts marks around its matches, and the text is cut at the marks: every second piece is a match, and the lengths add up to
    offsets. Marks that the text itself holds are exchanged first, one character for one. `hint` is a text that every match holds: a search for it settles most
    rows, and one for the pattern most others.
    """
    dirty = text.rlike("[\x01\x02]")
    clean = F.translate(text, "\x01\x02", "")

    def fold(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(MATCH).alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.length(piece)
            value = F.when(dirty, F.substring(text, acc["at"] + 1, F.length(piece))).otherwise(piece)
            one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), value.alias("value")))
            return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"] & (piece != ""), F.concat(acc["out"], one)).otherwise(acc["out"]).cast(MATCH).alias("out"))

        return F.aggregate(pieces, zero, step, lambda acc: acc["out"])

    marked = F.regexp_replace(clean, F.lit(f"({pattern})"), F.lit("\x01$1\x02"))
    some = text.rlike(pattern) if hint is None else text.contains(hint) & text.rlike(pattern)
    return F.when(some, fold(F.split(marked, "[\x01\x02]", -1))).otherwise(F.array().cast(MATCH))


def spans(matches: Column, entity: str, confidence: float, recognizer: str | None = None) -> Column:
    """Spans of one class from matches."""
    return F.transform(
        matches,
        lambda m: F.struct(F.lit(entity).alias("entity"), m["start"].alias("start"), m["end"].alias("end"), F.lit(float(confidence)).alias("confidence"), F.lit(recognizer or entity).alias("recognizer"), F.lit("").alias("path"), m["value"].alias("value")),
    ).cast(SPANS)


def merge(found: Column, text: Column, threshold: float = DEFAULT_THRESHOLD, thresholds: dict[str, float] | None = None) -> Column:
    """Drop spans below their class's threshold; unite spans of one class (and path) that overlap by a character or more.

    The union has the greatest confidence and the first span's recognizer. Touching spans stay apart, and so do classes. Sorted by start and end.
    """

    def least(s: Column) -> Column:
        out = F.lit(threshold)
        for entity, value in (thresholds or {}).items():
            out = F.when(s["entity"] == entity, F.lit(value)).otherwise(out)
        return out

    def union(kept: Column) -> Column:
        keyed = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["path"].alias("path"), s["entity"].alias("entity"), s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["confidence"].alias("confidence"), s["recognizer"].alias("recognizer"), s["value"].alias("value"))))

        def step(acc: Column, s: Column) -> Column:
            one = F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"), s["recognizer"].alias("recognizer"), s["path"].alias("path"), s["value"].alias("value")).cast(SPAN)
            last = F.element_at(acc, -1)
            overlaps = (F.size(acc) > 0) & (last["entity"] == s["entity"]) & (last["path"] == s["path"]) & (s["start"] < last["end"])
            end = F.greatest(last["end"], s["end"])
            joined = F.struct(last["entity"].alias("entity"), last["start"].alias("start"), end.alias("end"), F.greatest(last["confidence"], s["confidence"]).alias("confidence"), last["recognizer"].alias("recognizer"), last["path"].alias("path"), F.substring(text, last["start"] + 1, end - last["start"]).alias("value")).cast(SPAN)
            return F.when(overlaps, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(one))).cast(SPANS)

        return F.aggregate(keyed, F.array().cast(SPANS), step)

    def by_place(merged: Column) -> Column:
        order = F.array_sort(F.transform(merged, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s.alias("s"))))
        return F.transform(order, lambda x: x["s"]).cast(SPANS)

    kept = F.filter(found, lambda s: s["confidence"] >= least(s))
    return F.when(F.size(kept) > 1, let(union(kept), by_place)).otherwise(kept)


DECIDED = "struct<entity:string,start:int,end:int,path:string,value:string,action:string,format:string,rule:string>"


def collapse(items: Column, rank: Callable[[Column], Column], strict: bool = False) -> Column:
    """Resolve overlaps of different classes. Items (DECIDED) are taken by start, longer first; each is compared with the first kept item that it
    overlaps, and replaces it if its action is more restrictive. With `strict` the survivor covers both.
    """
    kind = f"array<{DECIDED}>"
    order = F.array_sort(F.transform(items, lambda s, i: F.struct(s["path"].alias("path"), s["start"].alias("start"), (-s["end"]).alias("e"), i.alias("i"), s.alias("s"))))

    def step(kept: Column, x: Column) -> Column:
        s = x["s"]
        hits = F.transform(kept, lambda k: (k["path"] == s["path"]) & (s["start"] < k["end"]) & (s["end"] > k["start"]))
        at = F.array_position(hits, F.lit(True))

        def settle(k: Column) -> Column:
            # Equal ranks with different actions go to the later item.
            wins = (s["action"] != k["action"]) & (rank(s["action"]) >= rank(k["action"]))
            winner = F.when(wins, s).otherwise(k)
            if not strict:
                return winner
            fields = [winner[f].alias(f) for f in ("entity",)] + [F.least(s["start"], k["start"]).alias("start"), F.greatest(s["end"], k["end"]).alias("end")]
            return F.struct(*fields, *[winner[f].alias(f) for f in ("path", "value", "action", "format", "rule")]).cast(DECIDED)

        return F.when(at == 0, F.concat(kept, F.array(s))).otherwise(F.transform(kept, lambda k, i: F.when(i == at.cast("int") - 1, settle(k)).otherwise(k))).cast(kind)

    return F.when(F.size(items) > 1, F.aggregate(order, F.array().cast(kind), step)).otherwise(items)


def splice(text: Column, pieces: Column) -> Column:
    """The text with each piece (start, end, replacement; disjoint) put in, from left to right."""
    ordered = F.array_sort(F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["replacement"].alias("replacement"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.struct(p["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["replacement"]).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def utf16(text: Column, offset: Column) -> Column:
    """A character offset in UTF-16 code units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")
