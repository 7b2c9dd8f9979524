"""Detection: recognizers as column expressions, in registration order, then the merge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions.spans import MATCH, SPANS, find, let, merge, spans

MAX_CUSTOM = 16


class RecognizerError(ValueError):
    """A recognizer that cannot be registered."""


@dataclass(frozen=True)
class Recognizer:
    """`scan` maps a text column to an array of spans; `entities` are the classes it may give."""

    id: str
    entities: tuple[str, ...]
    scan: Callable[[Column], Column]
    tier: int = 0
    python: bool = False  # the scan runs Python, which cannot stand inside a lambda: `check` makes it a column first


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def email(text: Column) -> Column:
    return spans(find(text, C.EMAIL, "@"), "email", 1.0)


def phone(text: Column) -> Column:
    def enough(m: Column) -> Column:
        return F.filter(m, lambda x: F.length(_digits(x["value"])).between(7, 15))

    return F.concat(spans(enough(find(text, C.PHONE_INTERNATIONAL, "+")), "phone", 1.0), spans(enough(find(text, C.PHONE_NATIONAL)), "phone", 0.8))


def credit_card(text: Column) -> Column:
    return spans(F.filter(find(text, C.CREDIT_CARD), lambda m: F.call_function("luhn_check", _digits(m["value"]))), "credit_card", 1.0)


def iban_valid(value: Column) -> Column:
    """Mod-97 of the rearranged digits, letters counting 10 to 35."""
    compact = F.upper(F.regexp_replace(value, f"[{C.WS}]", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)))
    return compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (rest == 1)


def iban(text: Column) -> Column:
    return spans(F.filter(find(text, C.IBAN), lambda m: iban_valid(m["value"])), "iban", 1.0)


def ssn_valid(digits: Column) -> Column:
    area = F.substring(digits, 1, 3).cast("int")
    return (area != 0) & (area != 666) & (area < 900) & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")


def ssn(text: Column) -> Column:
    written = F.filter(find(text, C.SSN_FORMATTED, "-"), lambda m: ssn_valid(_digits(m["value"])))

    def near(words: Column) -> Column:
        return F.filter(find(text, C.SSN_PLAIN), lambda m: ssn_valid(m["value"]) & F.exists(words, lambda w: (m["start"] - w["end"]).between(0, C.SSN_WINDOW)))

    plain = F.when(text.rlike(C.SSN_CONTEXT), let(find(text, C.SSN_CONTEXT), near)).otherwise(F.array().cast(MATCH))
    return F.concat(spans(written, "ssn", 1.0), spans(plain, "ssn", 0.8))


def ipv4_canonical(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | ~o.startswith("0")))


def ipv4_reserved(value: Column) -> Column:
    """Private, loopback, link-local, shared, documentation, benchmark, multicast and reserved ranges."""
    o = [F.get(F.split(value, r"\."), i).cast("int") for i in range(3)]
    # The ranges.
    return (
        o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 100) & o[1].between(64, 127))
        | ((o[0] == 192) & (o[1] == 0) & (o[2] == 2)) | ((o[0] == 198) & o[1].isin(18, 19)) | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100)) | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    )


def ipv6_valid(value: Column) -> Column:
    """Eight groups of one to four hexadecimal digits, or up to seven and one `::` for the others; or an embedded version 4 address."""
    sides = F.split(value, "::", -1)
    groups = F.flatten(F.transform(sides, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))))
    plain = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & F.when(F.size(sides) == 1, F.size(groups) == 8).otherwise((F.size(sides) == 2) & (F.size(groups) <= 7))
    tail = F.element_at(F.split(value, ":", -1), -1)
    return F.when(value.rlike(C.IPV6_EMBEDDED), ipv4_canonical(tail)).otherwise(plain)


def ipv6_reserved(value: Column) -> Column:
    return F.lower(value).rlike("^(?:::1?$|fe[89ab]|f[cdf]|2001:db8)")


def ip_address(text: Column, include_private: bool = False) -> Column:
    four = F.filter(find(text, C.IPV4, "."), lambda m: ipv4_canonical(m["value"]) & (F.lit(include_private) | ~ipv4_reserved(m["value"])))
    six = F.filter(find(text, C.IPV6, ":"), lambda m: ipv6_valid(m["value"]) & (F.lit(include_private) | ~ipv6_reserved(m["value"])))
    return F.concat(spans(four, "ip_address", 1.0), spans(six, "ip_address", 1.0))


def ipv4_only(text: Column) -> Column:
    """Public version 4 addresses, under the class's name."""
    return spans(F.filter(find(text, C.IPV4, "."), lambda m: ipv4_canonical(m["value"]) & ~ipv4_reserved(m["value"])), "ip_address", 1.0)


def url_credentials(text: Column) -> Column:
    return spans(find(text, C.URL_CREDENTIALS, "://"), "url_credentials", 1.0)


def api_key(text: Column) -> Column:
    return F.concat(spans(find(text, C.API_KEY), "api_key", 1.0), spans(find(text, C.PUBLISHABLE_KEY, "pk_live_"), "api_key", 0.6))


def jwt_header_valid(value: Column) -> Column:
    """The first segment decodes to an object with a non-empty string alg; typ, if a string, is JWT."""
    segment = F.translate(F.substring_index(value, ".", 1), "-_", "+/")
    padded = F.concat(segment, F.when(F.length(segment) % 4 == 2, F.lit("==")).when(F.length(segment) % 4 == 3, F.lit("=")).otherwise(F.lit("")))
    header = F.try_parse_json(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    alg, kind = F.try_variant_get(header, "$.alg", "string"), F.try_variant_get(header, "$.typ", "string")
    is_text = F.schema_of_variant(F.try_variant_get(header, "$.alg", "variant")) == "STRING"
    kind_is_text = F.schema_of_variant(F.try_variant_get(header, "$.typ", "variant")) == "STRING"
    return F.coalesce(is_text & (F.length(alg) > 0) & (~F.coalesce(kind_is_text, F.lit(False)) | (F.upper(kind) == "JWT")), F.lit(False))


def jwt(text: Column) -> Column:
    return spans(F.filter(find(text, C.JWT, "eyJ"), lambda m: jwt_header_valid(m["value"])), "jwt", 1.0)


def private_key(text: Column) -> Column:
    return spans(find(text, C.PRIVATE_KEY, "-----BEGIN "), "private_key", 1.0)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.length(value)

    def term(c: Column) -> Column:
        p = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)


def high_entropy_secret(text: Column) -> Column:
    def gate(words: Column) -> Column:
        def ok(m: Column) -> Column:
            v = m["value"]
            rich = v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
            near = F.exists(words, lambda w: (m["start"] - w["end"]).between(0, C.HIGH_ENTROPY_WINDOW))
            before = F.substring(text, F.greatest(m["start"] - 3, F.lit(1)), F.least(m["start"], F.lit(4)))
            return rich & (near | before.rlike("[=:] ?[\"'`]$")) & (entropy(v) > C.HIGH_ENTROPY_BITS)

        return F.filter(find(text, C.HIGH_ENTROPY), ok)

    return spans(F.when(text.rlike(C.HIGH_ENTROPY), let(find(text, C.HIGH_ENTROPY_CONTEXT), gate)).otherwise(F.array().cast(MATCH)), "high_entropy_secret", 0.9)


def connection_string(text: Column) -> Column:
    return spans(find(text, C.CONNECTION_STRING), "connection_string", 1.0)


def builtin(include_private: bool = False) -> tuple[Recognizer, ...]:
    """Tier 0, in registration order: secrets, then structured classes, then addresses."""
    plain = (api_key, jwt, private_key, high_entropy_secret, connection_string, email, phone, credit_card, iban, ssn, url_credentials)
    return (*(Recognizer(f.__name__, (f.__name__,), f) for f in plain), Recognizer("ip_address", ("ip_address",), lambda t: ip_address(t, include_private)))


def register(custom: tuple[Recognizer, ...] = (), include_private: bool = False) -> tuple[Recognizer, ...]:
    """Built-in and then custom recognizers; at most MAX_CUSTOM custom ones, ids distinct."""
    if len(custom) > MAX_CUSTOM:
        raise RecognizerError(f"at most {MAX_CUSTOM} custom recognizers")
    every = (*builtin(include_private), *custom)
    ids = [r.id for r in every]
    for name in ids:
        if ids.count(name) > 1:
            raise RecognizerError(f"duplicate recognizer id {name}")
    return every


def detect(text: Column, recognizers: tuple[Recognizer, ...] | None = None, threshold: float = C.DEFAULT_THRESHOLD, thresholds: dict[str, float] | None = None) -> Column:
    """Merged spans of a text column; null and empty texts have none."""
    own = F.coalesce(text, F.lit(""))

    def run(t: Column) -> Column:
        found = F.concat(*[r.scan(t) for r in (recognizers or builtin())])
        return let(found, lambda s: merge(s, t, threshold, thresholds))

    return let(own, run).cast(SPANS)


def columns_first(df: DataFrame, text_col: str, recognizers: tuple[Recognizer, ...]) -> tuple[DataFrame, tuple[Recognizer, ...]]:
    """`df` with a column of spans for each recognizer that runs Python, and the recognizers with those columns as their scans."""
    out, ready = df, []
    for i, r in enumerate(recognizers):
        if r.python:
            name = f"_spans_{i}"
            while name in df.columns:
                name = f"_{name}"
            out = out.withColumn(name, r.scan(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
            r = replace(r, scan=lambda _, name=name: F.col(name), python=False)
        ready.append(r)
    return out, tuple(ready)


def detections(df: DataFrame, text_col: str, keys: list[str], **options) -> DataFrame:
    """One row a span: the key columns, ordinal, and the span's fields. Nothing is shuffled."""
    found = df.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(detect(F.col(f"`{text_col}`"), **options)).alias("ordinal", "s"))
    return found.select(*keys, "ordinal", "s.*")


def entity_spans(df: DataFrame, text_col: str, keys: list[str], scan: Callable[[Column], Column]) -> DataFrame:
    """The merged spans of one recognizer."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(let(scan(text), lambda s: merge(s, text))).alias("s"))
    return found.select(*keys, "s.*")


def merge_rows(found: DataFrame, keys: list[str], threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """The merge for spans that are rows already (keys, entity, start, end, confidence): gaps and islands by class.

    One shuffle by keys and class; a group is one class's spans in one text.
    """
    order = Window.partitionBy(*keys, "entity").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = found.where(F.col("confidence") >= threshold).withColumn("_new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    islands = kept.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "entity", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence")).drop("_island")
