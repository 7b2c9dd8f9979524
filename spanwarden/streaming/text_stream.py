"""Checked text streams: a carry a stream, held back so that a value split across chunks never leaves half checked.

Rows are (stream_id, seq, delta, is_final). Modes: `abort` ends a stream at a block, `redact` masks blocks, `buffer` checks a stream once, at its end.
Patterns run on a window of at most the carry and one chunk, in Python, keyed by stream.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogue as C
from ..functions.tokens import reference_token_id
from ..operators import policy as P

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("stream_id", "seq", "emitted", "status", "entity", "rule", "n_decisions", "puts")
OUTPUT = "stream_id string, seq long, emitted string, status string, entity string, rule string, n_decisions int, puts array<struct<workflow_id:string,token:string,entity:string,value:string>>"
#: Characters before a value that its class may ask for.
CONTEXT = 64
STATE = "carry string, ended boolean"


def emit_end(length: int, spans: list[tuple[int, int]], holdback: int, final: bool) -> int:
    """How much may go out: all at the end, else all but the hold-back, and never a part of a span.

    Pulling the cut back to a span's start may bring it into an earlier span, so this is repeated until none is cut.
    """
    if final:
        return length
    cut = max(0, length - holdback)
    while straddling := [s for s, e in spans if s < cut < e]:
        cut = min(straddling)
    return cut


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _iban(value: str) -> bool:
    compact = re.sub(f"[{C.WS}]", "", value).upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", compact)) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _jwt(value: str) -> bool:
    head = value.split(".")[0]
    try:
        header = json.loads(base64.b64decode(head + "=" * (-len(head) % 4), "-_", validate=True))
    except ValueError:
        return False
    kind = header.get("typ") if isinstance(header, dict) else None
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and bool(header["alg"]) and (not isinstance(kind, str) or kind.upper() == "JWT")


def _ipv4(value: str) -> bool:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return False
    a, b, c = map(int, parts[:3])
    # The ranges that count as private or reserved.
    return not (a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254), (198, 18), (198, 19)) or (a == 172 and 16 <= b <= 31) or (a == 100 and 64 <= b <= 127) or (a, b, c) in ((192, 0, 2), (198, 51, 100), (203, 0, 113)))


def _ipv6(value: str) -> bool:
    if re.match("(?i)(?:::1?$|fe[89ab]|f[cdf]|2001:db8)", value):
        return False
    if re.match(C.IPV6_EMBEDDED, value, re.ASCII):
        return all(int(p) <= 255 and (len(p) == 1 or p[0] != "0") for p in value.rsplit(":", 1)[1].split("."))
    sides = value.split("::")
    groups = [g for s in sides if s for g in s.split(":")]
    return len(sides) <= 2 and all(re.fullmatch("[0-9A-Fa-f]{1,4}", g) for g in groups) and (len(groups) == 8 if len(sides) == 1 else len(groups) <= 7)


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in map(value.count, dict.fromkeys(value)))


def full_detector(threshold: float = C.DEFAULT_THRESHOLD) -> Callable[[str], list[tuple[str, int, int]]]:
    """(entity, start, end) of all built-in classes by the rules of the batch check, for where expressions cannot run. Spans of one class that overlap are united."""
    any_ = lambda _: True
    plain = [
        ("api_key", C.API_KEY, 1.0, any_), ("api_key", C.PUBLISHABLE_KEY, 0.6, any_), ("jwt", C.JWT, 1.0, _jwt), ("private_key", C.PRIVATE_KEY, 1.0, any_), ("connection_string", C.CONNECTION_STRING, 1.0, any_),
        ("email", C.EMAIL, 1.0, any_), ("phone", C.PHONE_INTERNATIONAL, 1.0, lambda v: 7 <= len(_digits(v)) <= 15), ("phone", C.PHONE_NATIONAL, 0.8, lambda v: 7 <= len(_digits(v)) <= 15),
        ("credit_card", C.CREDIT_CARD, 1.0, lambda v: _luhn(_digits(v))), ("iban", C.IBAN, 1.0, _iban), ("ssn", C.SSN_FORMATTED, 1.0, lambda v: _ssn(_digits(v))),
        ("url_credentials", C.URL_CREDENTIALS, 1.0, any_), ("ip_address", C.IPV4, 1.0, _ipv4), ("ip_address", C.IPV6, 1.0, _ipv6),
    ]
    wanted = [(e, re.compile(p, re.ASCII), ok) for e, p, confidence, ok in plain if confidence >= threshold]
    number, about = re.compile(C.SSN_PLAIN, re.ASCII), re.compile(C.SSN_CONTEXT)
    rich, secret = re.compile(C.HIGH_ENTROPY, re.ASCII), re.compile(C.HIGH_ENTROPY_CONTEXT)

    def near(text: str, context: re.Pattern, start: int, window: int) -> bool:
        return any(0 <= start - m.end() <= window for m in context.finditer(text))

    def entropic(text: str, m: re.Match) -> bool:
        v = m.group()
        told = re.search("[=:] ?[\"'`]$", text[max(0, m.start() - 4) : m.start()]) or near(text, secret, m.start(), C.HIGH_ENTROPY_WINDOW)
        return bool(told) and all(re.search(c, v) for c in ("[a-z]", "[A-Z]", "[0-9]")) and _entropy(v) > C.HIGH_ENTROPY_BITS

    def run(text: str) -> list[tuple[str, int, int]]:
        found = [(e, m.start(), m.end()) for e, p, ok in wanted for m in p.finditer(text) if m.end() > m.start() and ok(m.group())]
        if threshold <= 0.8:
            found += [("ssn", m.start(), m.end()) for m in number.finditer(text) if _ssn(m.group()) and near(text, about, m.start(), C.SSN_WINDOW)]
        if threshold <= 0.9:
            found += [("high_entropy_secret", m.start(), m.end()) for m in rich.finditer(text) if entropic(text, m)]
        out: list[tuple[str, int, int]] = []
        for e, s, t in sorted(found):
            if out and out[-1][0] == e and s < out[-1][2]:
                out[-1] = (e, out[-1][1], max(t, out[-1][2]))
            else:
                out.append((e, s, t))
        return sorted(out, key=lambda x: (x[1], -x[2]))

    return run


def id_digits(token: str, count: int) -> str:
    """The decimal digits of a token id, as `tokens.id_digits` gives them."""
    acc, out = 0, ""
    for i in range(count):
        acc = (acc * 33 + ord(token[i % len(token)]) + i) % 2**32
        out += str(acc % 10)
    return out


def replacement(entity: str, token: str, fmt: str | None, value: str) -> str:
    """What stands for a value, as `tokens.replacement` gives it."""
    if fmt == "preserve" and entity == "email":
        return f"{token}@redacted.example"
    if fmt == "preserve" and entity == "phone":
        return "+1555" + id_digits(token, 7)
    if fmt == "preserve" and entity == "credit_card":
        size = max(len(_digits(value)), 13)
        body = "9" + id_digits(token, size - 1)[1:]
        fake = body + next(d for d in "0123456789" if _luhn(body + d))
        rest = iter(fake)
        return "".join(next(rest) if c in "0123456789" else c for c in value) + "".join(rest)
    return f"<{entity.upper()}_{token}>"


@dataclass(frozen=True)
class StreamPolicy:
    """What a stream does with each class: (action, format, rule) by entity. Without a master key, what is to be tokenized is masked."""

    actions: dict[str, tuple[str, str | None, str]]
    master: bytes | None = None

    @classmethod
    def of(cls, policy: dict, boundary: dict, agent: str = "default", entities: tuple[str, ...] = C.SECRETS + C.PII, master: bytes | None = None) -> StreamPolicy:
        rules, key = P.compile_policy(policy), P.boundary_key(boundary)
        return cls({e: P.resolve_one(rules, e, key, agent) for e in entities}, master)

    def token(self, workflow: str, entity: str, value: str, fmt: str | None) -> str:
        plain = value.strip("\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
        plain = plain.lower() if entity == "email" else _digits(plain) if entity in ("phone", "credit_card") else plain
        return replacement(entity, reference_token_id(self.master, workflow, entity, plain), fmt, value)


def check_window(text: str, final: bool, detect, policy: StreamPolicy, mode: str, holdback: int, workflow: str = "default") -> tuple[str, str, str, str | None, str | None, int, list[dict]]:
    """(emitted, carry, status, entity, rule, decisions, puts) of a window. Any block in it, also in what is held back, ends the stream unless blocks are masked."""
    found = []
    for e, s, t in detect(text):
        action, fmt, rule = policy.actions.get(e, ("allow", None, "defaults.action"))
        clash = next((i for i, f in enumerate(found) if s < f[2] and t > f[1]), None)
        if clash is None:
            found.append((e, s, t, action, rule, fmt))
        elif action != found[clash][3] and P.ACTION_RANK[action] >= P.ACTION_RANK[found[clash][3]]:
            found[clash] = (e, s, t, action, rule, fmt)
    blocks = [f for f in found if f[3] == "block"]
    if blocks and mode != "redact":
        first = min(blocks, key=lambda f: (f[1], f[0]))
        return "", "", "blocked", first[0], first[4], len(found), []
    # What tells a value by the words before it stays with it.
    cut = emit_end(len(text), [(max(0, f[1] - CONTEXT), f[2]) for f in found], holdback, final)
    out, at, puts = [], 0, []
    inside = sorted((f for f in found if f[2] <= cut), key=lambda f: f[1])
    for e, s, t, action, _, fmt in inside:
        if s < at or action not in ("block", "mask", "tokenize"):
            continue
        new = f"[{e.upper()}]"
        if action == "tokenize" and policy.master is not None:
            new = policy.token(workflow, e, text[s:t], fmt)
            puts.append({"workflow_id": workflow, "token": new, "entity": e, "value": text[s:t]})
        out += [text[at:s], new]
        at = t
    out.append(text[at:cut])
    return "".join(out), text[cut:], "final" if final else "open", None, None, len(inside), puts


def step(carry: str, rows: list[tuple[int, str, bool]], detect, policy: StreamPolicy, mode: str, holdback: int, workflow: str = "default") -> tuple[list[tuple], str, bool]:
    """Output rows (seq, emitted, status, entity, rule, decisions, puts), the new carry, and whether the stream has ended. Rows may come in any order."""
    out, ended = [], False
    for seq, delta, final in sorted(rows, key=lambda r: r[0]):
        if ended:
            break
        carry += delta or ""
        if mode == "buffer" and not final:
            continue
        emitted, carry, status, entity, rule, n, puts = check_window(carry, final, detect, policy, mode, holdback, workflow)
        out.append((seq, emitted, status, entity, rule, n, puts))
        ended = status != "open"
    return out, carry, ended


def check_stream(rows: DataFrame, policy: StreamPolicy, mode: str = "abort", holdback: int = C.HOLDBACK, detect=None, workflow: str = "default") -> DataFrame:
    """A streaming (or batch) DataFrame of chunks to one of checked output (OUTPUT), with state keyed by stream.

    All built-in classes are looked for, by the rules of the batch check; `puts` are the vault records to insert. The carry is at most the hold-back and one straddling span (in `buffer` mode the whole text). Chunks after a block or the end are dropped.
    """
    if mode not in ("abort", "redact", "buffer"):
        raise ValueError("mode is abort, redact or buffer")
    scan = detect or full_detector()

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry, ended = state.get if state.exists else ("", False)
        rows_ = [(int(s), d, bool(f)) for frame in frames for s, d, f in zip(frame["seq"], frame["delta"], frame["is_final"], strict=True)]
        out = []
        if not ended:
            out, carry, ended = step(carry, rows_, scan, policy, mode, holdback, workflow)
        state.update(("" if ended else carry, ended))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=FIELDS)


    def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, carry, ended = None, "", False
        for frame in frames:
            out = []
            for own, seq, delta, final in zip(frame["stream_id"], frame["seq"], frame["delta"], frame["is_final"], strict=True):
                if own != stream:
                    stream, carry, ended = own, "", False
                if not ended:
                    made, carry, ended = step(carry, [(int(seq), delta, bool(final))], scan, policy, mode, holdback, workflow)
                    out += [(own, *r) for r in made]
            yield pd.DataFrame(out, columns=FIELDS)

    chunks = rows.select("stream_id", "seq", "delta", "is_final")
    if not rows.isStreaming:  # a stored stream goes by in order, whatever its length
        return chunks.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(ordered, OUTPUT)
    return chunks.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")


def parse_sse(rows: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines `data: {...}` as deltas: choices[0].delta.content; `[DONE]` is final; other lines pass as null deltas."""
    data = F.when(F.col(line_col).startswith("data:"), F.trim(F.substring(F.col(line_col), F.lit(6), F.length(line_col))))
    delta = F.get_json_object(data, "$.choices[0].delta.content")
    return rows.withColumn("delta", delta).withColumn("is_final", F.coalesce(data == "[DONE]", F.lit(False)))


def to_sse(rows: DataFrame) -> DataFrame:
    """Checked output as event-stream lines; a block is an error event, after which the stream is closed."""
    ok = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("emitted").alias("content")).alias("delta"))).alias("choices"))))
    stop = F.concat(F.lit("event: error\ndata: "), F.to_json(F.struct(F.lit("policy_violation").alias("type"), "entity", "rule")))
    return rows.withColumn("line", F.when(F.col("status") == "blocked", stop).otherwise(ok))


def rewrite_line(line: str, text: str) -> str:
    """One event-stream line with its delta replaced; lines without a delta are unchanged."""
    if not line.startswith("data:") or line[5:].strip() == "[DONE]":
        return line
    body = json.loads(line[5:])
    if not body.get("choices") or "content" not in body["choices"][0].get("delta", {}):
        return line
    body["choices"][0]["delta"]["content"] = text
    return "data: " + json.dumps(body, ensure_ascii=False, separators=(",", ":"))
