"""Deterministic tokens as column expressions: normalisation, keyed hashes, token ids and replacement formats."""

from __future__ import annotations

import hashlib
import hmac
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import TOKEN_ALPHABET, TOKEN_LENGTH, WS
from .spans import let


class KeyMissing(RuntimeError):
    """No master key: tokens made in different processes would differ."""


def master_key(explicit: bytes | None = None, variable: str = "SPANWARDEN_MASTER_KEY") -> bytes:
    """The key given, else that of the environment variable (hex). There is no random fallback: executors have to agree."""
    if explicit:
        return explicit
    if value := os.environ.get(variable):
        return bytes.fromhex(value)
    raise KeyMissing(f"give a master key or set {variable}")


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _keyed(inner: Column, outer: Column, message: Column) -> Column:
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def workflow_pads(master: bytes, workflow: str | None = None, workflow_col: Column | None = None) -> Column:
    """Struct of the two padded keys of HMAC-SHA256 under the workflow's key, which is HMAC-SHA256(master, workflow id).

    A constant workflow's are literals. For a column the key is XORed hex digit by hex digit; bind the result once a row.
    """
    if workflow_col is None:
        inner, outer = _pads(hmac.new(master, workflow.encode(), hashlib.sha256).digest())
        return F.struct(F.lit(inner).alias("inner"), F.lit(outer).alias("outer"))
    first, second = _pads(master)
    digits = F.rpad(F.hex(_keyed(F.lit(first), F.lit(second), F.encode(workflow_col, "UTF-8"))), 128, "0")

    def xor(chars: Column, byte: int) -> Column:
        def one(ch: Column, i: Column) -> Column:
            high = F.translate(ch, "0123456789ABCDEF", "".join(f"{d ^ (byte >> 4):X}" for d in range(16)))
            low = F.translate(ch, "0123456789ABCDEF", "".join(f"{d ^ (byte & 15):X}" for d in range(16)))
            return F.when(i % 2 == 0, high).otherwise(low)

        return F.unhex(F.array_join(F.transform(F.filter(chars, lambda c: c != ""), one), ""))

    return let(F.split(digits, ""), lambda c: F.struct(xor(c, 0x36).alias("inner"), xor(c, 0x5C).alias("outer")))


def normalise(entity: Column, value: Column) -> Column:
    trimmed = F.regexp_replace(value, f"^[{WS}]+|[{WS}]+$", "")
    return F.when(entity == "email", F.lower(trimmed)).when(entity.isin("phone", "credit_card"), F.regexp_replace(trimmed, "[^0-9]", "")).otherwise(trimmed)


def token_id(pads: Column, entity: Column, value: Column) -> Column:
    """The low base-36 digits of the first 8 bytes of HMAC(workflow key, entity, 0, normalised value). `pads` as from `workflow_pads`."""
    message = F.concat(F.encode(entity, "UTF-8"), F.lit(b"\0"), F.encode(normalise(entity, value), "UTF-8"))
    number = F.conv(F.substring(F.hex(_keyed(pads["inner"], pads["outer"], message)), 1, 16), 16, 36)
    digits = F.lpad(F.right(number, F.lit(TOKEN_LENGTH)), TOKEN_LENGTH, "0")
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", TOKEN_ALPHABET)


def mask(entity: Column) -> Column:
    return F.concat(F.lit("["), F.upper(entity), F.lit("]"))


def label(entity: Column, token: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(entity), F.lit("_"), token, F.lit(">"))


def id_digits(token: Column, count: Column) -> Column:
    """`count` decimal digits from a token id: a running multiply-and-add in 32 bits, its last digit at each step."""
    zero = F.struct(F.lit(0).cast("long").alias("acc"), F.lit("").alias("out"))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(token, (i % TOKEN_LENGTH) + 1, F.lit(1)))
        acc = (a["acc"] * 33 + code + i) % F.lit(2**32)
        return F.struct(acc.cast("long").alias("acc"), F.concat(a["out"], (acc % 10).cast("int").cast("string")).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), count - 1), zero, step, lambda a: a["out"])


def luhn_digit(body: Column) -> Column:
    n = F.length(body)

    def term(i: Column) -> Column:
        d = F.substring(body, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - 1 - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def preserve_card(original: Column, token: Column) -> Column:
    """A card-shaped token: first digit 9, a valid check digit, the original's separators."""
    size = F.greatest(F.length(F.regexp_replace(original, "[^0-9]", "")), F.lit(13))
    body = F.concat(F.lit("9"), F.substring(id_digits(token, size - 1), F.lit(2), size))
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def dress(fake: Column) -> Column:
        def step(a: Column, ch: Column) -> Column:
            digit = ch.rlike("[0-9]")
            return F.struct((a["n"] + F.when(digit, 1).otherwise(0)).alias("n"), F.concat(a["out"], F.when(digit, F.substring(fake, a["n"] + 1, F.lit(1))).otherwise(ch)).alias("out"))

        return F.aggregate(F.split(original, ""), zero, step, lambda a: F.concat(a["out"], F.substring(fake, a["n"] + 1, size)))

    return let(body, lambda b: let(F.concat(b, luhn_digit(b)), dress))


def replacement(entity: Column, token: Column, fmt: Column, value: Column) -> Column:
    """The token in the wanted format; classes that cannot keep their shape get a label."""
    keep = F.coalesce(fmt == "preserve", F.lit(False))
    return let(
        token,
        lambda t: F.when(keep & (entity == "email"), F.concat(t, F.lit("@redacted.example")))
        .when(keep & (entity == "phone"), F.concat(F.lit("+1555"), id_digits(t, F.lit(7))))
        .when(keep & (entity == "credit_card"), preserve_card(value, t))
        .otherwise(label(entity, t)),
    )


def reference_token_id(master: bytes, workflow_id: str, entity: str, normalised: str) -> str:
    """The same id for one value on the driver, for tests and point look-ups."""
    key = hmac.new(master, workflow_id.encode(), hashlib.sha256).digest()
    number = int.from_bytes(hmac.new(key, entity.encode() + b"\0" + normalised.encode(), hashlib.sha256).digest()[:8], "big")
    out = ""
    for _ in range(TOKEN_LENGTH):
        number, digit = divmod(number, 36)
        out = TOKEN_ALPHABET[digit] + out
    return out


def storage_key(master: bytes) -> bytes:
    return hmac.new(master, b"storage", hashlib.sha256).digest()


def encrypt(value: Column, master: bytes) -> Column:
    """AES-256-GCM with a random 12-byte prefix, as base64 text."""
    return F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(storage_key(master)), F.lit("GCM")))


def decrypt(ciphertext: Column, master: bytes) -> Column:
    """The value, or null where the record is corrupt."""
    return F.try_aes_decrypt(F.unbase64(ciphertext), F.lit(storage_key(master)), F.lit("GCM")).cast("string")
