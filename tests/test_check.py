import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwarden.functions import tokens as K
from spanwarden.operators import check as ck
from spanwarden.operators import detect, policy, restore, vault

MASTER = b"0123456789abcdef0123456789abcdef"
MODEL = {"kind": "model", "provider": "openai/gpt-4o"}


def key(*parts):
    return "".join(parts)


POSITIVE = {
    "email": ["a@b.co", "first.last+tag@sub.example.org"],
    "phone": ["+1 (068) 555-2748", "+442071838750", "212-555-0199"],
    "credit_card": ["4111 1111 1111 1111", "5500005555555559"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789", "SSN is 123456789"],
    "ip_address": ["8.8.8.8", "2606:4700::1111"],
    "url_credentials": ["https://user:pw@host.example/path"],
    "api_key": [key("sk", "-ant-", "a1B2c3D4e5F6g7H8i9J0"), key("AKIA", "ABCDEFGH12345678"), key("gh", "p_", "a" * 36), key("npm", "_", "b1" * 18)],
    "jwt": ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"],
    "private_key": [key("-----BEGIN ", "EC PRIVATE KEY-----")],
    "connection_string": ["postgres://u:pw@h/db", "Server=h;Database=d;Password=pw1;"],
    "high_entropy_secret": ["password = 'aB3dE5gH7jK9mN1pQ3sT'"],
}
NEGATIVE = {
    "email": ["a@b", "@b.co", "a at b.co"],
    "phone": ["2024", "1.2.3", "12345678901234567890"],
    "credit_card": ["4111 1111 1111 1112", "1234"],
    "iban": ["DE88 3704 0044 0532 0130 00", "XX00"],
    "ssn": ["000-45-6789", "666-45-6789", "123-00-6789", "123456789"],
    "ip_address": ["10.0.0.1", "256.1.1.1", "1.2.3.4.5", "01.2.3.4", "::1", "fe80::1"],
    "url_credentials": ["https://host/path"],
    "api_key": [key("sk", "-short"), key("AKIA", "123")],
    "jwt": ["eyJhbGciOi.abc.def", "a.b.c"],
    "private_key": ["-----BEGIN CERTIFICATE-----", "-----BEGIN PUBLIC KEY-----"],
    "connection_string": ["postgresql://localhost/mydb", "Server=localhost;Database=app;Trusted_Connection=True"],
    "high_entropy_secret": ["aB3dE5gH7jK9mN1pQ3sT", "token = '0123456789abcdef0123456789abcdef'"],
}


def test_classes(spark):
    rows = [(e, True, t) for e, own in POSITIVE.items() for t in own] + [(e, False, t) for e, own in NEGATIVE.items() for t in own]
    df = spark.createDataFrame(rows, "entity string, polarity boolean, text string")
    got = df.select("*", F.exists(detect.detect(F.col("text")), lambda s: s["entity"] == F.col("entity")).alias("hit")).where("hit <> polarity").collect()
    assert got == []


def merge_brute(spans):
    out = []
    for entity in dict.fromkeys(s[0] for s in spans):
        own = sorted((s for s in spans if s[0] == entity), key=lambda s: s[1:3])
        kept = []
        for s in own:
            if kept and s[1] < kept[-1][2]:
                kept[-1] = (entity, kept[-1][1], max(kept[-1][2], s[2]), max(kept[-1][3], s[3]))
            else:
                kept.append(s)
        out += kept
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 20), st.integers(1, 8)), max_size=8), min_size=20, max_size=20))
def test_merge(spark, cases):
    from spanwarden.functions.spans import SPANS, merge

    rows = [(i, "x" * 40, [(e, s, s + n, 0.5 + 0.1 * ((s + n) % 5), "r", "", "") for e, s, n in own]) for i, own in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, t string, s {SPANS}")
    got = {r["i"]: sorted([(s["entity"], s["start"], s["end"], round(s["confidence"], 3)) for s in r["m"]], key=lambda s: (s[1], s[2], s[0])) for r in df.select("i", merge(F.col("s"), F.col("t")).alias("m")).collect()}
    for i, _, own in rows:
        assert got[i] == [(e, a, b, round(c, 3)) for e, a, b, c in merge_brute([s[:4] for s in own if s[3] >= 0.6])]


def test_tokens(spark):
    rows = [("w1", "email", " A@X.com "), ("w1", "phone", "+1 555-0100"), ("w2", "iban", "GB82"), ("w1", "email", "é@x.org")]
    df = spark.createDataFrame(rows, "w string, e string, v string")
    got = df.select("w", "e", "v", K.token_id(K.workflow_pads(MASTER, workflow_col=F.col("w")), F.col("e"), F.col("v")).alias("t")).collect()
    norm = {"email": lambda v: v.strip().lower(), "phone": lambda v: "".join(c for c in v if c.isdigit()), "iban": str.strip}
    assert [r["t"] for r in got] == [K.reference_token_id(MASTER, r["w"], r["e"], norm[r["e"]](r["v"])) for r in got]
    card = spark.range(1).select(K.preserve_card(F.lit("4111 1111-11111111"), F.lit("a3f2k9qx")).alias("c")).first()["c"]
    digits = [int(c) for c in card if c.isdigit()]
    assert card[4] == " " and card[9] == "-" and digits[0] == 9 and len(digits) == 16
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    back = spark.range(1).select(K.decrypt(K.encrypt(F.lit("secret é"), MASTER), MASTER).alias("x"), K.decrypt(F.lit("AAAA"), MASTER).alias("y")).first()
    assert back["x"] == "secret é" and back["y"] is None


def test_default_policy_and_round_trip(spark):
    texts = ["mail a@b.co and again a@b.co, ip 8.8.8.8", "no entity", "", None, key("key ", "AKIA", "ABCDEFGH12345678"), "call 212-555-0199 or A@B.co"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = {r["id"]: r for r in ck.check(df, "text", ck.Context(boundary=MODEL, master=MASTER)).collect()}
    token = K.reference_token_id(MASTER, "default", "email", "a@b.co")
    assert out[0]["output"] == f"mail <EMAIL_{token}> and again <EMAIL_{token}>, ip 8.8.8.8"
    assert [d["action"] for d in out[0]["decisions"]] == ["tokenize", "tokenize", "allow"]
    assert out[0]["decisions"][0]["content_hash"] == hashlib.sha256(b"a@b.co").hexdigest()
    assert out[1]["output"] == "no entity" and out[2]["output"] == "" and out[3]["output"] is None
    assert out[4]["blocked"] and out[4]["output"] is None and out[4]["block_entity"] == "api_key" and out[4]["puts"] == []
    assert "AKIA" not in out[4]["block_message"]
    checked = ck.check(df.where("id <> 5"), "text", ck.Context(boundary=MODEL, master=MASTER))
    empty = spark.createDataFrame([], vault.SCHEMA)
    store = vault.insert_if_absent(empty, vault.records(checked, "id"), MASTER)
    assert store.count() == 1
    clean = checked.where("NOT blocked").select("id", "output")
    back = restore.restore(clean, "output", ["id"], store, {"kind": "egress", "sink": "mail"}, MASTER).collect()
    assert {r["id"]: r["restored"] for r in back} == {i: t for i, t in enumerate(texts[:4])}
    miss = restore.restore(clean, "output", ["id"], empty, {"kind": "egress", "sink": "mail"}, MASTER).where("id = 0").first()
    assert miss["restored"] == out[0]["output"] and {d["action"] for d in miss["decisions"]} == {"restore_miss"}
    with pytest.raises(restore.InvariantViolation):
        restore.restore(clean, "output", ["id"], store, MODEL, MASTER)
    both = vault.insert_if_absent(empty, vault.records(ck.check(df, "text", ck.Context(boundary=MODEL, master=MASTER)), "id"), MASTER)
    assert {r["vault_status"] for r in both.where("entity = 'email'").collect()} == {"collision"}
    assert vault.insert_if_absent(store, vault.records(checked, "id"), MASTER).count() == 0


def test_restore_rows_with_repeated_and_null_keys(spark, tmp_path):
    from spanwarden.plans import catalog

    rows = [(1, "mail a@b.co, c@d.org"), (1, "mail a@b.co, c@d.org"), (1, "now c@d.org"), (2, "A@B.co"), (3, "a@b.co"), (None, "x a@b.co"), (None, None), (4, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    back = catalog.restore_roundtrip(spark, str(tmp_path)).collect()
    assert sorted(map(repr, back)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in rows)


def test_block_as_mask_and_row_boundaries(spark):
    df = spark.createDataFrame([(0, "tool:crm:out", "x", key("AKIA", "ABCDEFGH12345678", " a@b.co")), (1, "telemetry", None, "a@b.co")], "id int, b string, agent string, text string")
    masked = ck.check(df, "text", ck.Context(boundary=MODEL, master=MASTER, apply_block_as="mask")).where("id = 0").first()
    assert masked["output"].startswith("[API_KEY] <EMAIL_") and masked["decisions"][0]["applied_as"] == "mask" and not masked["blocked"]
    rules = {"defaults": {"action": "allow"}, "entities": {"email": "mask"}, "boundaries": {"tool:*:out": {"entities": {"api_key": "mask", "email": "allow"}}}, "identities": {"x": {"entities": {"email": "mask"}}}}
    rows = {r["id"]: r for r in ck.check(df, "text", ck.Context(boundary_col="b", agent_col="agent", policy=rules)).collect()}
    assert rows[0]["output"] == "[API_KEY] [EMAIL]" and rows[1]["output"] == "[EMAIL]"
    assert rows[0]["decisions"][1]["rule"] == "identities.x.entities.email" and rows[1]["decisions"][0]["rule"] == "entities.email"


CASES = [
    ({"entities": {"email": "mask"}, "boundaries": {"openai/*": {"entities": {"email": "block"}}}}, "email", "openai/gpt-4o", "default", "block", "boundaries.openai/*.entities.email"),
    ({"entities": {"*": "mask"}}, "phone", "telemetry", "", "mask", "entities.*"),
    ({"entities": {"block-pii": "block", "*": "mask"}}, "person", "telemetry", "a", "block", "entities.block-pii"),
    ({"boundaries": {"tool:*": {"entities": {"email": "mask"}}, "tool:crm:*": {"entities": {"email": "tokenize"}}, "tool:crm:in": {"entities": {"phone": "block"}}}}, "email", "tool:crm:in", "a", "tokenize", "boundaries.tool:crm:*.entities.email"),
    ({"boundaries": {"*": {"entities": {"email": "mask"}}}}, "email", "tool:crm:in", "a", "allow", "defaults.action"),
    ({"entities": {"api_key": "block"}, "boundaries": {"openai/*": {"entities": {"api_key": "allow"}}}}, "api_key", "openai/x", "a", "block", "entities.api_key"),
    ({"dangerouslyAllowSecrets": True, "entities": {"api_key": "block"}, "boundaries": {"openai/*": {"entities": {"api_key": "allow"}}}}, "api_key", "openai/x", "a", "allow", "boundaries.openai/*.entities.api_key"),
    ({"identities": {"bot": {"boundaries": {"mcp:s/*": {"entities": {"email": "mask"}}}, "entities": {"email": "block"}}}}, "email", "mcp:s/t", "bot", "mask", "identities.bot.boundaries.mcp:s/*.entities.email"),
    (policy.default_policy(), "api_key", "egress:mail", "a", "detokenize", "boundaries.egress:*.entities.*"),
]


@pytest.mark.parametrize("case", CASES)
def test_resolution(spark, case):
    document, entity, boundary, agent, action, rule = case
    assert policy.resolve_one(policy.compile_policy(document), entity, boundary, agent)[::2] == (action, rule)
    row = policy.resolve(spark.createDataFrame([(entity, boundary, agent)], "entity string, boundary_key string, agent string"), document).first()
    assert (row["action"], row["rule"]) == (action, rule)


def test_validation():
    for bad, path in [({"entities": {"email": "drop"}}, "entities.email"), ({"entities": {"email": "detokenize"}}, "entities.email"), ({"x": 1}, "x"), ({"entities": {"email": {"action": "mask", "format": "z"}}}, "entities.email.format")]:
        with pytest.raises(policy.PolicyError, match=path.replace(".", r"\.")):
            policy.validate(bad)
    with pytest.raises(policy.ReviewNotImplemented):
        policy.validate({"entities": {"email": "review"}})
    assert policy.warnings({"entities": {"iban": {"action": "tokenize", "format": "preserve"}}}) == ["entities.iban"]
    source = policy.PolicySource(lambda tag: (_ for _ in ()).throw(OSError()))
    assert source.current() == policy.default_policy() and source.failures == 1
