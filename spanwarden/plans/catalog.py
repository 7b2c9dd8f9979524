"""The engine's registered queries over the driver tables, and their SQL equivalents.

SQL has no look-around, so the oracles match maximal runs or consume a guard character and compare values, not offsets; offsets are covered by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import audit, check, detect, jsonscan, policy, restore, vault
from ..operators import chat as ch
from ..sources import files
from . import synthetic

MASTER = b"an example key of thirty-two byte"[:32]
MODEL = {"kind": "model", "provider": "openai/gpt-4o"}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _values(scan, table="documents", key="doc_id", col="text"):
    """(key, value, n) of one recognizer's merged spans."""

    def query(spark, d):
        rows = detect.entity_spans(spark.read.parquet(f"{d}/{table}.parquet").select(key, col), col, [key], scan)
        return rows.groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))

    return query


def _checked(spark, d, **options):
    return check.check(_docs(spark, d).select("doc_id", "lang", "source", "text"), "text", check.Context(boundary=MODEL, master=MASTER, **options))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Default-policy check of all documents at a model boundary."""
    return _checked(spark, d).select("doc_id", "output", "blocked", F.size("decisions").alias("n_decisions"))


def entity_counts(spark, d):
    return detect.detections(_docs(spark, d).select("doc_id", "text"), "text", ["doc_id"], recognizers=_plain()).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def entity_by(column):
    def query(spark, d):
        found = detect.detections(_docs(spark, d).select("doc_id", column, "text"), "text", ["doc_id", column], recognizers=_plain())
        return found.groupBy(column, "entity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))

    return query


def _plain():
    """Recognizers whose counts SQL can give."""
    return tuple(detect.Recognizer(f.__name__, (f.__name__,), f) for f in (detect.email, detect.ipv4_only))


EMAIL_SQL = r"SELECT {k}, unnest(regexp_extract_all({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')) AS value FROM {t}"
IPV4_SQL = r"""
SELECT {k}, value FROM (SELECT {k}, unnest(regexp_extract_all({c}, '[0-9.]+')) AS value FROM {t})
WHERE regexp_full_match(value, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}')
AND NOT regexp_matches(value, '^(0|10|127|22[4-9]|2[3-5][0-9])\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^169\.254\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.2\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.')
"""

def _value_sql(sql, t="documents", k="doc_id", c="text"):
    return f"SELECT {k}, value, count(*) AS n FROM ({sql.format(t=t, k=k, c=c)}) GROUP BY ALL"


_BOTH = " UNION ALL ".join(f"SELECT '{e}' AS entity, * FROM ({s.format(t='documents', k='doc_id, lang, source', c='text')})" for e, s in (("email", EMAIL_SQL), ("ip_address", IPV4_SQL)))


def mask_email_text(spark, d):
    """Documents with email addresses masked and all else allowed."""
    document = {"defaults": {"action": "allow"}, "entities": {"email": "mask"}}
    own = (detect.Recognizer("email", ("email",), detect.email),)
    out = check.check(_docs(spark, d).select("doc_id", "text"), "text", check.Context(boundary=MODEL, policy=document, recognizers=own))
    return out.select("doc_id", "output", F.size("decisions").alias("n"))


def content_hash(spark, d):
    rows = detect.entity_spans(_docs(spark, d).select("doc_id", "text"), "text", ["doc_id"], detect.email)
    return rows.select("doc_id", F.sha2("value", 256).alias("content_hash")).groupBy("doc_id", "content_hash").agg(F.count(F.lit(1)).alias("n"))


def synthetic_ssn(spark, d):
    """Formatted numbers made of line item keys, as a class that the documents lack."""
    n = F.concat_ws("-", F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat(F.lit("id "), n, F.lit(" end")).alias("t"))
    return detect.entity_spans(rows, "t", ["l_orderkey", "l_linenumber"], detect.ssn).select("l_orderkey", "l_linenumber", "start", "end", "value")


def token_ids(spark, d):
    """Token ids of customers' generated addresses in one workflow a nation."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("Customer"), "c_custkey", F.lit("@Example.com ")).alias("v"), F.concat(F.lit("wf-"), "c_nationkey").alias("w"))
    pads = c.select("w").distinct().select("w", K.workflow_pads(MASTER, workflow_col=F.col("w")).alias("pads"))
    return c.join(pads, "w").select("c_custkey", K.token_id(F.col("pads"), F.lit("email"), F.col("v")).alias("token"))


def _pad_sql(key, byte):
    return "unhex('" + bytes(b ^ byte for b in key.ljust(64, b"\0")).hex() + "')"


TOKEN_SQL = (
    "WITH k AS (SELECT c_custkey, unhex(sha256("
    + _pad_sql(MASTER, 0x5C)
    + " || unhex(sha256("
    + _pad_sql(MASTER, 0x36)
    + " || encode('wf-' || c_nationkey))))) AS wk, 'customer' || c_custkey || '@example.com' AS v FROM customer), "
    "p AS (SELECT c_custkey, v, hex(wk) || repeat('0', 64) AS h FROM k), "
    "x AS (SELECT c_custkey, v, unhex(array_to_string([printf('%02X', xor(('0x' || h[2*i+1:2*i+2])::INT, 54)) FOR i IN range(0, 64)], '')) AS ip, "
    "unhex(array_to_string([printf('%02X', xor(('0x' || h[2*i+1:2*i+2])::INT, 92)) FOR i IN range(0, 64)], '')) AS op FROM p), "
    "m AS (SELECT c_custkey, ('0x' || sha256(op || unhex(sha256(ip || encode('email') || unhex('00') || encode(v))))[1:16])::UBIGINT::HUGEINT AS n FROM x) "
    "SELECT c_custkey, array_to_string([('abcdefghijklmnopqrstuvwxyz0123456789')[((n // (36::HUGEINT ** (7 - i))::HUGEINT) % 36)::INT + 1] FOR i IN range(0, 8)], '') AS token FROM m"
)


def policy_matrix(spark, d):
    """Every class at a set of boundaries and agents, under a policy with all kinds of rules."""
    rows = [(e, b, a) for e in (*policy.SECRETS, *policy.PII, *policy.NER) for b in ("openai/gpt-4o", "other", "tool:crm:in", "tool:crm:out", "mcp:srv/t", "telemetry", "egress:mail") for a in ("default", "bot")]
    return policy.resolve(spark.createDataFrame(rows, "entity string, boundary_key string, agent string"), MATRIX_POLICY).select("entity", "boundary_key", "agent", "action", "rule")


MATRIX_POLICY = {
    "defaults": {"action": "allow"},
    "entities": {"api_key": "block", "jwt": "block", "email": "tokenize", "block-pii": "mask"},
    "boundaries": {"openai/*": {"entities": {"api_key": "allow", "email": "mask"}}, "tool:*": {"entities": {"phone": "block"}}, "tool:crm:in": {"entities": {"phone": "allow"}}, "egress:*": {"entities": {"*": "detokenize"}}},
    "identities": {"bot": {"entities": {"iban": "block"}, "boundaries": {"mcp:srv/*": {"entities": {"*": "block"}}}}},
}
MATRIX_SQL = """
WITH e(entity, fam) AS (VALUES ('api_key','s'),('jwt','s'),('private_key','s'),('high_entropy_secret','s'),('connection_string','s'),('secret','s'),('email','p'),('phone','p'),('credit_card','p'),('iban','p'),('ssn','p'),('ip_address','p'),
 ('url_credentials','p'),('person','p'),('location','p'),('organization','p'),('account_number','p'),('private_address','p'),('private_url','p'),('private_date','p')),
b(boundary_key) AS (VALUES ('openai/gpt-4o'),('other'),('tool:crm:in'),('tool:crm:out'),('mcp:srv/t'),('telemetry'),('egress:mail')), a(agent) AS (VALUES ('default'),('bot')),
t AS (SELECT entity, fam, boundary_key, agent,
 CASE WHEN agent='bot' AND boundary_key LIKE 'mcp:srv/%' THEN 'block|identities.bot.boundaries.mcp:srv/*.entities.*'
 WHEN agent='bot' AND entity='iban' THEN 'block|identities.bot.entities.iban'
 WHEN boundary_key LIKE 'openai/%' AND entity='api_key' THEN 'block|entities.api_key'
 WHEN boundary_key LIKE 'openai/%' AND entity='email' THEN 'mask|boundaries.openai/*.entities.email'
 WHEN boundary_key='tool:crm:in' AND entity='phone' THEN 'allow|boundaries.tool:crm:in.entities.phone'
 WHEN boundary_key LIKE 'tool:%' AND entity='phone' THEN 'block|boundaries.tool:*.entities.phone'
 WHEN boundary_key LIKE 'egress:%' THEN 'detokenize|boundaries.egress:*.entities.*'
 WHEN entity IN ('api_key','jwt') THEN 'block|entities.' || entity
 WHEN entity='email' THEN 'tokenize|entities.email'
 WHEN fam='p' THEN 'mask|entities.block-pii' ELSE 'allow|defaults.action' END AS r FROM e, b, a)
SELECT entity, boundary_key, agent, split_part(r,'|',1) AS action, split_part(r,'|',2) AS rule FROM t
"""


def _event_puts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("w"), F.col("user_id") % 50).alias("workflow_id"), F.concat(F.lit("t"), F.floor(F.col("user_id") / 3).cast("string")).alias("token"), F.lit("email").alias("entity"), F.concat(F.lit("v"), "user_id").alias("value"))


def vault_first_writes(spark, d):
    return vault.first_writes(_event_puts(spark, d))


def vault_insert(spark, d):
    """Insert into a vault that holds the even workflows' tokens already, half of them expired."""
    puts, now = _event_puts(spark, d), F.lit("2024-06-01 00:00:00").cast("timestamp")
    held = puts.where("cast(substr(workflow_id, 2) as int) % 2 = 0").groupBy("workflow_id", "token").agg(F.lit("email").alias("entity"))
    held = held.withColumn("ciphertext", F.lit("")).withColumn("created_at", now).withColumn("expires_at", F.when(F.col("workflow_id").isin("w0", "w2", "w4", "w6"), now - F.expr("INTERVAL 1 DAY")).otherwise(now + F.expr("INTERVAL 1 DAY")))
    out = vault.insert_if_absent(held, puts, MASTER, now)
    return out.select("workflow_id", "token", "entity", K.decrypt(F.col("ciphertext"), MASTER).alias("value"), F.unix_seconds("expires_at").alias("expires_s"), "vault_status")


FIRST_SQL = """SELECT 'w' || user_id % 50 AS workflow_id, 't' || (user_id // 3) AS token, 'email' AS entity, arg_min('v' || user_id, (event_id, 'v' || user_id)) AS value, min('v' || user_id) <> max('v' || user_id) AS collision FROM events GROUP BY ALL"""


def restore_roundtrip(spark, d):
    """Documents that are not blocked, checked, their tokens vaulted, and restored at egress. Each is a workflow, so that spellings of other documents do not come under its tokens."""
    document = {"defaults": {"action": "allow"}, "entities": {"email": "tokenize", "credit_card": "tokenize"}}
    own = tuple(detect.Recognizer(f.__name__, (f.__name__,), f) for f in (detect.email, detect.credit_card))
    docs = _docs(spark, d).select("doc_id", "text", F.col("doc_id").cast("string").alias("workflow"))
    done = check.check(docs, "text", check.Context(boundary=MODEL, policy=document, recognizers=own, master=MASTER, workflow_col="workflow"))
    empty = spark.createDataFrame([], vault.SCHEMA)
    store = vault.insert_if_absent(empty, vault.records(done, "doc_id"), MASTER)
    back = restore.restore(done.select("doc_id", "workflow", "output"), "output", ["doc_id"], store, {"kind": "egress", "sink": "mail"}, MASTER, "workflow")
    return back.select("doc_id", F.col("restored").alias("text"))


def merge_spans_islands(spark, d):
    """Spans made of events, a text for each user and a class for each event type, merged as rows."""
    e = spark.read.parquet(f"{d}/events.parquet")
    made = e.select(F.col("user_id").alias("doc"), F.col("event_type").alias("entity"), (F.col("event_id") % 200).alias("start"), (F.col("event_id") % 200 + 1 + F.col("event_id") % 17).alias("end"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return detect.merge_rows(made, ["doc"])


def scan_report(spark, d):
    """Documents with an email address, under a policy that blocks them, as the file scan reports them."""
    document = {"defaults": {"action": "allow"}, "entities": {"email": "block"}}
    rows = _docs(spark, d).select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    hits = files.scan(rows, document, (detect.Recognizer("email", ("email",), detect.email),))
    return files.report(hits).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def blocked_docs(spark, d):
    """Documents that a policy blocks for an email address, with the rule."""
    document = {"defaults": {"action": "allow"}, "boundaries": {"openai/*": {"entities": {"email": "block"}}}}
    out = check.check(_docs(spark, d).select("doc_id", "text"), "text", check.Context(boundary=MODEL, policy=document, recognizers=(detect.Recognizer("email", ("email",), detect.email),)))
    return out.where("blocked").select("doc_id", "block_entity", "block_rule", "block_message", F.col("output").isNull().alias("no_output"))


QUERIES = {
    "merge_spans_islands": merge_spans_islands,
    "scan_report": scan_report,
    "blocked_docs": blocked_docs,
    "check_default": flagship,
    "detect_email": _values(detect.email),
    "detect_phone": _values(detect.phone),
    "detect_credit_card": _values(detect.credit_card),
    "detect_ipv4": _values(detect.ipv4_only),
    "detect_iban": _values(detect.iban),
    "detect_api_key": _values(detect.api_key),
    "detect_url_credentials": _values(detect.url_credentials),
    "detect_email_pages": _values(detect.email, "pages", "page_id", "html"),
    "detect_ssn": synthetic_ssn,
    "entity_counts": entity_counts,
    "entity_by_lang": entity_by("lang"),
    "entity_by_source": entity_by("source"),
    "mask_email_text": mask_email_text,
    "content_hash": content_hash,
    "token_ids": token_ids,
    "policy_resolve_matrix": policy_matrix,
    "vault_first_writes": vault_first_writes,
    "vault_insert_if_absent": vault_insert,
    "restore_roundtrip": restore_roundtrip,
} | synthetic.QUERIES | audit.QUERIES | jsonscan.QUERIES | ch.QUERIES

_HAS_EMAIL = EMAIL_SQL.format(t="documents", k="doc_id", c="text")
ORACLE = {
    "merge_spans_islands": """WITH s AS (SELECT user_id AS doc, event_type AS entity, event_id % 200 AS s, event_id % 200 + 1 + event_id % 17 AS e, (event_id % 10) / 10 AS c FROM events WHERE (event_id % 10) / 10 >= 0.6),
      p AS (SELECT *, max(e) OVER (PARTITION BY doc, entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
      i AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY doc, entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p)
      SELECT doc, entity, min(s) AS "start", max(e) AS "end", max(c) AS confidence FROM i GROUP BY doc, entity, g""",
    "scan_report": f"SELECT 'doc/' || doc_id || ': blocked email (rule: entities.email)' AS value, count(*) AS n FROM ({_HAS_EMAIL}) GROUP BY doc_id",
    "blocked_docs": f"SELECT DISTINCT doc_id, 'email' AS block_entity, 'boundaries.openai/*.entities.email' AS block_rule, 'Blocked by data policy: email may not be sent to openai/gpt-4o (rule: boundaries.openai/*.entities.email)' AS block_message, true AS no_output FROM ({_HAS_EMAIL})",
    "detect_email": _value_sql(EMAIL_SQL),
    "detect_ipv4": _value_sql(IPV4_SQL),
    "detect_email_pages": _value_sql(EMAIL_SQL, "pages", "page_id", "html"),
    "detect_ssn": """WITH t AS (SELECT l_orderkey, l_linenumber, lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS a, lpad((l_suppkey % 100)::VARCHAR, 2, '0') AS g, lpad((l_orderkey % 10000)::VARCHAR, 4, '0') AS s FROM lineitem)
      SELECT l_orderkey, l_linenumber, 3 AS "start", 14 AS "end", a || '-' || g || '-' || s AS value FROM t WHERE a NOT IN ('000', '666') AND a < '900' AND g <> '00' AND s <> '0000'""",
    "entity_counts": f"SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_BOTH}) GROUP BY entity",
    "entity_by_lang": f"SELECT lang, entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_BOTH}) GROUP BY ALL",
    "entity_by_source": f"SELECT source, entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_BOTH}) GROUP BY ALL",
    "mask_email_text": r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS output, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::INT AS n FROM documents",
    "content_hash": f"SELECT doc_id, sha256(value) AS content_hash, count(*) AS n FROM ({EMAIL_SQL.format(t='documents', k='doc_id', c='text')}) GROUP BY ALL",
    "token_ids": TOKEN_SQL,
    "policy_resolve_matrix": MATRIX_SQL,
    "vault_first_writes": FIRST_SQL,
    "vault_insert_if_absent": f"SELECT workflow_id, token, entity, value, epoch(TIMESTAMP '2024-06-02 00:00:00')::BIGINT AS expires_s, CASE WHEN collision THEN 'collision' ELSE 'ok' END AS vault_status FROM ({FIRST_SQL}) WHERE substr(workflow_id, 2)::INT % 2 = 1 OR workflow_id IN ('w0', 'w2', 'w4', 'w6')",
    "restore_roundtrip": "SELECT doc_id, text FROM documents",
} | synthetic.ORACLE | audit.ORACLE | jsonscan.ORACLE | ch.ORACLE
