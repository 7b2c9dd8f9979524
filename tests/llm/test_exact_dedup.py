import hashlib
import re

from spanwarden.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        group = [r for r, m in zip(rows, norm, strict=True) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_matches_brute_force(docs, spark):
    texts = ["a b", "ab", None, "", " \n", "é x", "é  x", "long" * 20_000, "long " * 20_000] + ["hot  text"[: 3 + k % 7] for k in range(300)]
    rows = list(enumerate(texts))
    for n in ("2", "7", "40"):  # groups cross partitions
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = [tuple(r) for r in exact_dedup.classify(docs(texts)).collect()]
        assert sorted(got) == sorted(brute(rows))
    kept = exact_dedup.keep_rows(docs(texts))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])
    assert kept.columns == docs(texts).columns


def test_repeated_rows_nulls_and_empty(docs):
    got = exact_dedup.classify(docs(["x", "x", "x", "y"], [3, 3, None, None])).collect()
    assert sorted((r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, 1, True), (3, 3, False), (3, 3, False), (3, 3, True)]
    assert exact_dedup.classify(docs([])).collect() == []
    assert exact_dedup.keep_rows(docs([])).collect() == []
