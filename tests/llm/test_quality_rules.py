import re
from collections import defaultdict

from spanwarden.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    n, dup = len(words), len(lines) - len(set(lines))
    bad = 10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * dup > len(lines)
    bad |= 10 * sum(any(c.isalpha() for c in w) for w in words) < 7 * n or 10 * len(re.findall("[0-9]", text)) > 3 * chars
    bad |= 10 * len(re.findall(r"(?:\.\.\.|…)[\x20\x09\x0D]*(?:\n|\Z)", text)) > 3 * len(lines)
    bad |= 10 * len(re.findall(r"(?:\A|\n)[\x20\x09]*[-•*][\x20\x09]", text)) > 9 * len(lines)
    return (n, chars, symbols, dup, len(covered), base, not base and not bad)


def test_matches_brute_force(docs):
    clean = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    texts = [None, "", " \n\t", "a", "a a a", "a a a a", "x y z x y z", clean, clean + " " + clean, "a b c d " * 30, "one line\n" * 60, "é — ß " + clean]
    texts += [" ".join("abcab"[(k * j) % 5] for k in range(j)) for j in range(3, 40)]
    texts += [clean + " $$$ ||| ###" * 9, "1234 " * 60, clean.replace(" ", "\n"), "\n".join(["- " + clean[i : i + 20] for i in range(0, 400, 20)]), (clean[:60] + " ...\n") * 4, "w " * 30_000 + clean, "\x0b\x0c" + clean + "\r\n"]
    got = {r["doc_id"]: tuple(r["quality"])[:3] + tuple(r["quality"])[4:] for r in qr.cascade(docs(texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_empty_and_repeated_rows(docs):
    assert qr.cascade(docs([])).collect() == []
    rows = qr.cascade(docs(["a b", "a b"], [1, 1])).collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_order_is_by_rejection_per_cost(docs):
    found = qr.order_rules(docs(["x $$$ " * 60, "plain words " * 40] * 5))
    rates = [share / cost for _, share, cost in found]
    assert rates == sorted(rates, reverse=True) and {r.name for r, _, _ in found} == {r.name for r in qr.RULES}
