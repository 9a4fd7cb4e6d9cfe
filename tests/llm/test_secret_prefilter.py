import re

from millrace.llm import secrets


def test_rules_without_trigrams_lose_no_match(spark):
    """Neither a pattern of several parts nor one judged by a group is a single run."""
    parts = secrets.Rule("parts", "fo[0-9]+ba[a-z]+", 0, 8)
    inner = secrets.Rule("inner", "k=([0-9]+);", 1, 4)
    rules = (*secrets.RULES, parts, inner)
    texts = ["fo12barn", "fo1bax", "x k=12345; y", "k=123;", "0123456789abcdef0123456789abcdef", "fo7baaaaaa k=9999;", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: sorted((s["kind"], s["start"], s["stop"]) for s in r["spans"]) for r in secrets.scan(docs, rules).collect()}
    for i, text in enumerate(texts):
        want = [(r.kind, m.start(), m.end()) for r in (*rules[2:],) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
        assert got[i] == sorted(want), text
