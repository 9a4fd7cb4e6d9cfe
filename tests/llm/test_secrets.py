import hashlib
import random
import re

from millrace.llm import secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute(text):
    spans = [(m.start(), nr, k, m.end()) for nr, (k, (p, g, n)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return sorted(spans)


def test_queries_come_from_the_expressions():
    assert secrets.branches(secrets.RULES[1]) == [["aki", "kia"]]
    assert secrets.branches(secrets.RULES[2]) == []
    grams = lambda w: sorted({w[i : i + 3] for i in range(len(w) - 2)})
    assert secrets.branches(secrets.RULES[0]) == sorted(map(grams, ("password", "passwd", "secret", "token", "apikey", "api_key")))
    rule = lambda p: secrets.branches(secrets.Rule("x", p, 0, 1))
    assert rule("foo[0-9]+bar") == [["bar", "foo"]]
    assert rule("ab(c|d)e?") == [["abc"], ["abd"]]
    assert rule("(?:foo|ba)x*") == [] and rule("(foo)?bar.") == [["bar"]] and rule("(?:abc){2,}") == [["abc"]]
    assert rule(r"x\d{3}y") == [] and rule("éabc") == [["abc"]] and rule("[^a]bcd") == [["bcd"]] and rule("") == []


def test_every_match_holds_its_query():
    r = random.Random(11)
    pieces = ["ab", "cd?", "[xy]z", "(?:foo|ba)", "(q|rst)+", "t{2}", ".", "e*", "AbC", "(?i:Key)", "^", "(?=d)d"]
    for _ in range(3000):
        pattern = "".join(r.choices(pieces, k=r.randint(1, 5)))
        text = "".join(r.choices(["ab", "c", "d", "xz", "yz", "foo", "ba", "q", "rst", "tt", "e", "AbC", "key", "KEY"], k=12))
        m = re.search(pattern, text)
        if m:
            q = secrets.query(pattern)
            assert any(all(g in text.lower() for g in b) for b in q), (pattern, text)


def test_texts_with_very_many_matches(spark):
    """A megabyte of short hex runs, of secrets, and of both in turn: seconds, not hours."""
    import time

    rows = [(1, "ab12 " * 200_000 + "f" * 32, "a", 1), (2, "AKIA1234567890ABCD " * 50_000, "a", 1), (3, "token=abcdefgh é " * 50_000, "a", 1), (4, "fe" * 16 + " x " + ("deadbeef" * 4 + "-") * 20_000, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(4)
    began = time.time()
    got = sorted((x["doc_id"], x["spans"]) for x in secrets.summary(secrets.scan(docs)).collect())
    assert got == [(d, ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(t))) for d, t, _, _ in rows]
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}
    assert clean[2] == "[SECRET] " * 50_000 and clean[3] == "[SECRET] é " * 50_000 and clean[4].count("[SECRET]") == 20_001
    assert time.time() - began < 60


def test_scan_and_redaction(spark):
    r = random.Random(4)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc", "hunter2hunter2", "AKIA", "ABCDEFGH1234", "AKI", "é", "日本", "\n", "deadbeef" * 4, "0123456789abcdef", ".", "x"]
    rows = [(i if i % 9 else None, None if i % 50 == 0 else "".join(r.choices(bits, k=r.randint(0, 25))), "a", i) for i in range(600)]
    rows += [(7, "token=" + "Z" * 9, "dup", 1)] * 3 + [(8, "secret=a.token :abcdefgh", "short", 1), (9, "q" * 200_000 + "token=abcdefghi", "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int")
    got = sorted((x["doc_id"] or 0, x["n_assign"], x["n_access"], x["n_hex"], x["base_sha256"], x["spans"]) for x in secrets.summary(secrets.scan(docs)).collect())
    want = []
    for doc, text, _, _ in rows:
        s = brute(text)
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want.append((doc or 0, *(sum(x[2] == k for x in s) for k in BASE), hashlib.sha256(said.encode()).hexdigest(), said))
    assert got == sorted(want)

    def cut(text):
        out, at = "", 0
        for a, _, _, b in brute(text):
            if b > at:
                out += text[at:a] + "[SECRET]" if a >= at else ""
                at = b
        return None if text is None else out + text[at:]

    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    assert sorted(map(repr, (tuple(x) for x in clean.collect()))) == sorted(repr((d, cut(t), s, k)) for d, t, s, k in rows)
    assert secrets.summary(secrets.scan(docs.limit(0))).count() == 0
