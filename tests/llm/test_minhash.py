import random
import re

import numpy as np

from millrace.llm import minhash
from millrace.llm.components import components


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = [(d, brute_set(t)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return sorted((d, len(s), root(d) if s else d) for d, s in sets)


def test_signatures_estimate_similarity():
    g = np.random.default_rng(1)
    base = g.integers(0, 2**63, 400, dtype=np.uint64)
    for share in (0.5, 0.85):
        k = int(400 * share)
        sets = []
        for _ in range(60):
            fresh = g.integers(0, 2**63, 800 - 2 * k, dtype=np.uint64)
            sets += [np.concatenate([base[:k], fresh[: 400 - k]]), np.concatenate([base[:k], fresh[400 - k :]])]
        sig = minhash.signatures(sets)
        assert abs((sig[0::2] == sig[1::2]).mean() - k / (800 - k)) < 0.02
    alone = minhash.signatures([base[:1], base[:1], base[1:2]])
    assert (alone[0] == alone[1]).all() and (alone[0] != alone[2]).all()


def test_steps_stop_early_without_changing_the_result():
    """One element after the other, each with its whole permutation."""
    values = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    m, want = 16, [0xFFFFFFFF] * 16
    for v in values:
        perm = list(range(m))
        for j in range(m):
            x = int(minhash.V.mix(np.array([v]) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[0])
            k = j + (x >> 40) % (m - j)
            perm[j], perm[k] = perm[k], perm[j]
            want[perm[j]] = min(want[perm[j]], j << 24 | x & 0xFFFFFF)
    assert minhash.signatures([values], m)[0].tolist() == want


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(1, 6)))
    texts = [None, "", " \n", "one two", "One  TWO", "x"]
    for _ in range(12):
        base = [word() for _ in range(r.choice((3, 30, 80, 200)))]
        for _ in range(r.choice((1, 2, 5, 25))):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(150)]
    for _ in range(160):  # a bucket beyond the chunk size's half, most of it no near copies
        copy = list(hot)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [texts[-1]] * 50
    r.shuffle(texts)
    return [(i, t, i) for i, t in enumerate(texts)]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = minhash.near_duplicates(docs).collect()
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert sorted(tuple(x)[:3] for x in got) == brute(rows)


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    check(spark, corpus(1))
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rows = corpus(2)
    check(spark, rows)


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(5, a, 1), (5, b, 1), (3, a, 1), (9, b + " end", 1), (None, a, 1), (7, "", 1)], "doc_id long, text string, bands int")
    got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(docs).collect())
    assert got == [(0, 56, None), (3, 56, 3), (5, 56, 3), (5, 56, 3), (7, 0, 7), (9, 57, 3)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200, 400)] + [(1, k) for k in range(500, 900)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect())
    assert got == {i: 200 for i in range(200, 401)} | {k: 1 for k in [1, *range(500, 900)]}


def test_real_shingles_decide(spark):
    """A long word and its Thue-Morse complement, and shingles numbered without hashes."""
    from tests.llm.test_tokens import thue_morse

    r = random.Random(5)
    texts = [" ".join(r.choices(["a", "B", "c", "É", "x\x1cy"], k=r.randint(0, 40))) for _ in range(60)]
    sets = [set(s.tolist()) for s in minhash.numbered_sets([t.encode() for t in texts])]
    real = [brute_set(t) for t in texts]
    for i in range(60):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(real[i] & real[j])
    rows = []
    for n in (1024, 4096):
        for letters in ("ab", "ba"):
            rows.append((len(rows), " ".join(thue_morse(n, letters) + str(k % 3) for k in range(30)), 0))
            rows.append((len(rows), thue_morse(n, letters), 0))
    check(spark, rows)


def test_long_texts(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long), 0), (2, " ".join(long[:110_000]), 0), (3, "q" * 1_000_000, 0), (4, " ".join(long[50_000:]), 0), (5, "Q" * 1_000_000, 0)]
    check(spark, rows)
