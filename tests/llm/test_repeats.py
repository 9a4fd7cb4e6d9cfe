import hashlib
import random
import re

import numpy as np

from millrace.llm import automata, repeats


def corpus(seed, n=120, glue=" "):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [r.choices(vocabulary, k=r.randint(15, 60)) for _ in range(12)]
    texts = [None, "", " ", "a b c", " ".join(["same"] * 90), "x y " * 60]
    for _ in range(n):
        words = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.5:
                p = list(r.choice(passages))
                if r.random() < 0.4:
                    p[r.randrange(len(p))] = r.choice(vocabulary)
                words += p[r.randint(0, 10) :]
            else:
                words += r.choices(vocabulary, k=r.randint(5, 60))
        texts.append(glue.join(words) + r.choice(("", "\n", " é")))
    texts += [texts[20]] * 60
    r.shuffle(texts)
    return [(i, t, i) for i, t in enumerate(texts)]


def brute_words(rows, length=20):
    seen, out = set(), []
    for d, t, _ in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_sliding_minimum():
    v = np.random.default_rng(1).integers(0, 2**60, 997, dtype=np.uint64)
    for w in (1, 2, 7, 100, 997):
        assert repeats.sliding_min(v, w).tolist() == [min(v[i : i + w].tolist()) for i in range(997 - w + 1)]


def test_automaton_matching_statistics():
    r = random.Random(2)
    for _ in range(60):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(3)]
        a = automata.SuffixAutomaton()
        for t in texts:
            a.add(t)
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)} | {()}
        q = [r.choice("abc") for _ in range(15)]
        want = [max(k for k in range(e + 2) if tuple(q[e + 1 - k : e + 1]) in held) for e in range(len(q))]
        assert a.matching(q) == want


def test_words_that_repeat_go(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    got = sorted(tuple(x)[:4] for x in automata.dedupe(docs).collect())
    assert got == brute_words(rows)


def test_odd_rows_of_word_dedup(spark):
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a, 1), (5, a, 1), (5, b, 1), (6, a, 1), (None, b, 1), (None, None, 1)], "doc_id long, text string, n int")
    got = sorted((x["doc_id"] or 0, x["n_words"], x["n_removed"]) for x in automata.dedupe(docs).collect())
    assert got == [(0, 0, 0), (0, 40, 40), (5, 40, 0), (5, 40, 0), (5, 40, 0), (6, 40, 40)]
    assert automata.dedupe(docs.limit(0)).count() == 0


def test_hot_anchors_and_long_texts(spark, monkeypatch):
    """Frequent anchors dealt by digest and met by surroundings, texts cut into parts, salted digests."""
    from millrace.llm import transforms

    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT", 5)
    monkeypatch.setattr(repeats, "MANY", 2)
    monkeypatch.setattr(repeats, "PART", 150)
    monkeypatch.setattr(repeats, "DEALT", 100_000)
    r = random.Random(8)
    line = "all rights reserved by the owner of this very page"
    rows = corpus(7)
    rows += [(1000 + i, " ".join(r.choices("pqrst", k=r.randint(3, 30))) + f" {line} " + " ".join(r.choices("pqrst", k=r.randint(3, 30))), 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    assert sorted(tuple(x)[:4] for x in automata.dedupe(docs).collect()) == brute_words(rows)
    assert sorted(tuple(x)[:5] for x in transforms.dedupe(docs).collect()) == brute_bytes(rows)


def test_very_long_words_and_texts(spark):
    """Long words that share every polynomial hash; texts of a megabyte."""
    from millrace.llm import transforms
    from tests.llm.test_tokens import thue_morse

    r = random.Random(9)
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    long = [f"w{r.randrange(3000)}" for _ in range(60_000)]
    rows = [(1, f"{a} " + " ".join(f"x{i}" for i in range(40)), 0), (2, f"{b} " + " ".join(f"x{i}" for i in range(40)), 0), (3, " ".join([a, b] * 30), 0), (4, " ".join([b] * 30), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(tuple(x)[:4] for x in automata.dedupe(docs).collect()) == brute_words(rows)
    rows = [(1, " ".join(long), 0), (2, " ".join(long[20_000:21_000]), 0), (3, "z" * 300_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(tuple(x)[:4] for x in automata.dedupe(docs).collect()) == brute_words(rows)
    assert sorted(tuple(x)[:5] for x in transforms.dedupe(docs).collect()) == brute_bytes(rows)


def brute_bytes(rows, length=200):
    from collections import Counter

    bodies = [(d, (t or "").encode()) for d, t, _ in rows]
    times = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d or 0, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_merged_order_and_common_prefixes():
    from millrace.llm import transforms

    r = random.Random(3)
    for length in (1, 2, 3, 5, 8, 17, 40):
        for letters in (b"abc", b"ab", b"a", bytes(range(256))):
            texts = [bytes(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(9)]
            alphabet = transforms.Alphabet(texts)
            shards = [transforms.Transform(alphabet, np.array(x)) for x in ([0, 4, 5], [1], [2, 3, 6, 7, 8])]
            rows, common = transforms.merge(shards, length)
            rings = [t + b"\0" for t in texts]
            heads = [(ring[i:] + ring * 50)[:length] for ring in rings for i in range(len(ring))]
            assert sorted(rows.tolist()) == list(range(len(heads)))
            got = [heads[i] for i in rows]
            assert got == sorted(heads)
            assert ((common[1:] == length) == [a == b for a, b in zip(got, got[1:])]).all()
            for a, b, c in zip(got, got[1:], common[1:].tolist()):
                assert a[:c] == b[:c]


def test_bytes_that_repeat_go(spark):
    from millrace.llm import transforms

    rows = corpus(6) + [(500, "é" * 150, 0), (501, "x" * 300, 0), (502, "é" * 130 + "!", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(5)
    got = sorted(tuple(x)[:5] for x in transforms.dedupe(docs).collect())
    assert got == brute_bytes(rows)


def test_odd_rows_of_byte_dedup(spark):
    from millrace.llm import transforms

    a = "".join(chr(97 + i * i % 23) + str(i) for i in range(150))
    rows = [(5, a, 1), (5, a, 1), (6, a[:199], 1), (None, a[50:260] + "z", 1), (None, None, 1), (8, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted((x["doc_id"] or 0, *tuple(x)[1:5]) for x in transforms.dedupe(docs).collect()) == brute_bytes(rows)
    assert transforms.dedupe(docs.limit(0)).count() == 0
