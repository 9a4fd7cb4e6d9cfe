import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def exact_bins(items, cap):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [cap - items[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_instances():
    r = random.Random(3)
    for _ in range(150):
        cap = r.choice((10, 20, 30))
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        counts = np.bincount(items, minlength=cap + 1)
        plan = packing.bin_completion(counts, cap)
        got = sum((np.bincount(p, minlength=cap + 1) * n for p, n in plan), np.zeros(cap + 1, dtype=int))
        assert (got == counts).all() and all(sum(p) <= cap for p, _ in plan)
        bins = sum(n for _, n in plan)
        assert packing.lower_bound(counts, cap) <= exact_bins(items, cap)
        assert bins == exact_bins(items, cap), (items, cap)


def test_the_first_descent_ends_with_a_plan():
    """Whatever the limit on completions, also over nearly all lengths."""
    g = np.random.default_rng(6)
    counts = np.bincount(g.integers(1, 2049, 200_000), minlength=2049)
    for nodes in (1, 3000):
        plan = packing.bin_completion(counts, 2048, nodes=nodes)
        assert (sum((np.bincount(p, minlength=2049) * n for p, n in plan), np.zeros(2049, dtype=int)) == counts).all()
        assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 2048))


def test_large_histograms_come_within_three_of_the_bound():
    g = np.random.default_rng(5)
    for mean in (200, 500, 900):
        items = np.clip(g.lognormal(np.log(mean), 0.9, 50_000).astype(int), 1, 2048)
        counts = np.bincount(items, minlength=2049)
        bins = sum(n for _, n in packing.bin_completion(counts, 2048))
        assert bins <= packing.lower_bound(counts, 2048) + 3


def test_places_and_pieces(spark):
    words = "alpha beta gamma delta'll 12 é \n".split(" ")
    r = random.Random(9)
    rows = [(i % 90 if i % 17 else None, None if i % 13 == 0 else " ".join(r.choices(words, k=r.choice((0, 1, 30, 300, 900)))), "x", i) for i in range(120)]
    rows += [rows[5]] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string, length int")
    got = packing.pack_documents(docs, BPE, 256).collect()
    t = Tokenizer.from_file(BPE)
    want = []
    for doc, text, _, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(want, key=key)
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs.limit(0), BPE, 256).count() == 0
