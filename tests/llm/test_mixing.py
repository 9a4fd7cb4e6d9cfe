import random
import re

import numpy as np
import pytest

from millrace.llm import mixing


def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def make(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(3000):
        source = r.choices(["hot", "b", "c", "d", None, "tiny"], [50, 20, 10, 10, 8, 0.5])[0]
        n = int(np.exp(r.gauss(3, 1)))
        rows.append((i if i % 40 else None, None if i % 101 == 0 else " ".join(["w"] * n), source, 1))
    rows += [(7, "a b c d e", "hot", 2)] * 200
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_and_taken_words(spark):
    rows, docs = make(spark)
    got = mixing.mixed_words(docs).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["size"]) for x in got) == sorted((d is None, d or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _, _ in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by = {}
    for x in got:
        assert 0 <= x["taken"] <= 3 * x["size"]
        by.setdefault((x["source_size"], x["target"]), 0)
        by[x["source_size"], x["target"]] += x["taken"]
    assert len(by) == len(want)
    for s, t in want.items():
        key = min(by, key=lambda k: abs(k[0] - sizes[s]))
        assert key[0] == sizes[s] and abs(key[1] - t) < 1e-6 * max(1, t)
        assert abs(by[key] - t) <= max(0.01 * t, 5), (s, t, by[key])
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed_words(docs).collect()))


def test_rates_solve_the_dual_and_documents_follow(spark):
    rows, docs = make(spark, 2)
    plan = mixing.copies(docs, repairs=0).toPandas()
    for _, g in plan.groupby("source", dropna=False):
        assert abs((g["rate"] * g["size"]).sum() / g["target"].iloc[0] - 1) < 1e-6
        assert (g["copies"] - g["rate"]).abs().max() < 1 + 1e-6
        assert abs(g["copies"].sum() - g["rate"].sum()) <= 1 + (g["size"] == 0).sum()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.copies(docs).agg({"copies": "sum"}).first()[0]


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_words(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((x["doc_id"], x["size"], x["target"], x["taken"]) for x in mixing.mixed_words(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_sources_of_any_kind(spark):
    """An empty name, a name of many letters, many sources, one document beyond all others."""
    rows = [(i, "w " * (1 + i % 7), f"s{i % 400:03d}", 1) for i in range(2000)]
    rows += [(5000, "w " * 50_000, "", 1), (5001, "x y", "n" * 10_000, 1), (5002, "a b c", None, 1), (5003, None, "zero", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, order int")
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    plan = mixing.copies(docs).toPandas()
    plan["source"] = plan["source"].astype(object).where(plan["source"].notna(), None)
    for s, t in want.items():
        g = plan[plan["source"].isna()] if s is None else plan[plan["source"] == s]
        assert (g["source_size"] == sizes[s]).all() and abs(g["target"].iloc[0] - t) < 1e-6 * max(1, t)
        assert abs((g["copies"] * g["size"]).sum() - t) <= g["size"].max()


def test_a_dual_that_is_not_solved_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(RuntimeError, match="1 Newton steps"):
        mixing.copies(make(spark)[1])
