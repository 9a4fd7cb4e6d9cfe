import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ordinal

SF = "/root/testdata/sf0.1"


def made(seed, n=900):
    """Texts whose grade shows: a bad word lowers it by one, shouting by one."""
    g = np.random.default_rng(seed)
    texts, grades = [], []
    for _ in range(n):
        words = [f"w{int(x)}" for x in g.zipf(1.3, g.integers(20, 120)) % 3000]
        bad, loud = g.random() < 0.2, g.random() < 0.2
        if bad:
            words[g.integers(len(words))] = g.choice(["vile", "foul", "rank"])
        text = " ".join(words)
        texts.append((text.upper() + "!!!!" * 20 if loud else text).encode())
        grades.append(2 - bad - loud)
    return texts, np.array(grades)


def test_grades_of_held_out_texts():
    model = ordinal.fit(*made(1, 2500))
    assert (np.diff(model.thresholds) > 0).all()
    texts, grades = made(2)
    tails = model.tails(texts)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert ((tails[:, 1] >= 0.5) == (grades == 2)).mean() > 0.95
    assert abs(tails.sum(axis=1) - grades).mean() < 0.3


def test_the_fit_is_the_optimum_of_the_likelihood():
    """Against a likelihood written out rating by rating: its slope is zero in every direction."""
    import math

    g = np.random.default_rng(4)
    n, k = 60, 5
    doc, col = np.repeat(np.arange(n), 2), g.integers(0, k, 2 * n)
    form, grades = g.random((n, 3)), g.integers(0, 3, n)

    def brute(p):
        theta = [p[k + 3], p[k + 3] + math.exp(p[k + 4])]
        total = 0.0
        for i in range(n):
            s = sum(p[c] for d, c in zip(doc, col) if d == i) + sum(p[k + j] * form[i, j] for j in range(3))
            tail = [1.0, *(1 / (1 + math.exp(t - s)) for t in theta), 0.0]
            total -= math.log(tail[grades[i]] - tail[grades[i] + 1])
        return total / n + 0.005 * sum(x * x for x in p[: k + 3]) + 5e-5 * (p[k + 3] ** 2 + p[k + 4] ** 2)

    f = lambda p: ordinal.loss(p, doc, col, form, grades, k, 2, 0.01)
    best = ordinal.descend(f, np.zeros(k + 5))
    assert abs(f(best)[0] - brute(best)) < 1e-12
    for i in range(k + 5):
        step = np.zeros(k + 5)
        step[i] = 1e-4
        assert abs(brute(best + step) - brute(best - step)) / 2e-4 < 1e-5
        assert min(brute(best + step * 100), brute(best - step * 100)) > brute(best)
    with pytest.raises(RuntimeError, match="after 2 steps"):
        ordinal.descend(f, np.zeros(k + 5), steps=2)


def test_odd_samples():
    assert ordinal.fit([], np.zeros(0, dtype=int)).tails([b"", b"x"]).shape == (2, 2)
    one = ordinal.fit([b"a b", b"c"], np.array([2, 2]))
    assert np.isfinite(one.tails([b"", b"a", b"\xc3\xa9" * 9])).all()


def test_rows_and_columns_stay(spark):
    rows = [(1, "fine words here", "k", 1), (1, "fine words here", "k", 1), (None, None, None, None), (2, "", "k", 2), (3, "x " * 90_000, "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, _n int")
    model = ordinal.fit(*made(1, 500))
    graded = ordinal.grade(docs, model)
    assert graded.count() == 5 and graded.where("p_grade_1 < p_grade_2 or expected_grade < 0 or expected_grade > 2").count() == 0
    kept = ordinal.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == graded.where("keep").count()
    assert ordinal.grade(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert ordinal.train(docs, labels).thresholds.shape == (2,)
    assert ordinal.train(docs, labels.limit(0)).thresholds.shape == (2,)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_ratings(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = ordinal.train(docs, labels.where("doc_id % 4 <> 0"))
    got = ordinal.grade(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    print({(r["good"], r["keep"]): r["count"] for r in got.groupBy("good", "keep").count().collect()})
    counts = {(r["good"], r["keep"]): r["count"] for r in got.groupBy("good", "keep").count().collect()}
    assert counts.get((True, False), 0) <= 0.02 * counts[True, True]
    assert counts.get((False, True), 0) <= 0.3 * counts[False, False]
