"""The pipeline's near-duplicate stage against all pairs at its own threshold."""

import os

import pytest

import corpus_pipeline
from millrace.llm import minhash
from tests.llm.test_minhash import brute_set

SF = "/root/testdata/sf0.001"


def firsts(rows, percent):
    """The smallest doc_id of each group of all-pairs links."""
    sets = [(d, brute_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return sorted(d for d in parent if root(d) == d)


def moderate():
    """Pairs of similarity 0.79, 0.80, 0.84 and 0.85, exactly."""
    rows = []
    for same in (79, 80, 84, 85):
        text = [f"s{same}w{i}" for i in range(same + 4)]
        first = (100 - same) // 2
        for side, more in (("a", first), ("b", 100 - same - first)):
            rows.append((len(rows), " ".join(text + [f"{side}{same}x{i}" for i in range(more)])))
    return rows


def test_links_from_80_percent(spark):
    rows = moderate()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect())
    assert got == firsts(rows, 80) == [0, 1, 2, 4, 6]
    # the query keeps its own
    kept = sorted(r["doc_id"] for r in minhash.near_duplicates(docs).where("kept").collect())
    assert kept == firsts(rows, 85) == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, docs, SF).collect())
    assert got == firsts(rows, 80) != firsts(rows, 85)
