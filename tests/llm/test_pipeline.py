"""Each stage against a brute-force version, on the smallest tables."""

import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import ordinal
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_mixing import brute_targets
from tests.llm.test_secrets import brute as brute_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_do_what_brute_force_does(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        kept[i] = (rows(docs), rows(spark.read.parquet(f"{tmp_path}/{i}")))
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == names
    # 0: exactly the rows whose chance of the top grade is one half
    model = ordinal.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    before, after = kept[0]
    tails = model.tails([r[1].encode() for r in before])
    assert sorted(after) == sorted(r for r, t in zip(before, tails) if t[1] >= corpus_pipeline.LEAST)
    assert len(after) > len(before) / 2
    # 1: the smallest id of each group of all-pairs links
    before, after = kept[1]
    first = {d: c for d, _, c in brute_groups([(r[0], r[1]) for r in before], corpus_pipeline.NEAR)}
    assert sorted(after) == sorted(r for r in before if first[r[0]] == r[0])
    # 2: every secret is replaced, nothing else
    before, after = kept[2]
    told = {r[0]: r[1] for r in after}
    for d, text, *_ in before:
        out, at = "", 0
        for a, _, _, b in brute_spans(text):
            if b > at:
                out += text[at:a] + "[SECRET]" if a >= at else ""
                at = b
        assert told[d] == out + text[at:]
    # 3: whole copies, near the targets
    before, after = kept[3]
    times = Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    sizes = {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    taken = Counter()
    for r in after:
        taken[r[3]] += len(r[1].split())
    most = max(len(r[1].split()) for r in before)
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= max(0.05 * t, most)
    # 4: every piece once, in gapless sequences
    before, after = kept[4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(x[:5] for x in after) == want
    places = {}
    for x in after:
        places.setdefault(x[5], []).append((x[6], x[3]))
    for bin_ in places.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(x[3] for x in after)
    assert len(places) <= -(-tokens // 2048) + 2


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    text = " ".join(f"v{i}" for i in range(80))
    base = [
        (1, text, "en", "a", None), (1, text, "en", "a", 5), (2, text + " end", None, "a", 1), (3, "", "en", None, 0), (3, "", "en", None, 0), (4, None, None, None, None),
        (None, text, "en", "b", 1), (None, text, "en", "b", 1), (None, None, "en", "b", 1), (5, long, "en", "b", len(long)), (6, "token=abcdefgh " * 300, "de", "c", 1), (7, "x" * 300_000, "de", "c", 1),
    ]
    extra = [(*r, "k", i, [1]) for i, r in enumerate(base)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, row string, nth int, spans array<int>")
    docs.drop("row", "nth", "spans").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, f"{tmp_path}/in")
        assert out.dtypes == docs.dtypes, name
        got = rows(out)
        assert not rows(step(spark, docs.limit(0), f"{tmp_path}/in"))
        if name == "minhash near-dedup":
            left = sorted((r[0] or 0, len(r[1] or "")) for r in got)
            assert left == [(0, 0), (0, len(text)), (0, len(text)), (1, len(text)), (3, 0), (4, 0), (5, len(long)), (6, 4500), (7, 300_000)]
        if name == "secret scans":
            assert sorted(r[1] or "" for r in got) == sorted((r[1] or "").replace("token=abcdefgh", "[SECRET]") for r in extra)
        if name == "mixing to target weights":
            assert all(n <= 3 for n in Counter(r[6] for r in got).values())
    pieces = rows(corpus_pipeline.STAGES[-1][1](spark, docs, ""))
    assert Counter(p[0] for p in pieces if p[1] == 0) == Counter(r[0] for r in extra)
    assert not rows(corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), ""))
    assert corpus_pipeline.run(spark, f"{tmp_path}/in").count() > 0
