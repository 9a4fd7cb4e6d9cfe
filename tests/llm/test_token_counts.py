import public_tokenizers
import sentencepiece

from millrace.llm import tokens

SP = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_cache_and_odd_rows(spark, tmp_path):
    rows = [(1, "Some words here", "x"), (2, None, "x"), (3, "", "x"), (None, "lost", "x"), (4, "Some words here", "y"), (4, "other text", "y"), (5, "ab " * 5000, "z")] + [(9, "hot", "h")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    cache = f"file://{tmp_path}/cache"
    want = sorted((d or 0, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for d, t, _ in rows)
    for _ in range(2):
        got = sorted((r[0] or 0, *r[1:]) for r in tokens.count_tokens(docs, SP, cache).collect())
        assert got == want
    held = spark.read.parquet(cache)
    assert held.count() == held.select("digest").distinct().count() == 6  # the second run encoded nothing
    assert tokens.count_tokens(docs.limit(0), SP).count() == 0
