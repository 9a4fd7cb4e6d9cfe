"""The corpus operators' queries with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers

from millrace.llm import automata, bitsliced, hamming, minhash, mixing, ordinal, packing, secrets, tokens, transforms
from millrace.llm.common import table


def op7_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_bitsliced_topk(spark, sf_dir):
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op2_multi_index_hashing(spark, sf_dir):
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark, sf_dir):
    return secrets.summary(secrets.scan(table(spark, sf_dir, "documents")))


def op4_substring_dedup(spark, sf_dir):
    return automata.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark, sf_dir):
    return transforms.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_source_mixing(spark, sf_dir):
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ordinal.grade(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bitsliced_topk, op2_multi_index_hashing, op3_secret_scan, op4_substring_dedup, op5_minhash_near_dedup,
        op6_suffix_array_dedup, op7_token_counts, op8_best_fit_packing, op9_source_mixing, op10_quality_classifier,
    )
}
ORACLE: dict[str, str] = {
    "op1_bitsliced_topk": bitsliced.ORACLE,
    "op3_secret_scan": secrets.ORACLE,
    "op4_substring_dedup": automata.ORACLE,
    "op5_minhash_near_dedup": minhash.ORACLE,
    "op6_suffix_array_dedup": transforms.ORACLE,
}
