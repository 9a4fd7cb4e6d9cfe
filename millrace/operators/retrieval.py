"""Lexical, dense and fused retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# The ranking constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
CANDIDATES, FINAL, THRESHOLD = 12, 5, 0.30
LEXICAL_WEIGHT, DENSE_WEIGHT, RRF_K = 0.4, 0.6, 60
LEXICAL_ONLY = 0.85


#: Query terms, and query vectors, that are broadcast at once; more queries are taken in blocks.
TERMS, ASKED = 500_000, 4096
#: Bytes of text that a task counts the terms of, and pairs of a query and a vector that it ranks.
DEALT, PAIRS = 8 << 20, 2 << 20


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf of documents(doc_id, text); dl is the length in tokens.

    Texts are dealt out by doc_id, so what is counted by document needs no further
    shuffle. There is a partition for each DEALT bytes of text: a task's counts take
    many times the space of its texts, and partitions left to AQE grow with the input."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT))
    body = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return body.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame, whole: DataFrame) -> DataFrame:
    """term, df and raw idf; ``whole`` is the one row of :func:`corpus_stats`."""
    df = posts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(whole.select("n")), how="cross")
    return df.select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, their average length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col("text")))).alias("avgdl"))


def in_blocks(rows: DataFrame, key: str, most: int, count: int | None = None) -> list[DataFrame]:
    """``rows`` in parts of about ``most`` rows, by a hash of ``key``; the parts may be broadcast."""
    parts = max(1, -(-(rows.count() if count is None else count) // most))
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def bm25(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """item_id, doc_id, score, rank: the k best documents of each query(item_id, text).

    A term more common than half the corpus gets EPSILON times the mean idf of
    all terms. Queries that match fewer than k documents are filled up with
    documents of score 0. Scores are rounded to 6 digits before ranking; of
    equals the larger doc_id is first.

    The weighted terms of a block of queries are broadcast (TERMS rows at most)
    to the postings, which lie by document: a document's scores are summed up
    where it lies, and each partition keeps its k best of a query.
    """
    asked = queries.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
    whole = corpus_stats(docs)
    posts = postings(docs)
    stats = term_stats(posts, whole)
    mean = stats.agg(F.avg("idf").alias("mean_idf"))
    weight = stats.join(F.broadcast(mean), how="cross").select("term", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    shares = posts.join(F.broadcast(whole), how="cross").select("doc_id", "term", share.alias("share"))
    best = None
    for block in in_blocks(asked, "item_id", TERMS):
        wanted = block.join(weight, "term").select("term", "item_id", (F.col("qtf") * F.col("idf")).alias("w"))
        scores = shares.join(F.broadcast(wanted), "term").groupBy("doc_id", "item_id").agg(T.rounded(F.sum(F.col("w") * F.col("share")), 6).alias("score")).select("item_id", "doc_id", "score")
        part = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        best = part if best is None else best.unionByName(part)
    last = docs.select("doc_id").orderBy(F.col("doc_id").desc()).limit(2 * k)
    fill = queries.select("item_id").join(F.broadcast(last), how="cross").withColumn("score", F.lit(0.0))
    both = best.unionByName(fill).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def dense(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """item_id, doc_id, similarity, rank: the k nearest by exact cosine, rounded to 6 digits.

    The query set meets every vector, a block of ASKED queries at a time, which
    is broadcast; Catalyst keeps the k best of each query within the partitions
    before it shuffles (WindowGroupLimit). For that it sorts a partition's pairs,
    so vectors are dealt out, a partition for each PAIRS pairs with a block.
    """
    unit = lambda c: T.l2_normalise(F.col(c))
    dot = F.aggregate(F.zip_with("q", "v", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    asked = queries.select("item_id", unit("embedding").alias("q"))
    order = Window.partitionBy("item_id").orderBy(F.col("similarity").desc(), "doc_id")
    count = queries.count()
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() * min(count, ASKED) // PAIRS))
    units, best = vectors.select("vec_id", "embedding").repartition(parts, "vec_id").select(F.col("vec_id").alias("doc_id"), unit("embedding").alias("v")), None
    for block in in_blocks(asked, "item_id", ASKED, count):
        scored = units.join(F.broadcast(block), how="cross").select("item_id", "doc_id", T.rounded(dot, 6).alias("similarity"))
        part = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = part if best is None else best.unionByName(part)
    return best


def fuse(near: DataFrame, lexical: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Reciprocal-rank fusion: item_id, doc_id, fused, position, similarity.

    Ties keep the dense list's order, then the lexical one's. A lexical hit
    without a dense rank has similarity 0 if the query has dense hits at all,
    else LEXICAL_ONLY times its score's share of the best.
    """
    a = near.select("item_id", "doc_id", F.col("similarity").alias("sim"), F.col("rank").alias("dr"))
    b = lexical.select("item_id", "doc_id", "score", F.col("rank").alias("lr"))
    both = a.join(b, ["item_id", "doc_id"], "full")
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    one = Window.partitionBy("item_id")
    order = one.orderBy(F.col("fused").desc(), F.coalesce("dr", 1_000_000 + F.col("lr")))
    share = F.when(F.max("score").over(one) > 0, LEXICAL_ONLY * F.col("score") / F.max("score").over(one)).otherwise(0.0)
    sim = F.when(F.col("dr").isNotNull(), F.col("sim")).when(F.max("dr").over(one).isNotNull(), 0.0).otherwise(share)
    fused = both.withColumn("fused", T.rounded(part(DENSE_WEIGHT, "dr") + part(LEXICAL_WEIGHT, "lr"), 9)).withColumn("similarity", T.rounded(sim, 4))
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("item_id", "doc_id", "fused", "position", "similarity")


def prefer(hits: DataFrame, wanted: Column) -> DataFrame:
    """Only the preferred hits of a query that has any."""
    any_of = F.max(wanted.cast("int")).over(Window.partitionBy("item_id"))
    return hits.withColumn("_any", any_of).where((F.col("_any") == 0) | wanted).drop("_any")


def select_final(hits: DataFrame, k: int = FINAL) -> DataFrame:
    """The k most similar, in fused order, with their new positions."""
    one = Window.partitionBy("item_id")
    kept = hits.withColumn("_r", F.row_number().over(one.orderBy(F.col("similarity").desc(), "position"))).where(F.col("_r") <= k).drop("_r")
    return kept.withColumn("final", F.row_number().over(one.orderBy("position")))


def confidence(hits: DataFrame) -> DataFrame:
    """item_id, confidence, confident."""
    best = hits.groupBy("item_id").agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("confidence"))
    return best.withColumn("confident", F.col("confidence") >= THRESHOLD)
