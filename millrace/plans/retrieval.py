"""Retrieval queries: every benchmark passage against all documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import lookup
from millrace.operators import retrieval as R
from millrace.plans.base import query, table

TOKENS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
ROUND = "floor(({0}) * 1e{1} + 0.5) / 1e{1}"
VEC = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"

LEXICAL = f"""
tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
posts AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
whole AS (SELECT count(*) AS n, avg(len({TOKENS.format('text')})) AS avgdl FROM documents),
stats AS (SELECT term, count(*) AS df, ln((SELECT n FROM whole) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posts GROUP BY term),
weight AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM stats) ELSE idf END AS idf FROM stats),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM documents),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, {ROUND.format('sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM whole))))', 6)} AS score
 FROM asked JOIN weight USING (term) JOIN posts USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
allpairs AS (SELECT b.item_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN scores s ON s.item_id = b.item_id AND s.doc_id = d.doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM allpairs) WHERE rank <= 12)
"""
NEAR = f"""
unit AS (SELECT vec_id, {VEC.format('embedding')} AS v FROM embeddings),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM (
 SELECT b.item_id, d.vec_id AS doc_id, {ROUND.format('list_dot_product(d.v, q.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(q.v, q.v)))', 6)} AS similarity
 FROM benchmark b JOIN unit q ON q.vec_id = b.item_id CROSS JOIN unit d)) WHERE rank <= 12)
"""
FUSED = f"""
paired AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.similarity AS sim, a.rank AS dr, b.score, b.rank AS lr
 FROM near a FULL JOIN lex b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
f1 AS (SELECT *, {ROUND.format('coalesce(0.6 / (60 + dr), 0) + coalesce(0.4 / (60 + lr), 0)', 9)} AS fused, max(score) OVER (PARTITION BY item_id) AS top, max(dr) OVER (PARTITION BY item_id) AS anyd FROM paired),
f2 AS (SELECT *, {ROUND.format('CASE WHEN dr IS NOT NULL THEN sim WHEN anyd IS NOT NULL THEN 0.0 WHEN top > 0 THEN 0.85 * score / top ELSE 0.0 END', 4)} AS similarity,
 row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, coalesce(dr, 1000000 + lr)) AS position FROM f1),
fused AS (SELECT item_id, doc_id, fused, position, similarity FROM f2 WHERE position <= 12)
"""
FINAL = """
pref AS (SELECT f.*, d.source IN ('src1', 'src2', 'src3') AS wanted FROM fused f JOIN documents d USING (doc_id)),
cand AS (SELECT * EXCLUDE (wanted) FROM (SELECT *, bool_or(wanted) OVER (PARTITION BY item_id) AS anyw FROM pref) WHERE wanted OR NOT anyw)
"""


def _lexical(spark, d):
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _near(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").select("item_id").join(vectors, F.col("item_id") == F.col("vec_id"))
    return R.dense(vectors, asked.select("item_id", "embedding"))


def _fused(spark, d):
    return R.fuse(_near(spark, d), _lexical(spark, d))


def _facet(spark, d, hits):
    return hits.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query(f"WITH {LEXICAL} SELECT item_id, doc_id, score, rank FROM lex")
def bm25_topk(spark, d):
    return _lexical(spark, d).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LEXICAL} SELECT term, df, {ROUND.format('idf', 6)} AS idf FROM stats")
def bm25_term_stats(spark, d):
    docs = table(spark, d, "documents")
    return R.term_stats(R.postings(docs), R.corpus_stats(docs)).withColumn("idf", T.rounded(F.col("idf"), 6))


@query(f"WITH {LEXICAL} SELECT n, {ROUND.format('avgdl', 6)} AS avgdl, (SELECT count(*) FROM stats) AS terms, {ROUND.format('(SELECT avg(idf) FROM stats)', 6)} AS mean_idf FROM whole")
def bm25_corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    whole = R.corpus_stats(docs)
    stats = R.term_stats(R.postings(docs), whole).agg(F.count("*").alias("terms"), T.rounded(F.avg("idf"), 6).alias("mean_idf"))
    return whole.select("n", T.rounded(F.col("avgdl"), 6).alias("avgdl")).join(stats, how="cross")


@query(f"WITH {NEAR} SELECT item_id, doc_id, similarity, rank FROM near")
def dense_topk(spark, d):
    return _near(spark, d).select("item_id", "doc_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {NEAR} SELECT n.item_id, count(*) AS hits, count(*) FILTER (v.label = q.label) AS agree
 FROM near n JOIN embeddings v ON v.vec_id = n.doc_id JOIN embeddings q ON q.vec_id = n.item_id GROUP BY n.item_id""")
def dense_label_agreement(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _near(spark, d).join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    own = labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("own"))
    return hits.join(own, "item_id").groupBy("item_id").agg(F.count("*").alias("hits"), F.count_if(F.col("label") == F.col("own")).alias("agree"))


@query(f"WITH {LEXICAL}, {NEAR}, {FUSED} SELECT * FROM fused")
def hybrid_rrf(spark, d):
    return _fused(spark, d).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {LEXICAL}, {NEAR}, {FUSED} SELECT item_id, doc_id, fused, similarity, row_number() OVER (PARTITION BY item_id ORDER BY position) AS final FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, position) AS r FROM fused) WHERE r <= 5""")
def hybrid_final(spark, d):
    return R.select_final(_fused(spark, d)).select("item_id", "doc_id", "fused", "similarity", F.col("final").cast("long").alias("final"))


@query(f"WITH {LEXICAL}, {NEAR}, {FUSED} SELECT item_id, max(similarity) AS confidence, max(similarity) >= 0.3 AS confident FROM fused GROUP BY item_id")
def hybrid_confidence(spark, d):
    return R.confidence(R.select_final(_fused(spark, d)))


@query(f"WITH {LEXICAL}, near AS (SELECT 0 AS item_id, 0 AS doc_id, 0.0 AS similarity, 0 AS rank WHERE false), {FUSED} SELECT item_id, doc_id, similarity, position FROM fused")
def hybrid_lexical_only(spark, d):
    none = spark.createDataFrame([], "item_id long, doc_id long, similarity double, rank int")
    return R.fuse(none, _lexical(spark, d)).select("item_id", "doc_id", "similarity", F.col("position").cast("long").alias("position"))


@query(f"WITH {LEXICAL}, {NEAR}, {FUSED}, {FINAL} SELECT item_id, doc_id, source, similarity, position FROM cand JOIN documents USING (doc_id)")
def category_preference(spark, d):
    hits = R.prefer(_facet(spark, d, _fused(spark, d)), F.col("source").isin("src1", "src2", "src3"))
    return hits.select("item_id", "doc_id", "source", "similarity", F.col("position").cast("long").alias("position"))


PRODUCTS = """
products AS (SELECT p_partkey AS id, p_name AS product_name, 'IS ' || p_partkey AS is_standard_number, p_type AS standard_title,
 CASE WHEN p_brand < 'Brand#3' THEN p_brand || ' Quality Control Order' ELSE p_brand || ' simplified procedure' END AS qco_reference,
 CASE p_partkey % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'table_parse' ELSE 'text_proximity' END AS extraction_method FROM part)
"""


def products(spark, d):
    """Records in the shape of the product table, made of parts."""
    return table(spark, d, "part").selectExpr(
        "p_partkey as id", "p_name as product_name", "concat('IS ', p_partkey) as is_standard_number", "p_type as standard_title",
        "case when p_brand < 'Brand#3' then concat(p_brand, ' Quality Control Order') else concat(p_brand, ' simplified procedure') end as qco_reference",
        "case p_partkey % 3 when 0 then 'curated' when 1 then 'table_parse' else 'text_proximity' end as extraction_method",
    )


ASKED = [(1, "which standard applies to red plate and is 42"), (2, "is a small widget mandatory, IS 7 or is 7"), (3, "tell me about large green"), (4, "zzz"), (5, "fee is 10 for steel")]
LOOKUP = """
WITH asked AS (SELECT * FROM (VALUES (1, 'which standard applies to red plate and is 42'), (2, 'is a small widget mandatory, IS 7 or is 7'), (3, 'tell me about large green'), (4, 'zzz'), (5, 'fee is 10 for steel')) AS t(query_id, query)),
{products},
kw AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9_/]{{3,}}'), lambda x: NOT list_contains(string_split('{stop}', ' '), x)))) AS kw FROM asked),
rf AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '\\bis\\s*(\\d{{1,5}})', 1)) AS ref FROM asked),
rows AS (SELECT *, regexp_extract_all(lower(product_name), '[a-z0-9_]+') AS a, regexp_extract_all(lower(standard_title), '[a-z0-9_]+') AS b,
 list_concat(regexp_extract_all(lower(is_standard_number), '[a-z0-9_]+'), regexp_extract_all(lower(qco_reference), '[a-z0-9_]+')) AS c FROM products WHERE extraction_method IN ('curated', 'table_parse')),
kws AS (SELECT query_id, id, sum(CASE WHEN list_contains(a, kw) THEN 2.0 WHEN list_contains(b, kw) THEN 1.0 WHEN list_contains(c, kw) THEN 0.5 ELSE 0 END) AS s FROM kw CROSS JOIN rows GROUP BY ALL),
rfs AS (SELECT query_id, id, 5.0 * count(*) AS s FROM rf JOIN rows ON list_contains(regexp_extract_all(is_standard_number, '\\d+'), ref) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(s) AS s FROM (SELECT * FROM kws UNION ALL SELECT * FROM rfs) GROUP BY ALL HAVING sum(s) > 0),
fin AS (SELECT query_id, id, product_name, s + CASE WHEN qco_reference LIKE '%Quality Control Order' THEN 1.5e0 ELSE 0 END + CASE WHEN extraction_method = 'curated' THEN 0.5e0 ELSE 0 END AS score FROM sc JOIN rows USING (id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_name, id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM fin)
""".replace("{stop}", " ".join(T.STOPWORDS)).replace("{products}", PRODUCTS).replace("{{", "{").replace("}}", "}")


def _asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


@query(LOOKUP + " SELECT query_id, id, product_name, score, rank FROM rk WHERE rank <= 8 AND score >= greatest(1.0, best / 2)")
def structured_lookup(spark, d):
    return lookup.cut(lookup.structured(products(spark, d), _asked(spark), lookup.ROWS)).select("query_id", "id", "product_name", "score", F.col("rank").cast("long").alias("rank"))


@query(LOOKUP + " SELECT query_id, max(score) AS best, greatest(1.0, max(score) / 2) AS cutoff, count(*) AS scored, count(*) FILTER (score >= greatest(1.0, best / 2)) AS above FROM rk GROUP BY query_id")
def lookup_cutoff(spark, d):
    return lookup.cutoffs(lookup.scored(products(spark, d), _asked(spark)))
