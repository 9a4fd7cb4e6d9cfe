"""Queries of the chat and health surfaces."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import quality as Q
from millrace.operators import service as S
from millrace.plans.base import literal, query, table
from millrace.plans.dialogue import DISTINCT, ROUTE_SQL, WORDY
from millrace.plans.gate import VERDICTS
from millrace.plans.retrieval import FUSED, LEXICAL, LOOKUP, NEAR, products


# The lookup's SQL under names of its own, asked by the benchmark's passages.
_NAMES = r"\b(asked|rows|fin|kw|rf|kws|rfs|sc|rk)\b"
PASSAGE_LOOKUP = re.sub(_NAMES, r"lk_\1", re.sub(r"asked AS \(SELECT \* FROM \(VALUES .*\) AS t\(query_id, query\)\)", "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)", LOOKUP)).strip().removeprefix("WITH ")
_FIRST = f"""lk_words AS (SELECT query_id, list_filter({WORDY.format('query')}, lambda x: NOT list_contains({literal(T.STOPWORDS)}, x)) AS w FROM lk_asked),
lk_kw AS (SELECT query_id, unnest(({DISTINCT.format('w')})[1:8]) AS lk_kw FROM lk_words),"""
PASSAGE_LOOKUP = re.sub(r"lk_kw AS \(.*\) AS lk_kw FROM lk_asked\),", lambda _: _FIRST, PASSAGE_LOOKUP)


@query(f"""WITH {LEXICAL}, {NEAR}, {FUSED}, {PASSAGE_LOOKUP},
rt AS (SELECT item_id, {ROUTE_SQL.replace('(q,', '(lower(trim(text)),')} AS route FROM benchmark WHERE length(text) BETWEEN 3 AND 1000),
cut AS (SELECT query_id AS item_id, count(*) AS n_rows FROM lk_rk WHERE rank <= 8 AND score >= greatest(1.0, best / 2) GROUP BY query_id),
chosen AS (SELECT item_id, doc_id, similarity, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, position) AS r FROM fused) WHERE r <= 5),
ch AS (SELECT item_id, count(*) AS n_chunks, max(similarity) AS confidence, array_to_string(list(doc_id ORDER BY position), ',') AS sources FROM chosen GROUP BY item_id)
SELECT item_id, route, coalesce(n_rows, 0) AS n_rows, n_chunks, confidence, CASE WHEN route IN ('greeting', 'out_of_scope') THEN route WHEN n_chunks = 0 AND n_rows IS NULL THEN 'declined' WHEN route = 'structured_lookup' AND n_rows IS NULL THEN 'noted'
 WHEN confidence < 0.3 AND n_rows IS NULL THEN 'low_confidence' ELSE 'answered' END AS kind, sources
FROM rt JOIN ch USING (item_id) LEFT JOIN cut USING (item_id)""")
def chat_answers(spark, d):
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark")
    own = asked.select("item_id").join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    got = S.chat(asked, docs, vectors, own, products(spark, d), "source")
    return got.select("item_id", "route", "n_rows", "n_chunks", "confidence", "kind", F.array_join("sources", ",").alias("sources"))


@query(VERDICTS + """, h AS (SELECT 'index' AS part, 'chunks' AS name, count(*) AS n FROM documents UNION ALL SELECT 'records', 'records', count(*) FROM v UNION ALL SELECT 'records', 'accepted', count(*) FROM v WHERE len(reasons) = 0
 UNION ALL SELECT 'rejected', reason, count(*) FROM (SELECT unnest(reasons) AS reason FROM v) GROUP BY reason) SELECT * FROM h""")
def health_report(spark, d):
    return S.health(table(spark, d, "documents"), products(spark, d))


@query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
 WHERE rn % greatest(1, n // 10) = 0""")
def systematic_sample(spark, d):
    return S.systematic_sample(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 10)


@query(VERDICTS + f""", r AS (SELECT id // 8 AS g, id, rpad(substring(product_name, 1, 45), 45, ' ') || ' ' || rpad(is_standard_number, 20, ' ') || ' ' || rpad('Scheme-I', 28, ' ') || ' Mandatory' AS a,
 rpad(substring(product_name, 1, 52), 52, ' ') || ' ' || rpad(is_standard_number, 20, ' ') || ' ' || substring(qco_reference, 1, 36) AS b, status_basis FROM v JOIN products USING (id, product_name, qco_reference, standard_title) WHERE len(reasons) = 0),
k AS (SELECT g, string_agg(a, chr(10) ORDER BY id) FILTER (status_basis = 'established') AS a, string_agg(b, chr(10) ORDER BY id) FILTER (status_basis <> 'established') AS b FROM r GROUP BY g)
SELECT g, md5(concat_ws(chr(10) || chr(10), CASE WHEN a IS NOT NULL THEN 'STATUS ESTABLISHED' || chr(10) || a END, CASE WHEN b IS NOT NULL THEN 'STATUS NOT ESTABLISHED' || chr(10) || b END)) AS block FROM k""")
def product_context(spark, d):
    claimed = products(spark, d).withColumns({"mandatory_or_voluntary": F.lit("Mandatory"), "scheme_type": F.lit("Scheme-I")})
    good = Q.validate(claimed).where("ok").withColumn("g", F.floor(F.col("id") / 8))
    fields = ["id", "product_name", "is_standard_number", "scheme_type", "mandatory_or_voluntary", "qco_reference", "status_basis"]
    return good.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")).select("g", F.md5(S.product_context(F.col("rows")).cast("binary")).alias("block"))
