"""Evaluation queries: results derived from events, audits of documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import evaluation as E
from millrace.plans.base import Inline, literal, query, table
from millrace.plans.retrieval import ROUND

R4 = lambda x: ROUND.format(x, 4)
COLS = {
    "category": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END",
    "difficulty": "CASE event_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "error": "CASE WHEN event_id % 19 = 0 THEN 'timeout' END",
    "latency_s": "value",
    "route_correct": "CASE WHEN event_id % 5 < 4 THEN (event_id % 2) * 1.0e0 END",
    "refusal_correct": "CASE WHEN event_id % 7 < 6 THEN 1.0e0 ELSE 0.0e0 END",
    "retrieval_recall": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 3) / 2.0e0 END",
    "mrr": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1.0e0 / (1 + event_id % 4) END",
    "answer_relevance": "(event_id % 11) / 10.0e0",
    "citation_accuracy": "CASE WHEN event_id % 13 = 0 THEN 0.0e0 ELSE 1.0e0 END",
    "faithfulness": "1 - 0.3e0 * (event_id % 4)",
}
RESULTS = "r AS (SELECT event_id, user_id, " + ", ".join(f"{v} AS {k}" for k, v in COLS.items()) + " FROM events)"
MEANS = ", ".join(f"{R4(f'avg({c})')} AS {m}" for m, c in E.METRICS.items())
SUMMARY = f"s AS (SELECT count(*) AS total, count(error) AS errors, {MEANS}, {R4('avg(latency_s)')} AS mean_latency FROM r)"
GROUPED = f"count(*) AS n, {R4('avg(refusal_correct)')} AS refusal, {R4('avg(answer_relevance)')} AS relevance, {R4('avg(route_correct)')} AS route, {R4('avg(faithfulness)')} AS faithfulness FROM r GROUP BY 1"


def results(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id", *[f"{v} as {k}" for k, v in COLS.items()])


@query(f"WITH {RESULTS}, {SUMMARY} SELECT * FROM s")
def eval_summary(spark, d):
    return E.summary(results(spark, d))


@query(f"WITH {RESULTS} SELECT coalesce(category, 'unknown') AS category, {GROUPED}")
def eval_by_category(spark, d):
    return E.grouped(results(spark, d), "category")


@query(f"WITH {RESULTS} SELECT difficulty, {GROUPED}")
def eval_by_difficulty(spark, d):
    return E.grouped(results(spark, d), "difficulty")


@query(f"""WITH {RESULTS}, o AS (SELECT category, latency_s, row_number() OVER (PARTITION BY category ORDER BY latency_s) AS rn, count(*) OVER (PARTITION BY category) AS n FROM r WHERE latency_s > 0)
SELECT category, latency_s AS p95 FROM o WHERE rn = greatest(1, CAST(floor(n * 95 / 100) AS BIGINT))""")
def eval_percentile(spark, d):
    return E.index_percentile(results(spark, d), "latency_s", 95, ("category",))


UNPIVOT = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, {t} AS least FROM s" for m, t in E.THRESHOLDS.items())


@query(f"WITH {RESULTS}, {SUMMARY}, g AS ({UNPIVOT}) SELECT metric, value, CAST(least AS DOUBLE) AS least FROM g WHERE value < least")
def eval_gate(spark, d):
    return E.gate(E.summary(results(spark, d)))


@query(f"WITH {RESULTS}, d AS (SELECT user_id AS run, {R4('avg(answer_relevance)')} AS relevance FROM r GROUP BY user_id) SELECT run, relevance, relevance - lag(relevance) OVER (ORDER BY run) AS change FROM d")
def run_comparison(spark, d):
    runs = results(spark, d).groupBy(F.col("user_id").alias("run")).agg(E.mean("answer_relevance").alias("relevance"))
    return E.compare(runs, "relevance")


ANSWERS = Inline(
    "id int, expected_route string, route string, must_refuse boolean, answer string, expected_number string, expected_phrases array<string>, titles array<string>, stripped array<string>, error string",
    [
        (1, "faq", "faq", False, "Helmets follow IS 4151.", "IS 4151", ["helmets", "4151"], ["Cement", "IS 4151 helmets"], [], None),
        (2, "faq", "x", True, "I cannot find that", None, [], [], ["IS 1"], None), (3, None, "faq", False, "outside my scope", "IS 44", ["a", "b"], ["IS 45"], ["a", "b", "c", "d"], None),
        (4, "faq", None, False, "", "IS 5", ["q"], [], [], "timeout"), (5, "faq", "faq", True, "Sure", "none", ["x"], ["y"], ["z", "w"], None),
    ],
)
REFUSED = "(" + " OR ".join(f"contains(lower(answer), {literal(p)})" for p in T.REFUSALS) + ")"


@query(f"""WITH a AS (SELECT *, {REFUSED} AS refused, regexp_extract(expected_number, '\\d{{1,5}}') AS digits FROM {ANSWERS.sql()}),
b AS (SELECT *, list_position(list_transform(titles, lambda t: contains(t, digits)), true) AS pos FROM a)
SELECT id, CASE WHEN error IS NULL AND expected_route IS NOT NULL THEN (route = expected_route)::INT::DOUBLE END AS route_correct,
 CASE WHEN error IS NULL THEN (refused = must_refuse)::INT::DOUBLE END AS refusal_correct,
 CASE WHEN error IS NULL AND digits <> '' THEN (coalesce(pos, 0) > 0)::INT::DOUBLE END AS retrieval_recall,
 CASE WHEN error IS NULL AND digits <> '' THEN CASE WHEN coalesce(pos, 0) > 0 THEN 1.0 / pos ELSE 0 END::DOUBLE END AS mrr,
 CASE WHEN error IS NULL AND must_refuse THEN refused::INT::DOUBLE WHEN error IS NULL AND len(expected_phrases) > 0 THEN len(list_filter(expected_phrases, lambda p: contains(lower(answer), lower(p)))) / len(expected_phrases)::DOUBLE END AS answer_relevance,
 CASE WHEN error IS NULL THEN (len(stripped) = 0)::INT::DOUBLE END AS citation_accuracy,
 CASE WHEN error IS NULL THEN {R4('greatest(0, 1 - 0.3e0 * least(len(stripped), 3))')} END AS faithfulness FROM b""")
def mrr_recall(spark, d):
    rows = ANSWERS.df(spark).withColumn("sources", F.transform("titles", lambda t: F.struct(t.alias("title"), F.lit("").alias("url"))))
    out = E.row_metrics(rows).withColumn("faithfulness", T.rounded(F.col("faithfulness"), 4))
    return out.select("id", "route_correct", "refusal_correct", "retrieval_recall", "mrr", "answer_relevance", "citation_accuracy", "faithfulness")


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (d.text IS NOT NULL AND d.text <> '') AS text, count(*) FILTER (lang <> '') AS lang, count(*) FILTER (l.quality <> 0) AS quality, count(*) FILTER (l.toxic <> 0) AS toxic
 FROM documents d LEFT JOIN labels l USING (doc_id)), u AS (SELECT 'text' AS field, text AS filled, n FROM c UNION ALL SELECT 'lang', lang, n FROM c UNION ALL SELECT 'quality', quality, n FROM c UNION ALL SELECT 'toxic', toxic, n FROM c)
SELECT field, filled, {ROUND.format('filled / n::DOUBLE', 3)} AS share FROM u""")
def metadata_coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return E.coverage(rows, ["text", "lang", "quality", "toxic"])


@query("""WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, min(n_chars) AS least, max(CASE WHEN rn = n // 2 + 1 THEN n_chars END) AS median, max(n_chars) AS most FROM o GROUP BY source""")
def document_size_stats(spark, d):
    return E.size_stats(table(spark, d, "documents"), ["source"], "n_chars")


@query("SELECT count(DISTINCT 'IS ' || l_partkey) AS distinct_references, count(*) AS mentions FROM lineitem")
def distinct_references(spark, d):
    said = table(spark, d, "lineitem").select(F.explode(T.references(F.concat(F.lit("see IS "), F.col("l_partkey").cast("string")))).alias("ref"))
    return said.agg(F.countDistinct("ref").alias("distinct_references"), F.count("*").alias("mentions"))


@query("SELECT lower(p_brand) AS brand, count(*) AS n, count(*) FILTER (lower(p_type) LIKE 'promo%') AS promo FROM part GROUP BY 1")
def status_totals(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.count_if(F.lower("p_type").startswith("promo")).alias("promo"))


@query("SELECT doc_id, n_chars, rn AS place FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 20")
def longest_documents(spark, d):
    """A report of the 20 longest; the limit is the feature."""
    top = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")).cast("long"))
