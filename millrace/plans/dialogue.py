"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dialogue as D
from millrace.plans.base import Inline, literal, query, table

re = literal
ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(q, {re(D.group(p))}) THEN '{n}'" for n, p in D.ROUTES) + f" ELSE '{D.DEFAULT_ROUTE}' END"
QUERIES = Inline("id int, q string", list(enumerate((
    "hii!", "Good morning", "ok", "what is the gst rate", "tell me a joke", "IS 302 details", "which standard applies to helmets", "is it mandatory for import", "how do i apply for certification",
    "licence renewal fee", "scheme ii", "what is hallmark", "gold purity", "something else", "qco for a song", "Which products are covered under the order",
))), key="id", vary="q")
WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"
GOOD = "role IN ('user', 'assistant') AND text IS NOT NULL AND trim(text) <> ''"
PAST = f"""
good AS (SELECT conv_id, turn, role, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS past FROM conversations WHERE {GOOD}),
need AS (SELECT *, coalesce(len(past), 0) > 0 AND NOT regexp_matches(text, {re(D.CHITCHAT)}) AND (regexp_matches(text, {re(D.REFERENTIAL)}) OR regexp_matches(text, {re(D.ELLIPTIC)}) OR {WORDS.format('text')} <= 4) AS needs FROM good WHERE role = 'user')
"""
WORDY = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_/]{{3,}}')"
DISTINCT = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda z: list_position({0}, z[1]) = z[2]), lambda z: z[1])"
STOP = "[" + ", ".join(map(literal, [*T.STOPWORDS, *T.CARRY_NOISE])) + "]"


@query(f"SELECT id, q, {ROUTE_SQL.replace('(q,', '(lower(trim(q)),')} AS route FROM {QUERIES.sql()}")
def route_fixture(spark, d):
    return QUERIES.over(spark, d).withColumn("route", D.route(F.col("q")))


@query(f"SELECT conv_id, turn, {ROUTE_SQL.replace('(q,', '(lower(trim(text)),')} AS route FROM conversations WHERE role = 'user'")
def route_queries(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", D.route(F.col("text")).alias("route"))


@query(f"WITH {PAST} SELECT conv_id, turn, needs FROM need")
def needs_context(spark, d):
    return D.resolve(table(spark, d, "conversations")).select("conv_id", "turn", "needs")


@query(f"""WITH {PAST}, u AS (SELECT conv_id, turn, text, list_filter(list_transform(list_filter(list_reverse(past), lambda m: m.role = 'user'), lambda m: list_filter({WORDY.format('m.text')}, lambda w: NOT list_contains({STOP}, w) AND NOT regexp_matches(w, '^[0-9]+$'))), lambda w: len(w) > 0)[1] AS w FROM need WHERE needs),
t AS (SELECT conv_id, turn, text, {DISTINCT.format('coalesce(w, [])')} AS w FROM u),
f AS (SELECT conv_id, turn, text, list_filter(w, lambda x: NOT list_contains({WORDY.format('text')}, x))[1:6] AS terms FROM t)
SELECT conv_id, turn, array_to_string(terms, ' ') AS terms, CASE WHEN len(terms) > 0 THEN text || ' ' || array_to_string(terms, ' ') ELSE text END AS resolved FROM f""")
def topic_terms(spark, d):
    rows = D.resolve(table(spark, d, "conversations")).where("needs")
    return rows.select("conv_id", "turn", F.array_join("terms", " ").alias("terms"), "resolved")


@query(f"SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE {GOOD}) WHERE back <= 12")
def history_window(spark, d):
    return D.history(table(spark, d, "conversations")).select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


@query("SELECT conv_id, turn, length(text) BETWEEN 3 AND 1000 AS ok FROM conversations WHERE role = 'user'")
def query_bounds(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", D.query_ok(F.col("text")).alias("ok"))


@query(f"""WITH a AS (SELECT l_orderkey AS k, string_agg('IS ' || l_partkey, ', ' ORDER BY l_linenumber, 'IS ' || l_partkey) AS answer,
 list('' || l_partkey) FILTER (l_linenumber % 2 = 1) AS allowed FROM lineitem GROUP BY l_orderkey),
t AS (SELECT k, list_transform(string_split(answer, ', '), lambda x: replace(x, 'IS ', '')) AS n, coalesce(allowed, []) AS allowed FROM a)
SELECT k, array_to_string(list_transform(n, lambda x: CASE WHEN len(x) BETWEEN 2 AND 5 AND list_contains(allowed, x) THEN 'IS ' || x ELSE {literal(D.UNVERIFIED)} END), ', ') AS answer,
 CAST(len(list_filter(n, lambda x: NOT (len(x) BETWEEN 2 AND 5 AND list_contains(allowed, x)))) AS INTEGER) AS removed FROM t""")
def citation_guardrail(spark, d):
    item = table(spark, d, "lineitem").withColumn("t", F.concat(F.lit("IS "), F.col("l_partkey").cast("string")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"]), ", ")
    context = F.array_join(F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, F.col("t"))), " ; ")
    said = item.groupBy(F.col("l_orderkey").alias("k")).agg(listed.alias("a"), context.alias("c"))
    clean, removed = D.guard(F.col("a"), F.col("c"))
    return said.select("k", clean.alias("answer"), F.size(removed).alias("removed"))


THOUGHTS = Inline("id int, body string", [(1, "a <think>x</think> b"), (2, "<THINK>x\ny</THINK>z"), (3, "<think>never closed"), (4, "plain"), (5, "<think>a</think><think>b</think> c "), (6, "x <think>open")], key="id", vary="body")


@query(f"SELECT id, trim(regexp_replace(regexp_replace(body, '(?is)<think>.*?</think>', '', 'g'), '(?is)^\\s*<think>.*$', '')) AS clean FROM {THOUGHTS.sql()}")
def strip_reasoning(spark, d):
    return THOUGHTS.over(spark, d).select("id", T.strip_thinking(F.col("body")).alias("clean"))


@query("""WITH h AS (SELECT o_custkey AS query_id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS kind, o_orderkey AS position,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '/doc/' || (o_orderkey % 11) END AS url, 0.5 AS similarity FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY kind, position) AS n FROM h WHERE NOT (kind = 0 AND url = ''))
SELECT query_id, url, CASE WHEN kind = 0 THEN 1.0 ELSE similarity END AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY kind, position) AS nth FROM f WHERE n = 1""")
def source_list(spark, d):
    hits = table(spark, d, "orders").selectExpr(
        "o_custkey as query_id", "case when o_orderstatus = 'O' then 0 else 1 end as kind", "o_orderkey as position",
        "case when o_orderkey % 7 = 0 then '' else concat('/doc/', o_orderkey % 11) end as url", "0.5D as similarity",
    )
    return D.source_list(hits, ["query_id"]).select("query_id", "url", "similarity", F.col("nth").cast("long").alias("nth"))


@query(r"""SELECT lang, source, n, md5(block) AS block FROM (SELECT lang, source, count(*) AS n, array_to_string(list_transform(list_zip(list(source ORDER BY doc_id), list(text ORDER BY doc_id), range(1, count(*) + 1)),
 lambda z: '[Source ' || z[3] || ': ' || z[1] || ']' || chr(10) || 'URL: /' || z[1] || chr(10) || z[2]), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS block
 FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS hit FROM documents) WHERE hit <= 5 GROUP BY lang, source)""")
def context_block(spark, d):
    """A context for each language and source, of its first five documents as the hits."""
    hits = table(spark, d, "documents").withColumn("hit", F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))).where("hit <= 5")
    rows = F.array_sort(F.collect_list(F.struct("hit", F.col("source").alias("title"), F.concat(F.lit("/"), F.col("source")).alias("url"), "text")))
    grouped = hits.groupBy("lang", "source").agg(F.count("*").alias("n"), rows.alias("h"))
    return grouped.select("lang", "source", "n", F.md5(D.context_block(F.col("h")).cast("binary")).alias("block"))


FACTS = Inline("id int, route string, n_rows int, n_chunks int, confident boolean", [
    (1, "greeting", 0, 0, False), (2, "faq_rag", 0, 0, False), (3, "structured_lookup", 0, 3, True), (4, "faq_rag", 0, 3, False), (5, "structured_lookup", 2, 0, False), (6, "out_of_scope", 1, 1, True), (7, "procedure_rag", 0, 2, True),
], key="id")


@query(f"""SELECT id, CASE WHEN route IN ('greeting', 'out_of_scope') THEN route WHEN n_rows = 0 AND n_chunks = 0 THEN 'declined' WHEN route = 'structured_lookup' AND n_rows = 0 THEN 'noted'
 WHEN NOT confident AND n_rows = 0 THEN 'low_confidence' ELSE 'answered' END AS kind FROM {FACTS.sql()}""")
def answer_decision(spark, d):
    return FACTS.over(spark, d).select("id", D.decision(F.col("route"), F.col("n_rows"), F.col("n_chunks"), F.col("confident")).alias("kind"))
