"""Set operations, keyed upserts and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import html as H
from millrace.plans.base import query, table
from millrace.plans.structure import LINKS
from millrace.sources import tables as S
from millrace.streaming import thinking

OLD = "o AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS seq, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F')"
NEW = "n AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey AS seq, -o_totalprice AS v FROM orders WHERE o_orderstatus = 'F')"
BOTH = f"WITH {OLD}, {NEW}, b AS (SELECT *, 0 AS side FROM o UNION ALL SELECT *, 1 FROM n)"


def _sides(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderpriority as p", "o_orderkey as seq", "o_totalprice as v", "o_orderstatus as s")
    return rows.where("s <> 'F'").drop("s"), rows.where("s = 'F'").withColumn("v", -F.col("v")).drop("s")


@query(BOTH + " SELECT k, p, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY side, seq) AS n FROM b) WHERE n = 1")
def upsert_ignore(spark, d):
    return S.upsert_ignore(*_sides(spark, d), ["k", "p"], "seq")


@query(BOTH + " SELECT k, p, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k, p ORDER BY side DESC, seq DESC) AS n FROM b) WHERE n = 1")
def upsert_replace(spark, d):
    return S.upsert_replace(*_sides(spark, d), ["k", "p"], "seq")


@query(LINKS + " SELECT DISTINCT f.url FROM f ANTI JOIN pages USING (url)")
def anti_new_urls(spark, d):
    pages = table(spark, d, "pages")
    return H.links(pages, None).select("url").distinct().join(pages.select("url"), "url", "left_anti")


@query("SELECT 'page' AS kind, page_id AS id, url AS name FROM pages UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def union_sources(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    parts = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return pages.unionByName(parts, allowMissingColumns=True)


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def except_serials(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return keys.subtract(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))


@query("""SELECT 'parse' AS kind, p_brand, '' AS reason, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 40) GROUP BY p_brand
UNION ALL SELECT 'denied', p_brand, 'size ' || least_size, count(*) FROM part JOIN (SELECT p_brand, min(p_size) AS least_size FROM part WHERE p_retailprice < 1000 GROUP BY p_brand) USING (p_brand) GROUP BY ALL""")
def allowed_files(spark, d):
    parts = table(spark, d, "part").withColumn("filename", F.col("p_brand"))
    deny = parts.where("p_retailprice < 1000").groupBy("filename").agg(F.concat(F.lit("size "), F.min("p_size").cast("string")).alias("reason"))
    listed, denied = S.allowed(parts, parts.where("p_size > 40").select("filename").distinct(), deny)
    counts = lambda rows, kind: rows.groupBy("p_brand", "reason").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "p_brand", "reason", "n")
    return counts(listed.withColumn("reason", F.lit("")), "parse").unionByName(counts(denied, "denied"))


@query("""SELECT user_id AS stream_id, event_id AS seq, '{"type":"' || event_type || '"}' AS payload FROM events""")
def event_payloads(spark, d):
    rows = table(spark, d, "events").selectExpr("user_id as stream_id", "event_id as seq", "event_type as type")
    told = S.events(rows)
    return told.select("stream_id", "seq", F.regexp_extract("event", r"^data: (.*)\n\n$", 1).alias("payload"))


@query("""WITH e AS (SELECT user_id AS stream_id, event_id AS seq, event_type AS t, CASE event_id % 10 WHEN 3 THEN 1 WHEN 6 THEN 0 END AS tag FROM events),
f AS (SELECT *, coalesce(last(tag IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM e),
o AS (SELECT stream_id, seq, CASE WHEN tag = 1 THEN CASE WHEN inside THEN '' ELSE 'a' END WHEN tag = 0 THEN CASE WHEN inside THEN 'z' ELSE t || '</think>z' END WHEN inside THEN '' ELSE t END AS text FROM f)
SELECT stream_id, seq, text FROM o WHERE text <> ''""")
def stream_think_strip(spark, d):
    """Token deltas made of events; tags open and close inside a stream."""
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("a<think>"), "event_type")).when(F.col("event_id") % 10 == 6, F.concat("event_type", F.lit("</think>z"))).otherwise(F.col("event_type")).alias("delta"),
    )
    return thinking.strip_batch(rows)
