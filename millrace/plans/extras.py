"""Further text, table and record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import documents as D
from millrace.operators import proximity, quality
from millrace.plans.base import Inline, literal, query, table
from millrace.plans.retrieval import PRODUCTS, ROUND, VEC, products
from millrace.streaming import thinking

re = literal

NEARBY = Inline("doc int, line_no int, text string, title string", [(1, i, t, "Order A") for i, t in enumerate((
    "Steel tubes", "12", "IS 1161:2014 and IS 3601", "Scheme II", "voluntary", "S. No.", "IS 10", "Copper wire", "penalty of fine applies", "x", "y", "z", "Last item IS 99"))]
    + [(2, 0, "Helmet IS 4151", "Order B"), (2, 1, "984", "Order B"), (2, 2, "IS 5", "Order B")], key="doc")
OK_NAME = f"length(trim(text)) >= 5 AND NOT regexp_matches(trim(text), {re(T.LEGACY_NUMERIC)}) AND NOT regexp_matches(trim(text), {re(T.LEGACY_HEADER)}) AND NOT regexp_matches(trim(text), {re('(?i)^(?:' + T.LEGACY_REFERENCE[4:] + ')$')}) AND regexp_matches(trim(text), '[A-Za-z]{{3,}}')".replace("{{", "{").replace("}}", "}")


def _word(p: str, g: int, default: str) -> str:
    return f"CASE WHEN regexp_extract(context, {re(p)}, {g}) <> '' THEN regexp_extract(context, {re(p)}, {g}) ELSE {literal(default)} END"


@query(f"""WITH g AS (SELECT *, CASE WHEN {OK_NAME} THEN trim(text) END AS good FROM {NEARBY.sql()}),
s AS (SELECT *, row_number() OVER o = 1 AS isfirst, lead(line_no) OVER o IS NULL AS isfinal, last(good IGNORE NULLS) OVER (o ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS above,
 first(good IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS below, string_agg(text, ' ') OVER (o ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS context FROM g WINDOW o AS (PARTITION BY doc ORDER BY line_no)),
r AS (SELECT doc, line_no, substring(coalesce(above, CASE WHEN isfirst THEN good END, below, CASE WHEN isfinal THEN good END, title), 1, 120) AS product_name, {_word(proximity.STATUS_WORD, 1, 'Mandatory')} AS st,
 {_word(proximity.SCHEME, 0, proximity.DEFAULT_SCHEME)} AS scheme_type, substring(regexp_extract(context, {re(proximity.PENALTY)}, 0), 1, 200) AS penalty_clause, unnest(regexp_extract_all(text, {re(T.LEGACY_REFERENCE)})) AS number FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY doc, substring(product_name, 1, 60), trim(number) ORDER BY line_no) AS n FROM r)
SELECT doc, line_no, product_name, trim(number) AS is_standard_number, upper(st[1]) || lower(st[2:]) AS mandatory_or_voluntary, scheme_type, penalty_clause, 'text_proximity' AS extraction_method FROM d WHERE n = 1""")
def proximity_extract(spark, d):
    return proximity.extract(NEARBY.over(spark, d))


@query(f"SELECT text, {OK_NAME} AS ok FROM {NEARBY.sql()}")
def legacy_names(spark, d):
    return NEARBY.over(spark, d).select("text", T.legacy_name_ok(F.col("text")).alias("ok"))


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_.\\-]', '_', 'g') AS filename FROM pages")
def safe_filenames(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


HEADS = Inline("id int, title string, section string, clauses array<string>", [(1, "Order on steel", "Scope", ["1", "1.1"]), (2, "Order on scope", "Scope", ["2.1"]), (3, "", "", []), (4, "Only title", "", ["3", "3.1", "3.2"])], key="id", vary="title")


@query(f"""SELECT id, concat_ws(' — ', CASE WHEN title <> '' THEN title END, CASE WHEN section <> '' AND NOT contains(lower(title), lower(section)) THEN section END,
 CASE WHEN len(clauses) = 1 THEN 'Clause ' || clauses[1] WHEN len(clauses) > 1 THEN 'Clauses ' || clauses[1] || '–' || clauses[-1] END) AS header FROM {HEADS.sql()}""")
def context_headers(spark, d):
    return HEADS.over(spark, d).select("id", T.context_header(F.col("title"), F.col("section"), F.col("clauses")).alias("header"))


@query(f"WITH {PRODUCTS} SELECT id, rpad(substring(product_name, 1, 45), 45, ' ') || ' ' || rpad(substring(is_standard_number, 1, 20), 20, ' ') || ' ' || substring(qco_reference, 1, 36) AS line FROM products")
def fixed_width_report(spark, d):
    line = F.concat_ws(" ", T.fixed_width(F.col("product_name"), 45), T.fixed_width(F.col("is_standard_number"), 20), F.substring("qco_reference", 1, 36))
    return products(spark, d).select("id", line.alias("line"))


@query("SELECT p_partkey AS id, 'name: ' || p_name || ' | brand: ' || p_brand || ' | size: ' || p_size AS line FROM part")
def rendered_rows(spark, d):
    names = F.array(*map(F.lit, ("name", "brand", "none", "size")))
    values = F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit(",")), F.col("p_brand"), F.lit(" ; "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.render_row(names, values).alias("line"))


@query("""WITH RECURSIVE l AS (SELECT o_custkey AS doc, o_orderkey AS k, CAST(o_totalprice AS BIGINT) % 900 + 1 AS len, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r(doc, k, i, n, g) AS (SELECT doc, k, i, len + 1, 1 FROM l WHERE i = 1 UNION ALL SELECT l.doc, l.k, l.i, CASE WHEN r.n + len + 1 > 1800 THEN len + 1 ELSE r.n + len + 1 END, CASE WHEN r.n + len + 1 > 1800 THEN g + 1 ELSE g END FROM r JOIN l ON l.doc = r.doc AND l.i = r.i + 1)
SELECT doc, k, g FROM r""")
def table_row_groups(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), (F.rint("o_totalprice").cast("long") % 900 + 1).cast("int").alias("len"))
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("k", "len"))).alias("u"))
    groups = D.row_groups(F.transform("u", lambda x: x["len"]))
    return docs.select("doc", F.explode(F.arrays_zip(F.transform("u", lambda x: x["k"]).alias("k"), groups.alias("g"))).alias("z")).select("doc", "z.k", "z.g")


@query(f"SELECT vec_id, {ROUND.format('list_dot_product(v, v)', 6)} AS norm, {ROUND.format('v[1] / sqrt(list_dot_product(v, v)) + 1', 6)} AS head FROM (SELECT vec_id, {VEC.format('embedding')} AS v FROM embeddings)")
def normalised_vectors(spark, d):
    v = F.col("embedding").cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return table(spark, d, "embeddings").select("vec_id", T.rounded(square, 6).alias("norm"), T.rounded(F.get(T.l2_normalise(F.col("embedding")), F.lit(0)) + 1, 6).alias("head"))


@query(f"WITH {PRODUCTS} SELECT id, lower(regexp_replace(product_name, '\\s+', ' ', 'g')) AS name, array_to_string(list_filter(regexp_extract_all(lower(product_name), '[a-z0-9_/]{{3,}}'), lambda x: NOT list_contains(string_split({literal(' '.join(T.STOPWORDS))}, ' '), x)), ' ') AS words FROM products")
def product_keywords(spark, d):
    return products(spark, d).select("id", F.lower(T.normalize(F.col("product_name"))).alias("name"), F.array_join(T.keywords(F.col("product_name")), " ").alias("words"))


@query(f"SELECT conv_id, turn, {'(' + ' OR '.join(f'contains(lower(text), {literal(p)})' for p in T.REFUSALS) + ')'} AS refusal FROM conversations WHERE role = 'assistant'")
def refusals(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, floor(sum(value) * 1e6 + 0.5) / 1e6 AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    """Event-time windows over a table; the same plan runs on a stream."""
    rows = thinking.windowed_counts(table(spark, d, "events"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", T.rounded(F.col("total"), 6).alias("total"))


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 1)")
def facet_filter(spark, d):
    """Filters and columns that reach the Parquet scan, and an anti join."""
    docs = table(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


TRUSTED = ", ".join(map(literal, quality.TRUSTED))


@query(f"WITH {PRODUCTS} SELECT id, extraction_method IN ({TRUSTED}) AS trusted FROM products")
def trust_tiers(spark, d):
    return products(spark, d).select("id", quality.method(F.col("extraction_method")).isin(*quality.TRUSTED).alias("trusted"))
