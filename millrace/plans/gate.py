"""Quality-gate, facet and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import quality as Q
from millrace.operators import tables
from millrace.plans.base import Inline, literal, query, table
from millrace.plans.retrieval import PRODUCTS, products


def re(pattern: str) -> str:
    return literal(pattern)


NAMES = Inline(
    "raw_name string",
    [(x,) for x in (
        None, "", "( 10 )", "984", "ab", "->*<-", "S. No.", "Product/Title", "Home", "read more", "IS 1417:2016", "IS/IEC 60598 (Part 2)", "purposes",
        "and fittings", "Next Prev", "Grant of licence to a firm", "Is this a product?", "a b c d", "Propiconazole E.c.", "Cables for 1 500 V d.c.",
        "Helmets for riders", "Steel  tubes [image] welded", " - Plywood - ",
    )], vary="raw_name")
LETTER_SQL = r"[\p{L}\p{Nl}\p{No}]"


def tidy_sql(c: str) -> str:
    inner = f"regexp_replace(coalesce({c}, ''), {re(T.ARTEFACT)}, ' ', 'g')"
    return f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'), {literal(T.EDGE.replace(chr(9), '').replace(chr(13), '').replace(chr(10), ''))})"


def issue_sql(n: str) -> str:
    m = lambda p: f"regexp_matches({n}, {re(p)})"
    return (
        f"CASE WHEN {n} = '' THEN 'empty_after_normalisation' WHEN {m(Q.NUMERIC)} THEN 'numeric_or_punctuation_only' WHEN length({n}) < 4 THEN 'too_short' "
        f"WHEN NOT {m(LETTER_SQL)} THEN 'no_alphabetic_content' WHEN {m(Q.HEADER)} THEN 'table_header' WHEN {m(Q.NAVIGATION)} THEN 'website_navigation' "
        f"WHEN {m(Q.NUMBER_ONLY)} THEN 'is_number_in_name_column' WHEN {m(Q.FRAGMENT)} THEN 'wrapped_cell_fragment' WHEN {m(Q.PAGINATION)} THEN 'pagination_chrome' "
        f"WHEN {m(Q.NOTICE)} THEN 'notice_headline' WHEN {m('[।?!]$')} THEN 'sentence_not_product_name' WHEN NOT {m(LETTER_SQL + '{3,}')} THEN 'no_word_of_three_letters' END"
    )


def basis_sql(said: str) -> str:
    return f"CASE WHEN regexp_matches({said}, {re(Q.NO_STATUS)}) THEN 'unknown' WHEN regexp_matches({said}, {re(Q.ESTABLISHING)}) THEN 'established' ELSE 'unknown' END"


VERDICTS = f"""
WITH {PRODUCTS}, v AS (SELECT id, product_name, qco_reference, standard_title,
 list_filter([CASE WHEN extraction_method NOT IN ('curated', 'table_parse') THEN 'untrusted_extraction:' || extraction_method END, {issue_sql('product_name')}], lambda x: x IS NOT NULL) AS reasons,
 {basis_sql("qco_reference || ' ' || standard_title")} AS status_basis FROM products)
"""


@query(f"SELECT raw_name, {issue_sql('n')} AS reason FROM (SELECT raw_name, {tidy_sql('raw_name')} AS n FROM {NAMES.sql()})")
def name_issues(spark, d):
    return NAMES.over(spark, d).select("raw_name", Q.name_issue(T.normalize(F.col("raw_name"))).alias("reason"))


@query(VERDICTS + " SELECT id, len(reasons) = 0 AS ok, array_to_string(reasons, ',') AS reasons, status_basis FROM v")
def quality_verdicts(spark, d):
    return Q.validate(products(spark, d)).select("id", "ok", F.array_join("reasons", ",").alias("reasons"), "status_basis")


@query(VERDICTS + " SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM v) GROUP BY reason")
def quality_reason_counts(spark, d):
    return Q.reason_counts(Q.validate(products(spark, d)))


SOURCES = Inline(
    "reference string, url string, title string",
    [
        ("Steel (Quality Control) Order, 2020", "", ""), ("Cement Quality Control Order", "", "Portland cement"), ("", "http://x/compulsory-certification", ""),
        ("Compulsory Registration Scheme", "", ""), ("List under Simplified Procedure", "", "quality control order"), ("Empanelled Laboratories", "", ""),
        ("Hallmarking of gold order", "", ""), ("Hallmarking Regulation 2018", "", ""), ("QCO 2021", "", ""), ("", "", ""), ("crs order", "", "testing facility"),
    ],
)


@query(f"SELECT reference, url, title, {basis_sql(chr(34) + 's' + chr(34))} AS basis FROM (SELECT *, reference || ' ' || url || ' ' || title AS s FROM {SOURCES.sql()})")
def status_provenance(spark, d):
    return SOURCES.df(spark).withColumn("basis", Q.status_basis(F.col("reference"), F.col("url"), F.col("title")))


@query(VERDICTS + f""" SELECT id, status_basis, CASE WHEN status_basis = 'unknown' THEN {literal(Q.UNKNOWN_STATUS)} ELSE 'Mandatory' END AS mandatory_or_voluntary,
 CASE WHEN status_basis = 'unknown' THEN '' ELSE 'Scheme-I' END AS scheme_type, CASE WHEN status_basis = 'unknown' THEN 'no status from ''' || qco_reference || '''' ELSE '' END AS status_note
 FROM v WHERE len(reasons) = 0""")
def claim_suppression(spark, d):
    claimed = products(spark, d).withColumns({"mandatory_or_voluntary": F.lit("Mandatory"), "scheme_type": F.lit("Scheme-I")})
    return Q.validate(claimed).where("ok").select("id", "status_basis", "mandatory_or_voluntary", "scheme_type", "status_note")


@query(f"WITH {PRODUCTS} SELECT extraction_method, count(*) AS n FROM products GROUP BY extraction_method")
def method_histogram(spark, d):
    return products(spark, d).groupBy("extraction_method").agg(F.count("*").alias("n"))


# --- facets ----------------------------------------------------------------

PASSAGES = Inline(
    "id int, body string",
    [
        (1, "Conformity to IS 1417:2016 and IS  302 (Part 1) : 2012 is mandatory."), (2, "See IS/IEC 60598, IS 1 and IS 1417:2016 again IS 1417:2016"),
        (3, "The fee is 1000 rupees; voluntary."), (4, "No person shall sell; certification is voluntary."), (5, "Second Amendment dated 5th March, 2021 for cable and wire, lamp"),
        (6, "Amendment of the order. 2020"), (7, "gold carat hallmark and milk"), (8, "steel pipe valve pump"), (9, ""), (10, "First Amendment March 3, 2022 prohibited led wire cotton silk"),
    ], key="id", vary="body")
REF_SQL = f"list_transform(regexp_extract_all(body, {re(T.REFERENCE)}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"


@query(f"""SELECT id, array_to_string(list_transform(list_filter(list_zip(r, range(1, len(r) + 1)), lambda z: list_position(r, z[1]) = z[2]), lambda z: z[1]), '|') AS refs
 FROM (SELECT id, {REF_SQL} AS r FROM {PASSAGES.sql()})""")
def is_number_extract(spark, d):
    return PASSAGES.over(spark, d).select("id", F.array_join(T.references(F.col("body")), "|").alias("refs"))


@query(f"""SELECT id, CASE WHEN m AND NOT v THEN 'mandatory' WHEN v AND NOT m THEN 'voluntary' ELSE '' END AS status
 FROM (SELECT id, regexp_matches(body, {re(T.MANDATORY)}) AS m, regexp_matches(body, {re(T.VOLUNTARY)}) AS v FROM {PASSAGES.sql()})""")
def status_facet(spark, d):
    return PASSAGES.over(spark, d).select("id", T.status(F.col("body")).alias("status"))


HITS_SQL = "[" + ", ".join(
    "{'h': " + " + ".join(f"contains(lower(body), {literal(w)})::INT" for w in words) + f", 'o': {-i}, 'n': {literal(name)}" + "}" for i, (name, words) in enumerate(T.SECTORS)
) + "]"


@query(f"SELECT id, CASE WHEN b.h > 0 THEN b.n ELSE '' END AS sector FROM (SELECT id, list_max({HITS_SQL}) AS b FROM {PASSAGES.sql()})")
def sector_facet(spark, d):
    return PASSAGES.over(spark, d).select("id", T.sector(F.col("body")).alias("sector"))


@query(f"""SELECT id, CASE WHEN regexp_extract(body, {re(T.AMENDMENT)}, 2) <> '' THEN regexp_extract(body, {re(T.AMENDMENT)}, 1) || ' ' || regexp_extract(body, {re(T.AMENDMENT)}, 2)
 ELSE regexp_extract(body, {re(T.AMENDMENT)}, 1) END AS amendment FROM {PASSAGES.sql()}""")
def amendment_facet(spark, d):
    return PASSAGES.over(spark, d).select("id", T.amendment(F.col("body")).alias("amendment"))


NUMBERS = Inline("raw string", [(x,) for x in ("IS 1", "IS/IEC 60079-11", "IS 15111 (Part 1 and 2)", "IS 2039 (Part 1 to 3)", "IS 14927 (Part 2/Sec 1)", "IS 456:2000", "is 456 : 2000", "456", "IS abc", "IS 1234567")], vary="raw")


@query(f"SELECT raw, regexp_matches(raw, {re(tables.NUMBER_SHAPE)}) AS ok FROM {NUMBERS.sql()}")
def number_shape(spark, d):
    return NUMBERS.over(spark, d).select("raw", tables.number_ok(F.col("raw")).alias("ok"))


# --- tables ----------------------------------------------------------------

CELLS = Inline(
    "page int, table_no int, row_no int, cells array<string>",
    [
        (1, 1, 0, ["Sr. No.", "IS Number", "Product/Title", "Remarks"]), (1, 1, 1, ["1", "IS 10", "Coarse", "x"]), (1, 1, 2, ["", "", "thread and", ""]), (1, 1, 3, [None, None, "fittings", None]),
        (1, 1, 4, ["2", "IS 20 (Part 1)", "Bolts", ""]), (2, 1, 0, ["", "", "of steel", ""]), (2, 1, 1, ["Sr. No.", "IS Number", "Product/Title", "Remarks"]), (2, 1, 2, ["5", "ISX", "Nuts", ""]),
        (3, 1, 0, ["6", "IS 30", "Washers", ""]), (4, 1, 0, ["Name", "Address"]), (4, 1, 1, ["a", "b"]),
    ],
)


def role_sql(role: str) -> str:
    return f"regexp_matches(trim(cell), {re(tables.ROLES[role])})"


@query(f"""WITH c AS (SELECT page, table_no, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS i FROM {CELLS.sql()}),
r AS (SELECT *, CASE WHEN {role_sql('serial')} THEN 'serial' WHEN {role_sql('is_number')} THEN 'is_number' WHEN {role_sql('product')} THEN 'product' END AS role FROM c),
m AS (SELECT page, table_no, row_no, min(i) FILTER (role = 'serial') AS serial, min(i) FILTER (role = 'is_number') AS is_number, min(i) FILTER (role = 'product') AS product FROM r GROUP BY ALL)
SELECT page, table_no, row_no, CAST(serial AS INTEGER) AS serial, CAST(is_number AS INTEGER) AS is_number, CAST(product AS INTEGER) AS product FROM m WHERE is_number IS NOT NULL AND product IS NOT NULL""")
def table_header_roles(spark, d):
    return tables.header_roles(CELLS.df(spark))


# Header places held on by a window, rows by their places, records as islands.
RECORDS = f"""
WITH c AS (SELECT page, table_no, row_no, cells, len(cells) AS width, list_position(list_transform(cells, lambda x: coalesce({role_sql('is_number').replace('cell', 'x')}, false)), true) AS isn,
 list_position(list_transform(cells, lambda x: coalesce({role_sql('product').replace('cell', 'x')}, false)), true) AS prod, list_position(list_transform(cells, lambda x: coalesce({role_sql('serial').replace('cell', 'x')}, false)), true) AS ser FROM {CELLS.sql()}),
h AS (SELECT *, isn > 0 AND prod > 0 AS head FROM c),
k AS (SELECT *, last(CASE WHEN head THEN {{'s': ser, 'i': isn, 'p': prod, 'w': width}} END IGNORE NULLS) OVER (ORDER BY page, table_no, row_no) AS m FROM h),
r AS (SELECT page, table_no, row_no, coalesce(cells[m.s], '') AS serial, coalesce(cells[m.i], '') AS is_number, coalesce(cells[m.p], '') AS product FROM k WHERE NOT coalesce(head, false) AND m IS NOT NULL AND width = m.w),
i AS (SELECT *, sum((serial <> '' OR is_number <> '')::INT) OVER (ORDER BY page, table_no, row_no) AS record FROM r WHERE serial <> '' OR is_number <> '' OR product <> '')
SELECT min(page) AS page, first(serial ORDER BY page, table_no, row_no) AS serial, first(is_number ORDER BY page, table_no, row_no) AS is_number, string_agg(product, ' ' ORDER BY page, table_no, row_no) FILTER (product <> '') AS product,
 regexp_matches(first(is_number ORDER BY page, table_no, row_no), {re(tables.NUMBER_SHAPE)}) AS number_ok FROM i WHERE record > 0 GROUP BY record"""


@query(RECORDS)
def continuation_merge(spark, d):
    rows = CELLS.df(spark).withColumn("doc", F.lit(1))
    return tables.records(rows).select("page", "serial", "is_number", "product", tables.number_ok(F.col("is_number")).alias("number_ok"))


@query("""SELECT l_orderkey, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS seen, CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(DISTINCT l_linenumber) AS BIGINT) AS gaps,
 array_to_string(list_sort(list_filter(range(min(l_linenumber), max(l_linenumber) + 1), lambda x: NOT list_contains(list(l_linenumber), x))), ',') AS missing FROM lineitem GROUP BY l_orderkey""")
def serial_gaps(spark, d):
    return tables.gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


SHREDDED = Inline(
    "doc int, line_no int, text string, page int",
    [(1, i, t, p) for i, (t, p) in enumerate([
        ("Sr. No.", 1), ("Product/Title", 1), ("1", 1), ("IS 694", 1), ("Cables", 1), ("2 IS 13334", 1), ("(Part 1) Pumps", 1), ("and parts", 2), ("3. IS 15500 (Part 3) Deepwell handpumps", 2),
        ("1234567", 2), ("9 tools", 2), ("5", 2), ("IS 44", 2), ("Oil seals", 3), ("10", 3), ("IS 45", 3),
    ])] + [(2, i, t, 0) for i, t in enumerate(["Name of Lab", "OSL Code", "1 Alpha", "Labs", "Delhi", "Active", "77", "100 Beta"])],
)


# The expected serial by recursion, rows as islands, the two profiles' merges on lists.
REASSEMBLED = f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS i, coalesce(TRY_CAST(nullif(regexp_extract(text, {re(tables.ROW_START)}, 1), '') AS INTEGER), -1) AS n FROM {SHREDDED.sql()}),
h AS (SELECT doc, string_agg(text, ' ' || chr(10) ORDER BY i) AS head FROM l WHERE i <= 80 GROUP BY doc),
p AS (SELECT doc, CASE WHEN contains(head, 'Sr. No.') AND contains(head, 'Product/Title') THEN 0 WHEN contains(head, 'Name of Lab') AND contains(head, 'OSL Code') THEN 1 END AS profile FROM h),
r(doc, i, expected, serial) AS (SELECT doc, 0::BIGINT, 1, -1 FROM p WHERE profile IS NOT NULL UNION ALL
 SELECT l.doc, l.i, CASE WHEN l.n BETWEEN r.expected AND r.expected + 4 THEN l.n + 1 ELSE r.expected END, CASE WHEN l.n BETWEEN r.expected AND r.expected + 4 THEN l.n ELSE -1 END FROM r JOIN l ON l.doc = r.doc AND l.i = r.i + 1),
e AS (SELECT r.doc, r.i, r.serial, l.page, trim(CASE WHEN serial > 0 THEN regexp_extract(text, {re(tables.ROW_START)}, 2) ELSE text END) AS part, sum((serial > 0)::INT) OVER (PARTITION BY r.doc ORDER BY r.i) AS island FROM r JOIN l ON l.doc = r.doc AND l.i = r.i),
g AS (SELECT doc, island, first(serial ORDER BY i) AS serial, first(page ORDER BY i) AS page, coalesce(list(part ORDER BY i) FILTER (part <> ''), []) AS f FROM e WHERE island > 0 GROUP BY doc, island),
s AS (SELECT g.*, profile, CASE WHEN profile = 0 AND regexp_matches(f[1], {re(tables.DESIGNATION)}) THEN list_concat([regexp_extract(f[1], {re(tables.DESIGNATION)}, 1), regexp_extract(f[1], {re(tables.DESIGNATION)}, 2)], f[2:])
 WHEN profile = 0 AND len(f) > 1 AND regexp_matches(f[1], {re(tables.BARE_NUMBER)}) AND regexp_matches(f[2], {re(tables.PART_FIRST)}) THEN list_concat([f[1] || ' ' || regexp_extract(f[2], {re(tables.PART_FIRST)}, 1), regexp_extract(f[2], {re(tables.PART_FIRST)}, 2)], f[3:])
 ELSE f END AS x FROM g JOIN p USING (doc))
SELECT doc, serial, page, array_to_string(CASE WHEN profile = 0 AND len(x) > 2 THEN [x[1], array_to_string(x[2:], ' ')] WHEN profile = 1 AND len(x) > 4 THEN list_concat([array_to_string(x[1:len(x) - 3], ' ')], x[len(x) - 2:]) ELSE x END, '|') AS cells FROM s"""


@query(REASSEMBLED)
def row_reassembly(spark, d):
    return tables.reassemble(SHREDDED.df(spark)).select("doc", "serial", "page", F.array_join("cells", "|").alias("cells"))
