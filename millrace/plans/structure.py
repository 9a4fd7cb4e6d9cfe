"""Document-structure and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import documents as D
from millrace.operators import html as H
from millrace.plans.base import Inline, literal, query, table
from millrace.plans.retrieval import ROUND

re = literal
CLEAN = r"trim(regexp_replace(replace(replace({0}, chr(160), ' '), chr(9), ' '), ' {{2,}}', ' ', 'g'))"
DOC_LINES = f"""
raw AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc, CAST(line_no AS INTEGER) AS line_no, {CLEAN.format('raw')} AS text, 0 AS page FROM raw)
"""


def _lines(spark, d):
    return D.page_lines(table(spark, d, "documents"))


@query(f"WITH {DOC_LINES} SELECT doc, line_no, text, page FROM l")
def clean_lines(spark, d):
    return _lines(spark, d)


PAGED = Inline("doc_id int, text string", [
    (1, "intro\n[Page 1]\na  b\n\n[Page  2]\nc\t d\ne"), (2, "no pages\nhere"), (3, "[Page 7]\n[Page 8]\nlast"), (4, "Menu\n## Title here\nLast Updated on May 1\nBody text [image] more\n[image]\n• \nEnd"),
    (5, "Hindi यह एक पंक्ति है\nEnglish line with one शब्द only among many words\nMAIN MENU"),
], key="doc_id")
PAGED_LINES = f"""
raw AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {PAGED.sql()}),
c AS (SELECT doc, CAST(line_no AS INTEGER) AS line_no, {CLEAN.format('raw')} AS text FROM raw),
m AS (SELECT *, CASE WHEN regexp_matches(text, {re(D.PAGE_MARK)}) THEN CAST(regexp_extract(text, {re(D.PAGE_MARK)}, 1) AS INTEGER) END AS mark FROM c),
l AS (SELECT doc, line_no, text, coalesce(p, 0) AS page FROM (SELECT *, last(mark IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM m) WHERE mark IS NULL)
"""
RATIO = r"CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]')) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '[ऀ-ॿ]')) / len(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]'))::DOUBLE END"


@query(f"WITH {PAGED_LINES} SELECT * FROM l")
def page_carry_forward(spark, d):
    return D.page_lines(PAGED.over(spark, d))


@query(f"WITH {PAGED_LINES} SELECT doc, line_no, {ROUND.format(RATIO, 6)} AS ratio FROM l")
def script_ratio_lines(spark, d):
    return D.page_lines(PAGED.over(spark, d)).select("doc", "line_no", T.rounded(T.script_ratio(F.col("text")), 6).alias("ratio"))


def judged_sql(html: bool) -> str:
    above = "coalesce(line_no <= boundary, false)" if html else "false"
    return f"""
hb AS (SELECT *, min(CASE WHEN regexp_matches(text, {re(D.HEADING)}) THEN line_no END) OVER (PARTITION BY doc) AS boundary FROM l),
i AS (SELECT *, trim(regexp_replace(regexp_replace(text, {re(D.IMAGE)}, ' ', 'g'), ' {{2,}}', ' ', 'g')) AS inked FROM hb),
j AS (SELECT *, CASE WHEN {above} THEN 'nav' WHEN text = '' THEN 'empty' WHEN regexp_matches(text, {re(D.LAST_UPDATED)}) OR regexp_matches(text, {re(D.PDF_NAV)}) THEN 'nav'
 WHEN {RATIO} >= 0.3 THEN 'script' WHEN inked = '' THEN 'nav' END AS drop FROM i),
b AS (SELECT doc, count(*) AS lines, count(*) FILTER (drop = 'nav') AS nav, count(*) FILTER (drop = 'script') AS script, CAST(coalesce(sum(length(inked)) FILTER (drop IS NULL), 0) AS BIGINT) AS chars, count(*) FILTER (drop IS NULL) AS kept, max(page) AS pages FROM j GROUP BY doc),
q AS (SELECT *, {ROUND.format('(nav + script) / lines::DOUBLE', 3)} AS share FROM b),
z AS (SELECT *, CASE WHEN chars < 200 THEN 'too_little_content' WHEN share > 0.9 THEN 'mostly_boilerplate' END AS reason FROM q)
"""


@query(f"WITH {PAGED_LINES}, {judged_sql(True)} SELECT doc, line_no, drop, CASE WHEN drop IS NULL THEN inked ELSE text END AS text FROM j")
def boilerplate_lines(spark, d):
    return D.judged_lines(D.page_lines(PAGED.over(spark, d)), True).select("doc", "line_no", "drop", "text")


@query(f"WITH {DOC_LINES}, {judged_sql(False)} SELECT doc, lines, nav, script, chars, kept, pages, share FROM z")
def boilerplate_counts(spark, d):
    return D.boilerplate(D.judged_lines(_lines(spark, d), False)).drop("reason")


@query(f"WITH {DOC_LINES}, {judged_sql(False)} SELECT doc, reason, chars FROM z WHERE reason IS NOT NULL")
def quarantine_report(spark, d):
    return D.boilerplate(D.judged_lines(_lines(spark, d), False)).where("reason is not null").select("doc", "reason", "chars")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents WHERE length(text) >= 100")
def ingest_numbering(spark, d):
    return D.long_enough(table(spark, d, "documents")).select("doc_id", "doc_index")


CLAUSED = Inline("doc int, line_no int, text string, page int", [
    (1, 0, "Preface text", 1), (1, 1, "1. Overview of the order", 1), (1, 2, "first words broken in-", 1), (1, 3, "side a line", 2), (1, 4, "1.1 Scope and purpose", 2), (1, 5, "21. Can anyone apply?", 2),
    (1, 6, "Yes they can.", 3), (1, 7, "1.2.1 Certification scheme", 3), (1, 8, "3 Conformity to standards", 3), (1, 9, "3.1 (Marking)", 4), (2, 0, "1) Scheme-I of marks", 0), (2, 1, "2) Scheme-II", 0), (2, 2, "7. Is it free?", 0), (2, 3, "No", 0),
], key="doc")
UNITS = f"""
f AS (SELECT * FROM {CLAUSED.sql()}),
nb AS (SELECT doc, count(*) FILTER (regexp_matches(text, {re(D.CLAUSE)}) AND contains(regexp_extract(text, {re(D.CLAUSE)}, 1), '.')) >= 3 AS numbered FROM f GROUP BY doc),
t AS (SELECT f.*, CASE WHEN numbered AND regexp_matches(text, {re(D.CLAUSE)}) THEN regexp_extract(text, {re(D.CLAUSE)}, 1) END AS clause FROM f JOIN nb USING (doc)),
s AS (SELECT *, clause IS NOT NULL OR regexp_matches(text, {re(D.FAQ)}) AS starts, CASE WHEN clause IS NOT NULL AND NOT contains(clause, '.') THEN regexp_extract(text, {re(D.CLAUSE)}, 2) END AS title FROM t),
u AS (SELECT *, sum(starts::INT) OVER w AS unit, coalesce(last(title IGNORE NULLS) OVER w, '') AS section FROM s WINDOW w AS (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
units AS (SELECT doc, CAST(unit AS BIGINT) AS unit, trim(replace(regexp_replace(string_agg(text, chr(1) ORDER BY line_no), '-' || chr(1) || '(\\p{{Ll}})', '\\1', 'g'), chr(1), ' ')) AS text,
 coalesce(max(CASE WHEN clause IS NOT NULL THEN 'clause' WHEN starts THEN 'faq' END), 'prose') AS kind, coalesce(max(clause), '') AS clause, coalesce(max(CASE WHEN starts OR unit = 0 THEN section END), '') AS section, min(page) AS page_start, max(page) AS page_end FROM u GROUP BY doc, unit)
"""


@query(f"WITH {UNITS} SELECT * FROM units")
def unit_islands(spark, d):
    return D.units(CLAUSED.over(spark, d))


PACK = f"""
WITH RECURSIVE {DOC_LINES}, n AS (SELECT doc, line_no, length(text) AS len, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS i FROM l WHERE text <> ''),
r(doc, i, line_no, n, chunk, closed) AS (SELECT doc, i, line_no, len + 2, 1, len > 2000 FROM n WHERE i = 1
 UNION ALL SELECT n.doc, n.i, n.line_no, CASE WHEN len > 2000 OR closed OR r.n + len + 2 > 2000 THEN len + 2 ELSE r.n + len + 2 END,
 CASE WHEN len > 2000 OR closed OR r.n + len + 2 > 2000 THEN chunk + 1 ELSE chunk END, len > 2000 FROM r JOIN n ON n.doc = r.doc AND n.i = r.i + 1)
"""


def _line_units(spark, d):
    lines = _lines(spark, d).where("text <> ''")
    return lines.select("doc", F.col("line_no").alias("unit"), "text", F.lit("prose").alias("kind"), F.lit("").alias("clause"), F.lit("").alias("section"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))


@query(PACK + " SELECT doc, line_no AS unit, chunk FROM r")
def pack_units(spark, d):
    return D.packed(_line_units(spark, d)).select("doc", "unit", "chunk")


SPLIT = r"""
WITH RECURSIVE t AS (SELECT doc_id AS doc, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
s0 AS (SELECT doc, string_split(regexp_replace(text, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS w FROM t WHERE length(text) > 2000),
s AS (SELECT doc, unnest(w) AS sent, generate_subscripts(w, 1) AS i, len(w) AS n FROM s0),
r(doc, i, n, cur, piece) AS (SELECT doc, i, n, sent, CAST(NULL AS VARCHAR) FROM s WHERE i = 1
 UNION ALL SELECT s.doc, s.i, s.n,
 CASE WHEN r.cur <> '' AND length(r.cur || ' ' || s.sent) > 2000 THEN trim(right(r.cur, 200) || ' ' || s.sent) WHEN r.cur = '' THEN s.sent ELSE r.cur || ' ' || s.sent END,
 CASE WHEN r.cur <> '' AND length(r.cur || ' ' || s.sent) > 2000 THEN r.cur END FROM r JOIN s ON s.doc = r.doc AND s.i = r.i + 1),
p AS (SELECT doc, i AS o, 0 AS o2, piece FROM r WHERE piece IS NOT NULL UNION ALL SELECT doc, i, 1, cur FROM r WHERE i = n AND cur <> '' UNION ALL SELECT doc, 0, 0, text FROM t WHERE length(text) <= 2000),
c AS (SELECT doc, o, o2, unnest(CASE WHEN length(piece) <= 2000 THEN [piece] ELSE list_transform(range(0, CAST(ceil((length(piece) - 2000) / 1800.0) AS BIGINT) + 1), lambda k: substring(piece, k * 1800 + 1, 2000)) END) AS text,
 unnest(range(0, CASE WHEN length(piece) <= 2000 THEN 1 ELSE CAST(ceil((length(piece) - 2000) / 1800.0) AS BIGINT) + 1 END)) AS k FROM p),
pieces AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY o, o2, k) - 1 AS piece, text FROM c)
"""


def _flat(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _pieces(spark, d):
    flat = _flat(spark, d).select("doc", F.posexplode(D.hard_split(F.col("text"))).alias("piece", "text"))
    return flat.withColumns({"chunk": F.lit(1), "clauses": F.array().cast("array<string>")})


@query(SPLIT + " SELECT doc, piece, length(text) AS chars, md5(text) AS digest FROM pieces")
def hard_split(spark, d):
    return _pieces(spark, d).select("doc", F.col("piece").cast("long").alias("piece"), F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


FRESH = """, k AS (SELECT doc, piece, text, sha1(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key FROM pieces),
fresh AS (SELECT doc, piece, text, row_number() OVER (PARTITION BY doc ORDER BY piece) - 1 AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY piece) AS n FROM k) WHERE n = 1)
"""


@query(SPLIT + FRESH + " SELECT doc, piece, chunk_index FROM fresh")
def chunk_dedupe(spark, d):
    return D.emitted(_pieces(spark, d)).select("doc", F.col("piece").cast("long").alias("piece"), F.col("chunk_index").cast("long").alias("chunk_index"))


@query(SPLIT + FRESH + """ SELECT printf('doc%03d_chunk%04d', doc, chunk_index) AS chunk_id, printf('doc%03d_sec_root', doc) AS parent_id, length(text) AS char_count, '' AS status, '' AS clause_top FROM fresh""")
def chunk_metadata(spark, d):
    made = D.emitted(_pieces(spark, d))
    return made.select("chunk_id", "parent_id", F.col("char_count").cast("long").alias("char_count"), "status", "clause_top")


@query(SPLIT + FRESH + f""", m AS (SELECT doc, count(*) AS made FROM pieces GROUP BY doc), h AS (SELECT doc, count(*) AS chunks FROM fresh GROUP BY doc),
{DOC_LINES.strip()}, {judged_sql(False).strip()}
SELECT z.doc, reason, coalesce(chunks, 0) AS chunks, coalesce(made, 0) - coalesce(chunks, 0) AS duplicates, chars FROM z LEFT JOIN m USING (doc) LEFT JOIN h USING (doc)""")
def chunk_report(spark, d):
    return D.corpus_report(D.boilerplate(D.judged_lines(_lines(spark, d), False)), _pieces(spark, d))


@query(SPLIT + FRESH + " SELECT printf('doc%03d_sec_root', doc) AS parent_id, count(*) AS siblings FROM fresh GROUP BY doc")
def section_lookup(spark, d):
    return D.section_of(D.emitted(_pieces(spark, d))).select("parent_id", F.size("siblings").cast("long").alias("siblings"))


STRUCTURED = f"""
WITH {DOC_LINES}, cn AS (SELECT doc, count(*) FILTER (regexp_matches(text, {re(D.CLAUSE)}) AND contains(regexp_extract(text, {re(D.CLAUSE)}, 1), '.')) >= 3 AS numbered, max(page) AS pages FROM l GROUP BY doc)"""


@query(SPLIT + FRESH + ", " + STRUCTURED.strip().removeprefix("WITH ") + """, m AS (SELECT doc, count(*) AS made FROM pieces GROUP BY doc), h AS (SELECT doc, count(*) AS chunks FROM fresh GROUP BY doc)
SELECT doc, numbered, pages, chunks, made - chunks AS duplicates FROM cn JOIN m USING (doc) JOIN h USING (doc) WHERE numbered OR pages > 0 OR made > chunks""")
def structure_report(spark, d):
    return D.structure(_lines(spark, d), _pieces(spark, d))


# --- HTML ------------------------------------------------------------------

def plain_sql(c: str) -> str:
    out = f"regexp_replace(regexp_replace({c}, '(?is)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for name, sign in H._ENTITIES:
        out = f"replace({out}, {literal(name)}, {literal(sign)})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def decoded_sql(c: str) -> str:
    for name, sign in H._ENTITIES:
        c = f"replace({c}, {literal(name)}, {literal(sign)})"
    return c


def _any_tag(tags) -> str:
    return "[" + ", ".join(map(literal, tags)) + "]"


# Pages as a stream of tags and texts; windows over it tell what is dropped, what
# lies in the article, and which element a text belongs to. An element ends with
# its end tag or where the next one begins (these pages nest none in another).
ELEMENTS = rf"""
WITH t0 AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', '', 'g'), '(?s)<!--.*?-->|<[a-zA-Z/!][^>]*>|[^<]+') AS z FROM pages),
t1 AS (SELECT page_id, unnest(z) AS tok, generate_subscripts(z, 1) AS i FROM t0),
t2 AS (SELECT *, CASE WHEN tok[1] = '<' THEN lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) END AS tag, tok[1:2] = '</' AS closes, tok[1] <> '<' AS txt FROM t1),
t3 AS (SELECT *, sum(CASE WHEN list_contains({_any_tag(H.DROPPED)}, tag) THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END) OVER w AS lost,
 sum(CASE WHEN tag = 'article' THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END) OVER w AS inside FROM t2 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
t4 AS (SELECT *, list_contains({_any_tag((*H.HEADINGS, *H.EMITTED, 'span'))}, tag) AS kind FROM t3 WHERE lost = 0 AND inside > 0),
t5 AS (SELECT *, sum(CASE WHEN kind AND NOT closes THEN 1 ELSE 0 END) OVER w AS nr, last(CASE WHEN kind THEN NOT closes END IGNORE NULLS) OVER w AS live, last(CASE WHEN kind THEN tag END IGNORE NULLS) OVER w AS own
 FROM t4 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
t6 AS (SELECT page_id, nr, max(own) AS tag, list(trim({decoded_sql('tok')}, E' \t\n\r\f') ORDER BY i) AS x FROM t5 WHERE txt AND live GROUP BY page_id, nr),
t7 AS (SELECT page_id, nr, tag, CASE WHEN tag[1] = 'h' THEN array_to_string(list_filter(x, lambda y: y <> ''), '') ELSE array_to_string(list_filter(x, lambda y: y <> ''), ' ') END AS text FROM t6),
elements AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY nr) - 1 AS INTEGER) AS ord, tag, text FROM t7 WHERE text <> '' AND (tag[1] = 'h' OR length(text) > 10))
"""


def _extracted(spark, d):
    return table(spark, d, "pages").select("page_id", H.extracted(F.col("html")).alias("x"))


@query(ELEMENTS + r""" SELECT page_id, md5(trim(regexp_replace(string_agg(CASE WHEN tag[1] = 'h' THEN chr(10) || '## ' || text || chr(10) ELSE text END, chr(10) ORDER BY ord), '
{3,}', chr(10) || chr(10), 'g'), E' 	

')) AS digest,
 count(*) AS elements FROM elements GROUP BY page_id""")
def html_main_text(spark, d):
    rows = _extracted(spark, d).where(F.size("x.blocks") > 0)
    return rows.select("page_id", F.md5(F.col("x.text").cast("binary")).alias("digest"), F.size("x.blocks").cast("long").alias("elements"))


@query(ELEMENTS + " SELECT page_id, ord, tag, text FROM elements")
def html_blocks(spark, d):
    rows = _extracted(spark, d).select("page_id", F.explode("x.blocks").alias("b"))
    return rows.select("page_id", "b.ord", "b.tag", "b.text")


@query(ELEMENTS + " SELECT page_id, tag, count(*) AS n, max(length(text)) AS longest FROM elements GROUP BY ALL")
def html_element_report(spark, d):
    rows = _extracted(spark, d).select("page_id", F.explode("x.blocks").alias("b"))
    return rows.groupBy("page_id", "b.tag").agg(F.count("*").alias("n"), F.max(F.length("b.text")).cast("long").alias("longest"))


LINKS = rf"""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
b AS (SELECT page_id, site, unnest(h) AS h, unnest(t) AS t, generate_subscripts(h, 1) AS pos FROM a),
c AS (SELECT page_id, pos, CASE WHEN h LIKE '//%' THEN 'https:' || h WHEN h LIKE '/%' THEN site || h ELSE h END AS url, {plain_sql('t')} AS title FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM c),
f AS (SELECT page_id, url, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM e WHERE n = 1)
"""


@query(LINKS + " SELECT page_id, nth, url, title FROM f WHERE nth <= 20")
def html_links(spark, d):
    return H.links(table(spark, d, "pages")).withColumn("nth", F.col("nth").cast("long"))


@query(LINKS + " SELECT url, min(page_id) AS first_page, count(*) AS pages FROM f GROUP BY url")
def html_link_dedupe(spark, d):
    return H.links(table(spark, d, "pages"), None).groupBy("url").agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


HELD = ("THE", "/de", "hath")


@query(LINKS.replace("WHERE n = 1)", "WHERE n = 1 AND (" + " OR ".join(f"contains(lower(title || ' ' || url), {literal(w.lower())})" for w in HELD) + "))") + " SELECT page_id, nth, url, title FROM f WHERE nth <= 3")
def html_link_filter(spark, d):
    return H.links(table(spark, d, "pages"), 3, holds=HELD).withColumn("nth", F.col("nth").cast("long"))


@query(LINKS.replace("FROM b),", "FROM b WHERE lower(h) LIKE '%e'),") + " SELECT page_id, nth, url, title FROM f WHERE nth <= 20")
def html_link_ending(spark, d):
    return H.links(table(spark, d, "pages"), ending="E").withColumn("nth", F.col("nth").cast("long"))


@query("SELECT page_id, CASE WHEN length(url) < 150 AND length(html) > length(url) THEN md5(html) ELSE md5(url) END AS chosen FROM pages")
def fallback_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.better_text(F.col("url"), F.col("html")).cast("binary")).alias("chosen"))
