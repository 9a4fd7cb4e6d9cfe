"""Document structure: pages, boilerplate, quarantine, units, packing, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.folds import let, states

# Markers, patterns and sizes.
PAGE_MARK = r"^\[Page\s+(\d+)\]$"
HEADING = r"^##+\s+(.*)$"
LAST_UPDATED = r"(?i)^Last Updated on\s+.*$"
PDF_NAV = (
    r"(?i)^(?:\[image\]\s*)+$|^[•○■▪]\s*$|^(?:Hide|Show)\s+[—–-]\s*MAIN MENU$|^MAIN MENU(?:\s+FOR\s+BUREAU\s+OF)?$|"
    r"^INDIAN STANDARDS HEADER$|^(?:आगंतुक की गणना|विज़िटर काउंट).*$"
)
#: How lines that the two patterns above match can begin; most others needn't be matched.
NAV_STARTS = tuple(map(ord, "lL[•○■▪hHsSmMiIआव"))
IMAGE = r"\[image\]"
CLAUSE = r"^(\d{1,2}(?:\.\d{1,2}){0,3})[.)]?\s+([A-Z(“\"].*)$"
FAQ = r"^(\d{1,3})[.)]\s+(.*\?)\s*$"
DOTTED_CLAUSES = 3
SCRIPT_SHARE = 0.30
CHUNK_CHARS, OVERLAP = 2000, 200
SHORTEST_DOCUMENT, MOST_BOILERPLATE, SHORTEST_RAW = 200, 0.90, 100


def long_enough(docs: DataFrame) -> DataFrame:
    """Documents of SHORTEST_RAW characters and more, numbered from 0 by doc_id.

    The numbers come from two levels of counts (id ranges, then ids within
    one), so no task sorts all documents."""
    kept = docs.where(F.length("text") >= SHORTEST_RAW).withColumn("_range", F.floor(F.col("doc_id") / 65536))
    counts = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("doc_id")) - 1
    return kept.withColumn("_in", within).join(base, "_range").withColumn("doc_index", F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def page_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no, text, page of every cleaned line but page markers; 0 before the first marker.

    Documents without a marker need no window, so their lines aren't shuffled."""
    named = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body"))
    paged = F.contains(F.lower("body"), F.lit("[page"))
    # what lies within lines is cleaned in the whole text, and lines are only trimmed where a text has margins:
    # expressions within an array are slow
    cut = F.split("body", "\n", -1)
    split = F.when(T.margins(F.col("body")), F.transform(cut, T.strip)).otherwise(cut)
    lines = lambda rows: rows.withColumn("body", T.visible(F.col("body"))).select("doc", F.posexplode(split).alias("line_no", "text"))
    plain = lines(named.where(~paged)).select("doc", "line_no", "text", F.lit(0).alias("page"))
    number = F.when(F.col("text").rlike(PAGE_MARK), F.regexp_extract("text", PAGE_MARK, 1).cast("int"))
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(named.where(paged)).withColumn("mark", number).withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.lit(0)))
    return plain.unionByName(marked.where("mark is null").select("doc", "line_no", "text", "page"))


def judged_lines(lines: DataFrame, html: bool) -> DataFrame:
    """Lines with ``drop`` (why a line goes: nav, script, empty; else null), the
    text as it stays, and for HTML the heading above the content."""
    out = lines
    if html:
        at = F.min(F.when(F.col("text").rlike(HEADING), F.col("line_no"))).over(Window.partitionBy("doc"))
        out = out.withColumn("boundary", at)
        heading = F.max(F.when(F.col("line_no") == F.col("boundary"), F.trim(F.regexp_extract("text", HEADING, 1)))).over(Window.partitionBy("doc"))
        out = out.withColumn("heading", F.coalesce(heading, F.lit("")))
        above = F.col("line_no") <= F.col("boundary")
    else:
        out = out.withColumn("heading", F.lit(""))
        above = F.lit(False)
    shown = F.when(F.contains("text", F.lit("[image]")), F.regexp_replace("text", IMAGE, " ")).otherwise(F.col("text"))
    inked = T.strip(T.single_spaced(shown))
    nav = F.ascii("text").isin(*NAV_STARTS) & (F.col("text").rlike(LAST_UPDATED) | F.col("text").rlike(PDF_NAV))
    drop = (
        F.when(above, "nav").when(F.col("text") == "", "empty").when(nav, "nav")
        .when(T.script_ratio(F.col("text")) >= SCRIPT_SHARE, "script").when(inked == "", "nav")
    )
    return out.withColumn("drop", drop).withColumn("text", F.when(F.col("drop").isNull(), inked).otherwise(F.col("text"))).drop("boundary")


def boilerplate(judged: DataFrame) -> DataFrame:
    """One row for each document: lines, nav and script lines removed, characters kept, boilerplate share, quarantine."""
    kept = F.col("drop").isNull()
    rows = judged.groupBy("doc").agg(
        F.count("*").alias("lines"), F.count_if(F.col("drop") == "nav").alias("nav"), F.count_if(F.col("drop") == "script").alias("script"),
        F.coalesce(F.sum(F.when(kept, F.length("text"))), F.lit(0)).alias("chars"), F.count_if(kept).alias("kept"), F.max("page").alias("pages"),
    )
    share = T.rounded(F.when(F.col("lines") > 0, (F.col("nav") + F.col("script")) / F.col("lines")).otherwise(0.0), 3)
    rows = rows.withColumn("share", share)
    why = F.when(F.col("chars") < SHORTEST_DOCUMENT, "too_little_content").when(F.col("share") > MOST_BOILERPLATE, "mostly_boilerplate")
    return rows.withColumn("reason", why)


def clause_numbered(lines: DataFrame) -> DataFrame:
    """doc, numbered: whether DOTTED_CLAUSES lines or more have a dotted clause number."""
    return lines.groupBy("doc").agg(numbered().alias("numbered"))


def numbered() -> Column:
    """The same as an aggregate over a document's lines."""
    digit = F.ascii("text").between(ord("0"), ord("9"))
    dotted = digit & F.col("text").rlike(CLAUSE) & F.contains(F.regexp_extract("text", CLAUSE, 1), F.lit("."))
    return F.count_if(dotted) >= DOTTED_CLAUSES


def units(lines: DataFrame) -> DataFrame:
    """doc, unit, text, kind, clause, section, page_start, page_end of the units of kept lines.

    A clause or question begins a unit; a clause wins. A clause without dot
    names the section, which later units inherit, also questions."""
    tagged = lines.join(clause_numbered(lines), "doc")
    number = F.when(F.col("numbered") & F.col("text").rlike(CLAUSE), F.regexp_extract("text", CLAUSE, 1))
    faq = F.col("text").rlike(FAQ)
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumn("clause", number).withColumn("starts", F.col("clause").isNotNull() | faq)
    title = F.when(F.col("clause").isNotNull() & ~F.contains("clause", F.lit(".")), F.regexp_extract("text", CLAUSE, 2))
    tagged = tagged.withColumns({"unit": F.sum(F.col("starts").cast("int")).over(order), "section": F.coalesce(F.last(title, ignorenulls=True).over(order), F.lit(""))})
    kind = F.when(F.col("clause").isNotNull(), "clause").when(F.col("starts"), "faq")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    grouped = tagged.withColumn("kind", kind).groupBy("doc", "unit").agg(
        parts.alias("p"), F.max("kind").alias("kind"), F.max("clause").alias("clause"), F.max(F.when(F.col("starts") | (F.col("unit") == 0), F.col("section"))).alias("section"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    body = T.join_lines(F.transform("p", lambda x: x["text"]))
    return grouped.select("doc", "unit", body.alias("text"), F.coalesce("kind", F.lit("prose")).alias("kind"), F.coalesce("clause", F.lit("")).alias("clause"), F.coalesce("section", F.lit("")).alias("section"), "page_start", "page_end")


def hard_split(c: Column, most: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """Pieces of a text of at most ``most`` characters, cut behind sentences if
    possible; a piece begins with the last ``overlap`` characters before it."""
    sentences = F.split(F.regexp_replace(c, r"([.;:])\s+", "$1\x01"), "\x01", -1)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a, s):
        # n is the length of cur, so that joined texts are made once and not to be measured
        longer = F.when(a["n"] == 0, s).otherwise(F.concat(a["cur"], F.lit(" "), s))
        total = F.when(a["n"] == 0, F.length(s)).otherwise(a["n"] + 1 + F.length(s))
        full = (a["n"] > 0) & (a["n"] + 1 + F.length(s) > most)
        tail = F.trim(F.concat(F.substring(a["cur"], -overlap, overlap), F.lit(" "), s))
        begun = lambda t: F.struct(F.concat(a["out"], F.array(a["cur"])).alias("out"), t.alias("cur"), F.length(t).alias("n"))
        return F.when(full, let(tail, begun)).otherwise(F.struct(a["out"].alias("out"), longer.alias("cur"), total.alias("n")))

    parts = F.aggregate(sentences, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
    stride = most - overlap
    cut = lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(0), F.ceil((F.length(p) - most) / stride).cast("int")), lambda i: F.substring(p, i * stride + 1, F.lit(most)))
    )
    return F.when(F.length(c) <= most, F.array(c)).otherwise(F.flatten(F.transform(parts, cut)))


def pack_groups(units_: Column, most: int) -> Column:
    """The number of the chunk that each unit (len, brk, alone) goes to, by one greedy pass.

    A unit joins the chunk before it while lengths plus two each stay within
    ``most``, unless it breaks (a top-level clause) or stands alone (a table,
    or a unit longer than a chunk). The state is a few numbers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.lit(True).alias("closed"))

    def step(a, u):
        cost = u["len"] + 2
        new = u["alone"] | a["closed"] | u["brk"] | (a["n"] + cost > most)
        return F.struct(F.when(new, cost).otherwise(a["n"] + cost).alias("n"), F.when(new, a["chunk"] + 1).otherwise(a["chunk"]).alias("chunk"), u["alone"].alias("closed"))

    return F.transform(states(units_, start, step), lambda s: s["chunk"])


def packed(units_: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """units with ``chunk``, the number of the packed chunk within the document."""
    row = F.struct("unit", F.length("text").alias("len"), ((F.col("clause") != "") & ~F.contains("clause", F.lit("."))).alias("brk"), ((F.col("kind") == "table_rows") | (F.length("text") > most)).alias("alone"), F.struct(*units_.columns).alias("own"))
    docs = units_.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("u"))
    each = docs.select("u", pack_groups(F.col("u"), most).alias("g")).select(F.explode(F.arrays_zip("u", "g")).alias("z"))
    return each.select(*[F.col("z.u.own").getField(c).alias(c) for c in units_.columns], F.col("z.g").alias("chunk"))


def chunks(units_: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """doc, seq, text, kind, section, clauses, page_start, page_end of the
    packed and split chunks, before deduplication; the first unit gives the labels."""
    parts = F.array_sort(F.collect_list(F.struct("unit", "text", "kind", "section", "clause", "page_start", "page_end")))
    whole = packed(units_, most).groupBy("doc", "chunk").agg(parts.alias("p"))
    first = F.get("p", F.lit(0))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    clauses = F.array_distinct(F.filter(F.transform("p", lambda x: x["clause"]), lambda x: x != ""))
    whole = whole.select("doc", "chunk", body.alias("body"), first["kind"].alias("kind"), first["section"].alias("section"), clauses.alias("clauses"), first["page_start"].alias("page_start"), F.array_max(F.transform("p", lambda x: x["page_end"])).alias("page_end"))
    pieces = F.when(F.col("kind") == "table_rows", F.array("body")).otherwise(hard_split(F.col("body"), most))
    return whole.select("doc", "chunk", F.posexplode(pieces).alias("piece", "text"), "kind", "section", "clauses", "page_start", "page_end")


def emitted(chunked: DataFrame) -> DataFrame:
    """Chunks whose key is new in their document, numbered from 0, with ids, facets and sizes."""
    keyed = chunked.withColumn("key", T.dedupe_key(F.col("text")))
    one = Window.partitionBy("doc", "key").orderBy("chunk", "piece")
    fresh = keyed.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    index = F.row_number().over(Window.partitionBy("doc").orderBy("chunk", "piece")) - 1
    refs = T.references(F.col("text"))
    top = F.when(F.size("clauses") > 0, F.regexp_extract(F.get("clauses", F.lit(0)), r"^(\d+)", 1)).otherwise("")
    out = fresh.withColumn("chunk_index", index).withColumn("clause_top", top)
    return out.withColumns({
        "chunk_id": F.format_string("doc%03d_chunk%04d", F.col("doc").cast("long"), F.col("chunk_index")),
        "parent_id": F.format_string("doc%03d_sec%s", F.col("doc").cast("long"), F.when(F.col("clause_top") == "", "_root").otherwise(F.col("clause_top"))),
        "is_numbers": F.when(F.size(refs) > 0, F.concat(F.lit("|"), F.array_join(refs, "|"), F.lit("|"))).otherwise(""),
        "status": T.status(F.col("text")), "amendment": T.amendment(F.col("text")), "sector": T.sector(F.col("text")), "char_count": F.length("text"),
    })


def section_of(chunk_rows: DataFrame) -> DataFrame:
    """parent_id and the ids of its chunks in order: a chunk's parent_id finds its
    siblings. One list for each section, so a section's ids are not repeated for each of its chunks."""
    return chunk_rows.groupBy("parent_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("siblings"))


def chunk_counts(chunked: DataFrame) -> DataFrame:
    """doc, made, chunks: how many chunks there are before and after deduplication (:func:`emitted`), from their keys in one pass."""
    keys = chunked.select("doc", T.dedupe_key(F.col("text")).alias("key")).groupBy("doc", "key").agg(F.count("*").alias("n"))
    return keys.groupBy("doc").agg(F.sum("n").alias("made"), F.count("*").alias("chunks"))


def corpus_report(stats: DataFrame, chunked: DataFrame) -> DataFrame:
    """One row for each document, quarantined ones too: chunks, duplicates and the reason."""
    out = stats.join(chunk_counts(chunked), "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc", "reason", zero("chunks").alias("chunks"), (zero("made") - zero("chunks")).alias("duplicates"), "chars")


def row_groups(lengths: Column, most: int = 1800) -> Column:
    """Group numbers of table rows packed to ``most`` characters, one more each; only whole rows."""
    no = F.lit(False)
    return pack_groups(F.transform(lengths, lambda x: F.struct((x - 1).alias("len"), no.alias("brk"), no.alias("alone"))), most)


SEPARATORS = ("\n\n", "\n", ". ", " ")


def legacy_split(c: Column, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The pieces of :func:`legacy_parts`."""
    return legacy_parts(c, most, overlap, separators)["pieces"]


def legacy_parts(c: Column, most: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """struct<by, pieces>: a text by the first separator whose pieces all fit.

    Parts are joined again while they fit; a piece begins with the last
    ``overlap`` characters before it. Where no separator does, the text is cut
    every ``most - overlap`` characters. Pieces are stripped, empty ones dropped.
    ``by``: the separator; empty where it was cut, null for a text that fits whole."""

    def pieces(sep: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

        def step(a, part):
            longer = F.when(a["cur"] == "", part).otherwise(F.concat(a["cur"], F.lit(sep), part))
            full = (F.length(longer) > most) & (a["cur"] != "")
            tail = F.substring(a["cur"], -overlap, overlap) if overlap else F.lit("")
            return F.struct(F.when(full, F.concat(a["out"], F.array(T.strip(a["cur"])))).otherwise(a["out"]).alias("out"), F.when(full, F.concat(tail, F.lit(sep), part)).otherwise(longer).alias("cur"))

        done = lambda a: F.when(T.strip(a["cur"]) == "", a["out"]).otherwise(F.concat(a["out"], F.array(T.strip(a["cur"]))))
        return F.aggregate(F.split(c, "\\Q" + sep + "\\E", -1), start, step, done)

    stride = most - overlap
    told = lambda by, got: F.struct(F.lit(by).cast("string").alias("by"), F.filter(got, lambda x: x != "").alias("pieces"))
    out = told("", F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / stride).cast("int")), lambda i: T.strip(F.substring(c, i * stride + 1, F.lit(most)))))
    for sep in reversed(separators):
        got = pieces(sep)
        out = F.when(F.contains(c, F.lit(sep)) & F.forall(got, lambda x: F.length(x) <= most), told(sep, got)).otherwise(out)
    return F.when(F.length(c) <= most, told(None, F.array(T.strip(c)))).otherwise(out)


def structure(lines: DataFrame, chunked: DataFrame) -> DataFrame:
    """doc, numbered, pages, chunks, duplicates of each document that has any structure to tell."""
    pages = lines.groupBy("doc").agg(F.max("page").alias("pages"), numbered().alias("numbered"))
    out = pages.join(chunk_counts(chunked), "doc").withColumn("duplicates", F.col("made") - F.col("chunks"))
    return out.where("numbered or pages > 0 or duplicates > 0").select("doc", "numbered", "pages", "chunks", "duplicates")
