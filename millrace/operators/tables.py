"""Tables from documents: column roles, continued rows, serial numbers, shredded rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.folds import states

# What header cells, numbers and row starts look like, and the known tables.
ROLES = {
    "serial": r"(?i)^(?:sr?\.?\s*no\.?|sl\.?\s*no\.?|s\.?\s*no\.?|serial|क्रम\s*सं\.?|क्रमांक)$",
    "is_number": r"(?i)(?:^|\b)(?:is\s*(?:no\.?|number)|indian\s*standard|standard\s*no\.?|आईएस|भारतीय\s*मानक)(?:\b|$)",
    "product": r"(?i)(?:product|title|description|item|particulars?|commodity|goods|उत्पाद|वस्तु)",
}
NUMBER_SHAPE = (
    r"(?i)^IS(?:\s*/\s*(?:IEC|ISO|IEEE))?\s*\d{1,5}(?:\s*-\s*\d{1,3})?"
    r"(?:\s*\(\s*Parts?\s*[0-9IVXivx]+(?:\s*(?:and|to|&|,|/|-)\s*(?:Sec\s*)?[0-9IVXivx]+)*\s*\))?(?:\s*[:\-]\s*\d{4})?$"
)
ROW_START = r"^(\d{1,4})[.)]?(?:\s+(.*))?$"
LOOKAHEAD = 4
BARE_NUMBER = r"^IS(?:\s*/\s*(?:IEC|ISO))?\s*\d{1,5}$"
PART_FIRST = r"^(\(\s*Part\s*[0-9IVXivx]+\s*\))\s*(\S.*)$"
DESIGNATION = r"^(IS(?:\s*/\s*(?:IEC|ISO))?\s*\d{1,5}(?:\s*\(\s*Part\s*[0-9IVXivx]+\s*\))?(?:\s*[:\-]\s*\d{4})?)\s+(\S.*)$"
#: name, header words, columns, whether the first cell may hold two, where wrapped lines belong
PROFILES = (
    ("products_simplified_procedure", ("Sr. No.", "Product/Title"), ("Sr. No.", "IS Number", "Product/Title"), True, "last"),
    ("empanelled_laboratories", ("Name of Lab", "OSL Code"), ("Sl. No.", "Name of Lab", "State", "Status", "OSL Code"), False, "first"),
)
PROFILE_LINES = 80
TABLE_CHARS = 1800


def number_ok(c: Column) -> Column:
    return c.rlike(NUMBER_SHAPE)


def _role(cells: Column, role: str, earlier: list[str]) -> Column:
    """Index of the first cell with this role and no earlier one, or null."""

    def is_it(x):
        x = T.strip(F.coalesce(x, F.lit("")))
        out = x.rlike(ROLES[role])
        for other in earlier:
            out = out & ~x.rlike(ROLES[other])
        return out

    at = F.array_position(F.transform(cells, lambda x: is_it(x)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def with_roles(rows: DataFrame) -> DataFrame:
    names = list(ROLES)
    return rows.withColumns({n: _role(F.col("cells"), n, names[:i]) for i, n in enumerate(names)})


def header_roles(rows: DataFrame) -> DataFrame:
    """Header rows and the columns of their roles; rows(page, table_no, row_no, cells)."""
    return with_roles(rows).where("is_number is not null and product is not null").select("page", "table_no", "row_no", *ROLES)


def records(rows: DataFrame) -> DataFrame:
    """doc, page, table_no, row_no, serial, is_number, product, the continued rows
    appended; rows(doc, page, table_no, row_no, cells).

    The latest header's columns hold until the document's next header, also on
    later pages; before any header only three-column tables are read. A row
    with a product but neither serial nor number continues the record before it.
    """
    order = Window.partitionBy("doc").orderBy("page", "table_no", "row_no")
    tagged = with_roles(rows).withColumn("is_header", F.col("is_number").isNotNull() & F.col("product").isNotNull())
    place = F.when(F.col("is_header"), F.struct("serial", "is_number", "product", F.size("cells").alias("width")))
    known = tagged.withColumn("m", F.last(place, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    default = F.when(F.size("cells") == 3, F.struct(F.lit(0).alias("serial"), F.lit(1).alias("is_number"), F.lit(2).alias("product"), F.lit(3).alias("width")))
    known = known.withColumn("m", F.coalesce("m", default)).where("not is_header and m is not null and size(cells) = m.width")
    cell = lambda r: F.coalesce(T.normalize(F.get("cells", F.col(f"m.{r}"))), F.lit(""))
    read = known.select("doc", "page", "table_no", "row_no", *[cell(r).alias(r) for r in ROLES])
    read = read.withColumn("starts", (F.col("serial") != "") | (F.col("is_number") != "")).where("starts or product <> ''")
    read = read.withColumn("record", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("record > 0")
    parts = F.array_sort(F.collect_list(F.struct("page", "table_no", "row_no", "serial", "is_number", "product")))
    out = read.groupBy("doc", "record").agg(parts.alias("p"))
    first = F.get("p", F.lit(0))
    text = F.array_join(F.transform(F.filter("p", lambda x: x["product"] != ""), lambda x: x["product"]), " ")
    return out.select("doc", *[first[c].alias(c) for c in ("page", "table_no", "row_no", "serial", "is_number")], text.alias("product"))


def gaps(rows: DataFrame, keys: list[str], serial: str, told: int = 1000) -> DataFrame:
    """keys, last, seen, gaps and missing serials between the first and the last.

    Gaps are found between neighbours, so far-apart serials cost nothing; of a
    gap of over ``told`` serials only the ends are listed, as "first-last"."""
    one = Window.partitionBy(*keys).orderBy(serial)
    each = rows.select(*keys, serial).distinct().withColumn("_next", F.lead(serial).over(one))
    a, z = F.col(serial) + 1, F.col("_next") - 1
    list_ = F.array_join(F.transform(F.sequence(a, F.least(z, a + told)), lambda x: x.cast("string")), ",")
    hole = F.when(z >= a, F.when(z - a < told, list_).otherwise(F.concat_ws("-", a.cast("string"), z.cast("string"))))
    each = each.select(*keys, F.col(serial).alias("_s"), hole.alias("_h"), F.greatest(z - a + 1, F.lit(0)).cast("long").alias("_g"))
    holes = F.array_sort(F.collect_list(F.when(F.col("_h").isNotNull(), F.struct("_s", "_h"))))
    return each.groupBy(*keys).agg(F.max("_s").alias("last"), F.count("*").alias("seen"), F.coalesce(F.sum("_g"), F.lit(0)).alias("gaps"), F.array_join(F.transform(holes, lambda x: x["_h"]), ",").alias("missing"))


def profile_of(lines: Column) -> Column:
    """Number of the table profile whose header words the first lines hold, else null."""
    head = F.array_join(F.slice(lines, 1, PROFILE_LINES), " \n")
    out = F.lit(None).cast("int")
    for i, (_, marks, *_rest) in reversed(list(enumerate(PROFILES))):
        hit = F.lit(True)
        for m in marks:
            hit = hit & F.contains(head, F.lit(m))
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def _merge(cells: Column, columns: int, split_first: bool, keep: str) -> Column:
    """Fragments of a row as at most ``columns - 1`` cells."""
    wanted = columns - 1
    first, second = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    fixed = cells
    if split_first:
        fused = first.rlike(DESIGNATION)
        apart = F.concat(F.array(F.regexp_extract(first, DESIGNATION, 1), F.regexp_extract(first, DESIGNATION, 2)), rest)
        late = (F.size(cells) > 1) & first.rlike(BARE_NUMBER) & second.rlike(PART_FIRST)
        moved = F.concat(
            F.array(F.concat_ws(" ", first, F.regexp_extract(second, PART_FIRST, 1)), F.regexp_extract(second, PART_FIRST, 2)),
            F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))),
        )
        fixed = F.when(fused, apart).when(late, moved).otherwise(cells)
    n = F.size(fixed)
    if keep == "last":
        packed = F.concat(F.slice(fixed, 1, wanted - 1), F.array(F.array_join(F.slice(fixed, wanted, F.greatest(n - wanted + 1, F.lit(1))), " ")))
    else:
        over = F.greatest(n - wanted + 1, F.lit(1))
        packed = F.concat(F.array(F.array_join(F.slice(fixed, 1, over), " ")), F.slice(fixed, over + 1, wanted - 1))
    return F.when(n <= wanted, fixed).otherwise(packed)


def reassemble(lines: DataFrame) -> DataFrame:
    """doc, profile, serial, page, cells of the rows of shredded tables.

    ``lines``: doc, line_no, text, page. A line begins row s if its number s is
    the expected serial or at most LOOKAHEAD beyond; that depends on the row
    accepted before, so one fold runs over each document's lines. Its state is
    two numbers; the texts are grouped afterwards.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", "page")))
    docs = lines.groupBy("doc").agg(ordered.alias("lines"))
    docs = docs.withColumn("profile", profile_of(F.transform("lines", lambda x: x["text"]))).where("profile is not null")
    number = lambda x: F.coalesce(F.regexp_extract(x["text"], ROW_START, 1).try_cast("int"), F.lit(-1))
    start = F.struct(F.lit(1).alias("expected"), F.lit(-1).alias("row"))

    def step(a, x):
        n = number(x)
        begins = (n >= a["expected"]) & (n <= a["expected"] + LOOKAHEAD)
        return F.struct(F.when(begins, n + 1).otherwise(a["expected"]).alias("expected"), F.when(begins, n).otherwise(-1).alias("row"))

    docs = docs.withColumn("rows", F.transform(states(F.col("lines"), start, step), lambda s: s["row"]))
    each = docs.select("doc", "profile", F.posexplode(F.arrays_zip("lines", "rows")).alias("pos", "z"))
    each = each.select("doc", "profile", "pos", F.col("z.lines.text").alias("text"), F.col("z.lines.page").alias("page"), F.col("z.rows").alias("row"))
    upto = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("island", F.sum((F.col("row") > 0).cast("int")).over(upto)).where("island > 0")
    part = F.when(F.col("row") > 0, F.regexp_extract("text", ROW_START, 2)).otherwise(F.col("text"))
    each = each.withColumn("part", T.strip(part))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "part", "page", "row")))
    whole = each.groupBy("doc", "profile", "island").agg(pieces.alias("p"))
    cells = F.transform(F.filter("p", lambda x: x["part"] != ""), lambda x: x["part"])
    merged = F.lit(None).cast("array<string>")
    for i, (_, _, columns, split_first, keep) in enumerate(PROFILES):
        merged = F.when(F.col("profile") == i, _merge(F.col("frags"), len(columns), split_first, keep)).otherwise(merged)
    return whole.withColumn("frags", cells).select("doc", "profile", F.get("p", F.lit(0))["row"].alias("serial"), F.get("p", F.lit(0))["page"].alias("page"), merged.alias("cells"))
