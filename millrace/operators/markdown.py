"""Blocks and inline parts of Markdown answers, by windows over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# What lists, separators and inline parts look like.
BULLET = r"^\s*[-*•]\s+(.+)$"
NUMBERED = r"^\s*\d+\.\s+(.+)$"
RULE_CELL = r"^[-:\s]+$"
INLINE = (
    r"\[[^\]]+\]\([^)]+\)|\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`|"
    r"\bIS(?:/(?:IEC|ISO))?\s*\d{2,5}(?!\d)(?:\s*\(\s*Part\s*[0-9IVXivx]+\s*\))?(?:\s*[:\-]\s*\d{4})?"
)


def blocks(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, kind, items of each text's blocks.

    Kinds: h2, h3, h4, quote, p (one item), ul, ol (an item for each entry),
    table (an item for each row, cells joined by bars; rules under the head are
    left out), code (an item for each line). A list or table is a run of such
    lines; a fence that is never closed holds the rest."""
    line, mark = F.col("line"), F.col("t")
    lines = rows.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line")).withColumn("t", T.strip(line))
    order = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("fence", mark.startswith("```")).withColumn("fences", F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kind = (
        F.when(F.col("fence"), F.lit(None)).when(F.col("fences") % 2 == 1, "code").when(mark.startswith("|") & mark.endswith("|"), "table")
        .when(line.rlike(BULLET), "ul").when(line.rlike(NUMBERED), "ol").when(mark == "", F.lit(None))
        .when(mark.startswith("### "), "h4").when(mark.startswith("## "), "h3").when(mark.startswith("# "), "h2").when(mark.startswith("> "), "quote").otherwise("p")
    )
    cells = F.transform(F.split(F.substring(mark, 2, F.greatest(F.length(mark) - 2, F.lit(0))), r"\|", -1), T.strip)
    item = (
        F.when(F.col("kind") == "ul", F.regexp_extract(line, BULLET, 1)).when(F.col("kind") == "ol", F.regexp_extract(line, NUMBERED, 1)).when(F.col("kind") == "table", F.array_join(cells, "|"))
        .when(F.col("kind") == "h4", F.substring(mark, 5, F.length(mark))).when(F.col("kind") == "h3", F.substring(mark, 4, F.length(mark)))
        .when(F.col("kind").isin("h2", "quote"), F.substring(mark, 3, F.length(mark))).otherwise(line)
    )
    rule = (F.col("kind") == "table") & F.forall(cells, lambda c: (c != "") & c.rlike(RULE_CELL))
    told = lines.withColumn("kind", kind)
    runs = F.col("kind").isin("ul", "ol", "table", "code")
    begins = F.col("kind").isNotNull() & ~F.coalesce(runs & F.col("kind").eqNullSafe(F.lag("kind").over(order)), F.lit(False))
    told = told.withColumns({"item": item, "rule": rule, "begins": begins})
    told = told.withColumn("block", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind is not null and not (rule and not begins)")
    parts = F.array_sort(F.collect_list(F.struct("n", "item")))
    out = told.groupBy(key, "block").agg(F.max("kind").alias("kind"), parts.alias("p"))
    return out.select(key, (F.col("block") - 1).cast("int").alias("ord"), "kind", F.transform("p", lambda x: x["item"]).alias("items"))


def inline(c: Column) -> Column:
    """array<struct<kind, text>> of a line: text, link, bold, italic, code and
    standard numbers; one of more than five digits is no standard number but text."""
    gaps = F.split(c, INLINE, -1)
    found = F.regexp_extract_all(c, F.lit(INLINE), F.lit(0))
    cut = lambda x, a, b: F.substring(x, a + 1, F.length(x) - a - b)

    def part(x: Column) -> Column:
        kind = F.when(x.startswith("["), "link").when(x.startswith("**"), "bold").when(x.startswith("*"), "italic").when(x.startswith("`"), "code").otherwise("standard")
        body = F.when(kind == "link", F.regexp_extract(x, r"^\[([^\]]+)\]", 1)).when(kind == "bold", cut(x, 2, 2)).when(kind == "standard", x).otherwise(cut(x, 1, 1))
        return F.struct(kind.alias("kind"), body.alias("text"))

    both = F.zip_with(gaps, found, lambda g, x: F.array(F.struct(F.lit("text").alias("kind"), g.alias("text")), F.when(x.isNotNull(), part(x))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull() & (x["text"] != ""))
