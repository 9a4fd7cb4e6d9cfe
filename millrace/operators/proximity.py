"""Product records guessed from the lines around a standard number.

The pairing is a guess, so the records carry the untrusted method and the
quality gate rejects all of them; they serve for audits only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# How far the guess looks, what it looks for, and its defaults.
BACK, AHEAD, AROUND = 8, 3, 6
STATUS_WORD = r"(?i)\b(mandatory|compulsory|voluntary|optional)\b"
SCHEME = r"(?i)(?:Scheme\s+[IVXLCDM]+|ISI\s*Mark|Self[\s-]Declaration|CRS|Compulsory\s+Registration)"
PENALTY = r"(?i)(?:penalty|fine|imprisonment|punish[^.]{0,100})"
DEFAULT_STATUS, DEFAULT_SCHEME = "Mandatory", "ISI Mark (Scheme I)"


def extract(lines: DataFrame) -> DataFrame:
    """doc, line_no, product_name, is_standard_number, mandatory_or_voluntary,
    scheme_type, penalty_clause, extraction_method of lines(doc, line_no, text, title).

    The name is the nearest usable line above, else below, else the title. At
    the first line the search above, and at the last the one below, sees the
    line itself. Of equal names (60 characters) and numbers the first stays.
    """
    order = Window.partitionBy("doc").orderBy("line_no")
    text = T.strip(F.col("text"))
    good = F.when(T.legacy_name_ok(F.col("text")), text)
    seen = lines.withColumn("good", good).withColumns({
        "first": F.row_number().over(order) == 1, "final": F.lead("line_no").over(order).isNull(),
        "above": F.last("good", ignorenulls=True).over(order.rowsBetween(-BACK, -1)), "below": F.first("good", ignorenulls=True).over(order.rowsBetween(1, AHEAD)),
        "context": F.array_join(F.collect_list("text").over(order.rowsBetween(-AROUND, AROUND)), " "),
    })
    up = F.coalesce("above", F.when(F.col("first"), F.col("good")))
    down = F.coalesce("below", F.when(F.col("final"), F.col("good")))
    name = F.substring(F.coalesce(up, down, F.col("title")), 1, 120)
    word = lambda p, g, default: F.when(F.regexp_extract("context", p, g) != "", F.regexp_extract("context", p, g)).otherwise(default)
    status = F.concat(F.upper(F.substring(word(STATUS_WORD, 1, DEFAULT_STATUS), 1, 1)), F.lower(F.substring(word(STATUS_WORD, 1, DEFAULT_STATUS), 2, 100)))
    found = F.posexplode(F.regexp_extract_all("text", F.lit(T.LEGACY_REFERENCE), F.lit(0)))
    rows = seen.select("doc", "line_no", name.alias("product_name"), status.alias("mandatory_or_voluntary"), word(SCHEME, 0, DEFAULT_SCHEME).alias("scheme_type"), F.substring(F.regexp_extract("context", PENALTY, 0), 1, 200).alias("penalty_clause"), found.alias("pos", "number"))
    rows = rows.withColumn("is_standard_number", F.trim("number"))
    one = Window.partitionBy("doc", F.substring("product_name", 1, 60), "is_standard_number").orderBy("line_no", "pos")
    kept = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.select("doc", "line_no", "product_name", "is_standard_number", "mandatory_or_voluntary", "scheme_type", "penalty_clause", F.lit("text_proximity").alias("extraction_method"))
