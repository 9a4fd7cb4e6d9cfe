"""The quality gate for product records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# The rules of the gate.
NUMERIC = r"^[\d\s.,;:()/\[\]#*+-]*$"
HEADER_WORD = (
    r"s\.?\s*no\.?|sr\.?\s*no\.?|serial(?:\s*no\.?)?|sl\.?\s*no\.?|product(?:\s*name)?|standard(?:\s*(?:no\.?|number|title))?|title|"
    r"is\s*(?:no\.?|number)|scheme(?:\s*type)?|status|remarks?|mandatory(?:\s*/?\s*voluntary)?|compulsory|category|item|"
    r"particulars?|description|sector|page|annexure?|contents?"
)
HEADER = rf"(?i)^(?:{HEADER_WORD})(?:\s*[/|,&+-]\s*(?:{HEADER_WORD}))*$"
NAVIGATION = (
    r"(?i)^(?:home|about|about\s+us|contact(?:\s+us)?|sitemap|search|login|read\s+more|click\s+here|back|next|previous|menu|"
    r"skip\s+to\s+content|what'?s\s+new|downloads?|tenders?|careers?|feedback|disclaimer|privacy\s+policy|terms|faqs?|"
    r"क्या\s*नया\s*है|होम|हमारे\s*बारे\s*में|संपर्क|खोज|मुख्य\s*पृष्ठ|डाउनलोड|निविदा|प्रतिक्रिया)$"
)
NUMBER_ONLY = r"(?i)^IS(?:\s*/\s*(?:IEC|ISO))?\s*\d{2,5}(?:\s*\(\s*Part\s*[0-9IVXivx]+\s*\))?(?:\s*[:\-]\s*\d{4})?$"
FRAGMENT = (
    r"(?i)^(?:purposes?|dimensions?|applications?|requirements?|specifications?|general|others?|etc\.?|type|types|grade|grades|"
    r"parts?|radial\s+ply|and\s+.*|or\s+.*|for\s+.*|of\s+.*|with\s+.*|thereof|above|below|contd\.?|continued)$"
)
PAGINATION = r"(?i)^(?:next|prev(?:ious)?|first|last|more|back|top)(?:\s+(?:next|prev(?:ious)?|first|last|more|back|top))*$"
NOTICE = (
    r"(?i)^(?:grant(?:ing)?|issue|issuance|withdrawal|cancellation|suspension|amendment|revision|inclusion|deletion|"
    r"extension|renewal|transfer)\s+(?:of|to|for)\b"
)
ESTABLISHING = (
    r"(?i)quality\s*control\s*order|\bqco\b|compulsory\s*registration(?:\s*scheme)?|\bcrs\b\s*order|"
    r"products?\s*under\s*compulsory\s*certification|compulsory\s*certification|hallmarking\s*(?:quality\s*control\s*)?(?:order|regulation)"
)
NO_STATUS = (
    r"(?i)simplified\s*procedure|empanelled|empanelment|laborator(?:y|ies)|recognized\s*labs?|test(?:ing)?\s*facilit"
)
TRUSTED = ("curated", "table_parse")
SHORTEST_NAME = 4
UNKNOWN_STATUS = "status not established by source"


def name_issue(name: Column) -> Column:
    """The first rule that a normalised name breaks; null if it is fine."""
    return (
        F.when(name == "", "empty_after_normalisation")
        .when(name.rlike(NUMERIC), "numeric_or_punctuation_only")
        .when(F.length(name) < SHORTEST_NAME, "too_short")
        .when(~name.rlike(T.LETTER), "no_alphabetic_content")
        .when(name.rlike(HEADER), "table_header")
        .when(name.rlike(NAVIGATION), "website_navigation")
        .when(name.rlike(NUMBER_ONLY), "is_number_in_name_column")
        .when(name.rlike(FRAGMENT), "wrapped_cell_fragment")
        .when(name.rlike(PAGINATION), "pagination_chrome")
        .when(name.rlike(NOTICE), "notice_headline")
        .when(name.rlike("[।?!]$"), "sentence_not_product_name")
        .when(~name.rlike(T.LETTER + "{3,}"), "no_word_of_three_letters")
    )


def status_basis(reference: Column, url: Column, title: Column) -> Column:
    """Whether the sources establish a legal status; those known not to are asked first."""
    said = F.concat_ws(" ", reference, url, title)
    return F.when(said.rlike(NO_STATUS), "unknown").when(said.rlike(ESTABLISHING), "established").otherwise("unknown")


def method(c: Column) -> Column:
    """Of a normalised value."""
    low = F.lower(c)
    return F.when(low == "", "unknown").otherwise(low)


def reasons(records_method: Column, name: Column, number: Column) -> Column:
    """All reasons against a record, in order."""
    return F.array_compact(
        F.array(
            F.when(~records_method.isin(*TRUSTED), F.concat(F.lit("untrusted_extraction:"), records_method)),
            name_issue(name),
            F.when(number == "", "missing_is_number").when(~number.rlike(r"\d"), "is_number_has_no_digits"),
        )
    )


def validate(records: DataFrame) -> DataFrame:
    """``records`` with normalised texts, reasons, ok, status_basis and status_note.

    Where the status isn't established, an accepted record's claim is replaced
    and its scheme emptied. Columns that are missing count as empty.
    """
    held = set(records.columns)
    texts = ["product_name", "is_standard_number", "standard_title", "mandatory_or_voluntary", "scheme_type", "qco_reference", "source_url"]
    out = records.withColumns({c: F.lit("") for c in texts if c not in held})
    out = T.normalized(out, [*(c for c in texts if c in held), "extraction_method"])
    out = out.withColumn("extraction_method", method(F.col("extraction_method")))
    out = out.withColumn("reasons", reasons(F.col("extraction_method"), F.col("product_name"), F.col("is_standard_number")))
    out = out.withColumns({"ok": F.size("reasons") == 0, "status_basis": status_basis(F.col("qco_reference"), F.col("source_url"), F.col("standard_title"))})
    open_status = F.col("ok") & (F.col("status_basis") == "unknown")
    source = F.when(F.col("qco_reference") == "", "the cited document").otherwise(F.col("qco_reference"))
    return out.withColumns({
        "mandatory_or_voluntary": F.when(open_status, UNKNOWN_STATUS).otherwise(F.col("mandatory_or_voluntary")),
        "scheme_type": F.when(open_status, "").otherwise(F.col("scheme_type")),
        "status_note": F.when(open_status, F.concat(F.lit("no status from '"), source, F.lit("'"))).otherwise(""),
    })


def reason_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def sorted_reasons(counts: DataFrame) -> DataFrame:
    """nth, reason, n: the most frequent first, equal ones by name. There are as many rows as rules."""
    return counts.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), "reason"))).select("nth", "reason", "n")
