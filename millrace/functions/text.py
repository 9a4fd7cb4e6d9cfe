"""Text expressions. All are built from Spark's own functions and stay in the
JVM, but for NFKC, which Spark lacks; :func:`normalized` keeps rows of ASCII
values away from it. Unicode patterns are slow, so most expressions first ask
cheaply whether a value can match at all (``octet_length`` is ``length`` only for ASCII)."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns, word lists and characters that decide results.
INVISIBLE_LINE = "[‎‏‪‫‬‭‮⁦⁧⁨⁩​‌‍﻿]"
PRIVATE_USE = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}]"
DEVANAGARI = "[ऀ-ॿ]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
INVISIBLE_VALUE = "[‪-‮⁦-⁩‎‏​-‍﻿­]"
ARTEFACT = r"(?i)\[\s*(?:image|img|photo|picture|figure|table|logo)\s*\]"
EDGE = " \t\r\n-–—|·•,;:"
REFERENCE = r"\bIS(?:\s*/\s*(?:IEC|ISO))?\s*\d{1,5}(?:\s*\(\s*Part\s*[0-9IVXivx]+\s*\))?(?:\s*[:\-]\s*\d{4})?"
#: A reference as it is told and judged: its number is whole, whatever its length.
WHOLE_REFERENCE = REFERENCE.replace(r"\d{1,5}", r"\d+")
MANDATORY = r"(?i)\b(?:mandatory|compulsory|shall\s+conform|shall\s+bear|no\s+person\s+shall|prohibit(?:ion|ed)?)\b"
VOLUNTARY = r"(?i)\bvoluntary\b"
AMENDMENT = (
    r"\b((?:First|Second|Third|Fourth|Fifth|Sixth)\s+Amendment|Amendment)\b"
    r"(?:[^.\n]{0,40}?(\d{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]+,?\s+\d{4}|[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{4}))?"
)
SECTORS = (
    ("gold_jewellery", ("hallmark", "jewellery", "jeweller", "carat", "bullion", "assaying")),
    ("electrical", ("cable", "conductor", "transformer", "switchgear", "voltage", "lamp", "luminaire", "led", "electrical", "wire", "battery")),
    ("food", ("milk", "biscuit", "food", "drinking water", "mineral water", "infant", "edible", "sugar", "tea", "coffee")),
    ("construction", ("cement", "steel", "concrete", "plywood", "tile", "bitumen", "pipe", "brick", "glass")),
    ("chemicals", ("chemical", "pesticide", "technical grade", "acid", "paint", "polymer", "rubber", "explosive")),
    ("textiles", ("textile", "yarn", "fabric", "sack", "jute", "cotton", "silk")),
    ("machinery", ("machine", "pump", "valve", "wrench", "tool", "bearing", "cylinder", "helmet", "tyre")),
)
STOPWORDS = (
    "the", "and", "for", "are", "what", "which", "how", "does", "can", "you", "any", "all", "its", "with", "from",
    "into", "under", "about", "need", "needs", "needed", "require", "requires", "required", "apply", "get",
    "tell", "give", "know", "please", "india", "indian", "bis", "standard", "standards", "number", "applicable",
    "applies", "mandatory", "voluntary", "certification", "certified", "certify", "product", "products", "item",
    "items", "list", "info", "information", "detail", "details", "there", "this", "that", "have", "has", "was",
    "were", "will", "would", "should",
)
CARRY_NOISE = (
    "the", "and", "for", "are", "its", "covers", "cover", "covered", "specifies", "specified", "specify",
    "includes", "included", "including", "falls", "fall", "carry", "carries", "must", "should", "per", "also",
    "under", "used", "use", "using", "general", "regarding", "related", "tell", "explain", "know", "want", "need",
    "please", "thanks",
)
REFUSALS = (
    "not enough verified information", "cannot find", "outside my scope", "not in my sources", "not available in",
    "verify with the official", "designed to answer questions about bureau of indian standards",
)
LEGACY_REFERENCE = r"(?i)\bIS\s*[\d]+(?::\d{4})?(?:\s*\(Part\s*[\d]+\))?(?:\s*/\s*IEC\s*[\d:]+)?"
LEGACY_NUMERIC = r"^[\d\s.,;:()/-]{1,10}$"
LEGACY_HEADER = (
    r"(?i)^(?:s\.?\s*no\.?|sr\.?|serial|sl\.?|product|standard|title|is\s*no\.?|is\s*number|scheme|status|mandatory|"
    r"compulsory|category|item|particulars|description)\s*$"
)


BLANK = " \t\n\x0b\f\r"
#: White space beyond ASCII.
WIDE_BLANK = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; texts without are passed on, as trimming is slow."""
    tidy = F.ascii(c).between(33, 127) & F.ascii(F.right(c, F.lit(1))).between(33, 127)
    t = F.btrim(c, F.lit(BLANK))
    plain = (F.ascii(F.left(t, F.lit(1))) < 128) & (F.ascii(F.right(t, F.lit(1))) < 128)
    return F.when(tidy, c).when(plain, t).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def single_spaced(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c)


def visible(c: Column) -> Column:
    """Without invisible characters, white space within lines as single spaces."""
    seen = F.when(is_ascii(c), c).otherwise(F.regexp_replace(F.regexp_replace(c, INVISIBLE_LINE, ""), PRIVATE_USE, ""))
    return single_spaced(F.replace(F.replace(seen, F.lit("\u00a0"), F.lit(" ")), F.lit("\t"), F.lit(" ")))


def clean_line(c: Column) -> Column:
    return strip(visible(c))


def margins(c: Column) -> Column:
    """Whether a line of a :func:`visible` text may have white space at its ends."""
    out = c.startswith(" ") | c.endswith(" ") | (~is_ascii(c) & c.rlike(WIDE_BLANK))
    for mark in (" \n", "\n ", "\r", "\x0b", "\f"):
        out = out | F.contains(c, F.lit(mark))
    return out


def script_ratio(c: Column) -> Column:
    """Devanagari code points for each letter; above 1 where signs are many, 0 without letters."""
    letters = F.regexp_count(c, F.lit(LETTER))
    share = F.when(letters == 0, 0.0).otherwise(F.regexp_count(c, F.lit(DEVANAGARI)) / letters)
    return F.when(is_ascii(c), 0.0).when(c.rlike(DEVANAGARI), share).otherwise(0.0 * F.length(c))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(c: Column) -> Column:
    """Canonical form of an extracted value; null is empty. For whole tables see :func:`normalized`."""
    return tidy(_nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def normalized(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with these columns in canonical form. Spark runs a Python
    function on every row that its plan holds, whatever stands around it, so
    rows whose values are all ASCII, which NFKC leaves alone, are planned apart."""
    values = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names}
    plain = F.lit(True)
    for v in values.values():
        plain = plain & is_ascii(v)
    ours = rows.where(plain).withColumns({n: tidy(v) for n, v in values.items()})
    return ours.unionByName(rows.where(~plain).withColumns({n: tidy(_nfkc(v)) for n, v in values.items()}))


def tidy(text: Column) -> Column:
    """:func:`normalize` after NFKC."""
    text = F.regexp_replace(F.regexp_replace(text, INVISIBLE_VALUE, ""), ARTEFACT, " ")
    text = F.regexp_replace(F.translate(text, "�", " "), r"(?U)\s+", " ")
    return F.btrim(text, F.lit(EDGE))


def join_lines(lines: Column) -> Column:
    """Lines as one text; a word broken by a hyphen before a lower-case letter is mended."""
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\x01")
    return strip(F.translate(F.regexp_replace(joined, r"-\x01(?=\p{Ll})", ""), "\x01", " "))


def references(c: Column) -> Column:
    """Distinct standard references in order of appearance, their numbers whole."""
    found = F.regexp_extract_all(c, F.lit(WHOLE_REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def status(c: Column) -> Column:
    must, may = c.rlike(MANDATORY), c.rlike(VOLUNTARY)
    return F.when(must & ~may, "mandatory").when(may & ~must, "voluntary").otherwise("")


def amendment(c: Column) -> Column:
    label, date = F.regexp_extract(c, AMENDMENT, 1), F.regexp_extract(c, AMENDMENT, 2)
    return F.when(date != "", F.concat_ws(" ", label, date)).otherwise(label)


def sector(c: Column) -> Column:
    """The sector most of whose words occur; the earlier of equals, empty if none."""
    low = F.lower(c)
    scored = [
        F.struct(sum(F.contains(low, F.lit(w)).cast("int") for w in words).alias("hits"), F.lit(-i).alias("turn"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(SECTORS)
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"]).otherwise("")


def clause_label(clauses: Column) -> Column:
    n = F.size(clauses)
    return F.when(n == 1, F.concat(F.lit("Clause "), F.get(clauses, F.lit(0)))).when(
        n > 1, F.concat(F.lit("Clauses "), F.get(clauses, F.lit(0)), F.lit("–"), F.get(clauses, n - 1))
    )


def context_header(title: Column, section: Column, clauses: Column) -> Column:
    """title, section (unless the title holds it) and clause label, with dashes between."""
    own = F.when((section != "") & ~F.contains(F.lower(title), F.lower(section)), section)
    return F.concat_ws(" — ", F.when(title != "", title), own, clause_label(clauses))


def dedupe_key(c: Column) -> Column:
    return F.sha1(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))


def strip_thinking(c: Column) -> Column:
    closed = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    return strip(F.regexp_replace(closed, r"(?is)^\s*<think>.*$", ""))


def base_number(token: Column, least: int = 2) -> Column:
    return F.regexp_extract(token, r"\d{%d,5}" % least, 0)


def own_number(token: Column) -> Column:
    """Base digits of a whole reference; empty where its number isn't one of 2 to 5 digits."""
    digits = F.regexp_extract(token, r"\d{2,}", 0)
    return F.when(F.length(digits) <= 5, digits).otherwise("")


def tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def keywords(c: Column) -> Column:
    """Distinct words of three or more characters that aren't stopwords, in order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[\w/]{3,}\b"), F.lit(0)))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS))


def content_terms(c: Column) -> Column:
    return F.filter(keywords(c), lambda x: ~x.isin(*CARRY_NOISE) & ~x.rlike(r"^\d+$"))


def is_refusal(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def l2_normalise(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def fingerprint(provider: str, model: str, dim: int) -> str:
    return f"{provider}:{model}:{dim}"


def collection_name(prefix: str, mark: str) -> str:
    """A name of at most 63 characters for the index with this fingerprint."""
    name = f"{prefix}_{re.sub('[^A-Za-z0-9]+', '_', mark).strip('_').lower()}"
    return name if len(name) <= 63 else f"{name[:52]}_{hashlib.sha1(mark.encode()).hexdigest()[:10]}"


def render_row(columns: Column, values: Column) -> Column:
    """``column: value`` parts with bars between; blank values are left out."""
    pairs = F.transform(F.arrays_zip(columns.alias("c"), values.alias("v")), lambda x: F.struct(x["c"].alias("c"), F.btrim(F.coalesce(x["v"], F.lit("")), F.lit(" ,;")).alias("v")))
    return F.array_join(F.transform(F.filter(pairs, lambda x: x["v"] != ""), lambda x: F.concat(x["c"], F.lit(": "), x["v"])), " | ")


def legacy_name_ok(c: Column) -> Column:
    t = strip(c)
    whole = f"(?i)^(?:{LEGACY_REFERENCE[4:]})$"
    return (F.length(t) >= 5) & ~t.rlike(LEGACY_NUMERIC) & ~t.rlike(LEGACY_HEADER) & ~t.rlike(whole) & t.rlike("[A-Za-z]{3,}")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w.\-]", "_")


def title_from_url(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.initcap(F.translate(stem, "-_", "  "))


def fixed_width(c: Column, width: int) -> Column:
    return F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, width), width, " ")


def rounded(c: Column, digits: int) -> Column:
    """Half up for values of 0 and more, the same in every engine."""
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale
