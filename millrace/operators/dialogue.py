"""Routing, follow-up resolution, history, citation guardrail, context and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# The routes' patterns in order, and the bounds of a conversation's memory.
GREETING = (
    r"^(hi+|hii+|hiii+|hello+|hey+|helo+|howdy|greetings|sup|yo)[\.!?]*$",
    r"^(good\s+(morning|afternoon|evening|night))[\.!?]*$",
    r"^(namaste|namaskar)[\.!?]*$",
    r"^(thanks|thank\s+you|thank\s+u|thx|ty|tysm|ty\s+so\s+much)[\.!?]*$",
    r"^(bye|goodbye|see\s+you|cya|take\s+care)[\.!?]*$",
    r"^(ok|okay|sure|got\s+it|understood|alright|cool|great|nice|wow|awesome)[\.!?]*$",
)
OUT_OF_SCOPE = (
    r"\b(gst rate|income tax|customs duty|tax slab|tds)\b",
    r"\b(legal advice|lawsuit|sue\s+(?:them|him|her|someone)|court case)\b",
    r"\b(stock market|share price|mutual fund|crypto|bitcoin)\b",
    r"\b(recipe|how to cook|restaurant near)\b",
    r"\b(weather (?:today|tomorrow|forecast)|cricket (?:score|match)|movie (?:ticket|review)|song|joke)\b",
    r"\b(who are you|your prompt|system prompt|ignore (?:all|previous) instructions)\b",
)
STRUCTURED = (
    r"\bIS\s*\d+",
    r"\b(which|what|whats|what's)\s+(is\s+)?(indian\s+)?standard\b",
    r"\bstandard\b.{0,40}\b(for|of|applicable|applies|apply|cover|covers|governs|governing)\b",
    r"\b(applies|applicable)\b.{0,40}\b(standard|product|certification)\b",
    r"\bwhat (is|are) the (is|indian) standard",
    r"\bcertif(y|ied|ication).{0,20}\b(standard|is \d+)\b",
    r"\b(compulsory|mandatory|voluntary)\b.{0,40}\b(standard|certification|registration|is \d+|for|to sell|selling|import)\b",
    r"\bqco\b",
    r"\bquality control order\b",
    r"\b(covered|listed)\b.{0,20}\bunder\b.{0,25}\b(qco|crs|scheme|compulsory)\b",
    r"\b(product|item).{0,30}\b(standard|mark|is \d+)\b",
    r"\blist of products\b",
    r"\bwhich products\b.{0,30}\b(require|need|mandatory|covered)\b",
)
PROCEDURE = (
    r"\bhow (do|to|can)\b.{0,30}\b(apply|get|obtain|certif|register|licen)\b",
    r"\b(apply|application)\b.{0,30}\b(bis|certification|license|licence|hallmark)\b",
    r"\b(steps?|process|procedure)\b.{0,30}\b(certif|hallmark|register|licen)\b",
    r"\b(scheme [ivxlcdm]+|scheme i|scheme ii|fmcs|crs)\b",
    r"\bforeign manufacturer\b",
    r"\blicen[sc]e.{0,20}\bfee\b",
    r"\bhow (long|many days|much time)\b.{0,30}\b(certif|hallmark|licen)\b",
    r"\bdocument.{0,20}\b(required|needed)\b",
    r"\bsurveillance (audit|visit)\b",
)
FAQ = (
    r"\bwhat is\b.{0,30}\b(bis|hallmark|isi mark|certification|qco|crs)\b",
    r"\bhallmark\b",
    r"\bgold\b.{0,30}\b(purity|caratage|fineness|huid)\b",
    r"\bconsumer\b.{0,20}\b(complaint|grievance|care|bis care)\b",
    r"\bisi mark\b",
    r"\bhuid\b",
    r"\bbenef(it|its)\b.{0,30}\b(hallmark|certif|bis)\b",
    r"\bverif(y|ication)\b.{0,30}\b(hallmark|huid|isi)\b",
    r"\bcharges?\b.{0,30}\b(hallmark|certif)\b",
    r"\bfaq\b",
)
ROUTES = (("greeting", GREETING), ("out_of_scope", OUT_OF_SCOPE), ("structured_lookup", STRUCTURED), ("procedure_rag", PROCEDURE), ("faq_rag", FAQ))
DEFAULT_ROUTE = "faq_rag"
REFERENTIAL = (
    r"(?i)\b(it|its|it's|they|them|their|theirs|this|that|these|those|same|there|above|previous|earlier|former|latter|one|ones|both)\b"
)
ELLIPTIC = (
    r"(?i)^\s*(and|also|but|so|then|ok|okay|what about|how about|whats about|what if|why|why not|how come|any|anything else)\b"
)
CHITCHAT = (
    r"(?i)^\s*(hi+|hii+|hello+|hey+|helo+|howdy|greetings|sup|what'?s up|good\s+(morning|afternoon|evening|night)|namaste|namaskar|thanks|"
    r"thank\s+you|thx|ty|bye|goodbye|ok|okay|sure|cool|great|nice|wow|lol|hmm+|yep|yes|no|nope|got\s+it|got\s+that|understood|alright|cheers)[\.!?]*\s*$"
)
SHORT_QUERY, LOOKBACK, MAX_TERMS, HISTORY = 4, 4, 6, 12
UNVERIFIED = "[number not in sources]"
LOW_NOTE = "\n\nLow confidence: the sources may not cover this question fully."
SHORTEST_QUERY, LONGEST_QUERY = 3, 1000


def group(patterns: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def route(c: Column) -> Column:
    """The first route with a matching pattern."""
    q = F.lower(T.strip(c))
    out = F.lit(DEFAULT_ROUTE)
    for name, patterns in reversed(ROUTES):
        out = F.when(q.rlike(group(patterns)), name).otherwise(out)
    return out


def query_ok(c: Column) -> Column:
    return F.length(c).between(SHORTEST_QUERY, LONGEST_QUERY)


def needs_context(q: Column, has_history: Column) -> Column:
    short = F.regexp_count(q, F.lit(r"[\p{L}\p{N}_]+")) <= SHORT_QUERY  # "what's" is two words
    return has_history & ~q.rlike(CHITCHAT) & (q.rlike(REFERENTIAL) | q.rlike(ELLIPTIC) | short)


def history(turns: DataFrame, last: int = HISTORY) -> DataFrame:
    """The latest well-formed messages of each conversation; turns(conv_id, turn, role, text)."""
    good = turns.where("role in ('user', 'assistant') and text is not null and trim(text) <> ''")
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return good.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)


def before(turns: DataFrame, last: int = LOOKBACK) -> DataFrame:
    """Every user message with the array ``past`` of the non-empty messages before it, oldest first."""
    good = turns.where("role in ('user', 'assistant') and trim(text) <> ''")
    frame = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    return good.withColumn("past", F.collect_list(F.struct("role", "text")).over(frame)).where("role = 'user'")


def topic_terms(q: Column, past: Column) -> Column:
    """Up to MAX_TERMS terms of the history that the query lacks.

    Standard numbers first, the newest message's before others, each with its
    bare digits; then the content words of the newest user message that has any.
    """
    newest = F.reverse(past)
    digits = lambda t: T.own_number(t)
    of_text = lambda m: F.flatten(F.transform(T.references(m["text"]), lambda t: F.filter(F.array(t, digits(t)), lambda x: x != "")))
    numbers = F.flatten(F.transform(newest, of_text))
    spoken = F.filter(F.transform(F.filter(newest, lambda m: m["role"] == "user"), lambda m: T.content_terms(m["text"])), lambda w: F.size(w) > 0)
    words = F.coalesce(F.get(spoken, F.lit(0)), F.array().cast("array<string>"))
    present = F.regexp_extract_all(F.lower(q), F.lit(r"(?U)\b[\w/]{3,}\b"), F.lit(0))
    fresh = F.filter(F.array_distinct(F.concat(numbers, words)), lambda t: ~F.array_contains(present, F.lower(t)))
    return F.slice(fresh, 1, MAX_TERMS)


def resolve(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text, needs, terms and the query to search with."""
    rows = before(turns)
    needs = needs_context(F.col("text"), F.size("past") > 0)
    terms = F.when(F.col("needs"), topic_terms(F.col("text"), F.col("past"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("needs", needs).withColumn("terms", terms)
    return rows.withColumn("resolved", F.when(F.size("terms") > 0, F.concat_ws(" ", F.col("text"), F.array_join("terms", " "))).otherwise(F.col("text"))).select(
        "conv_id", "turn", "text", "needs", "terms", "resolved"
    )


def guard(answer: Column, context: Column) -> tuple[Column, Column]:
    """(clean answer, removed numbers): standard numbers whose base digits no
    number in the context shares are replaced whole. Numbers of one digit, or of
    more than five, have no base, so they always are."""
    allowed = F.transform(F.regexp_extract_all(context, F.lit(T.WHOLE_REFERENCE), F.lit(0)), lambda t: T.own_number(t))
    allowed = F.array_remove(allowed, "")
    found = F.regexp_extract_all(answer, F.lit(T.WHOLE_REFERENCE), F.lit(0))
    between = F.split(answer, T.WHOLE_REFERENCE, -1)
    ok = lambda t: F.array_contains(allowed, T.own_number(t))
    told = F.transform(found, lambda t: F.when(ok(t), t).otherwise(UNVERIFIED))
    parts = F.zip_with(between, told, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(parts, ""), F.filter(found, lambda t: ~ok(t))


def context_block(hits: Column) -> Column:
    """Numbered sources with their texts; hits: array<struct<title, url, text>>."""
    said = F.transform(hits, lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), x["title"], F.lit("]\nURL: "), x["url"], F.lit("\n"), x["text"]))
    return F.array_join(said, "\n\n---\n\n")


def source_list(hits: DataFrame, keys: list[str]) -> DataFrame:
    """First hit for each url; hits: keys, kind (0 record, 1 chunk), position, url, similarity.

    Records without url are left out, one chunk without stays; records count as similarity 1."""
    usable = hits.where("not (kind = 0 and url = '')").withColumn("similarity", F.when(F.col("kind") == 0, 1.0).otherwise(F.col("similarity")))
    first = Window.partitionBy(*keys, "url").orderBy("kind", "position")
    kept = usable.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("kind", "position")))


def noted(answer: Column, low: Column) -> Column:
    """The answer with the note behind it where confidence is low."""
    return F.when(low, F.concat(answer, F.lit(LOW_NOTE))).otherwise(answer)


def decision(route_: Column, rows: Column, chunks: Column, confident: Column) -> Column:
    """What kind of answer a query gets."""
    return (
        F.when(route_.isin("greeting", "out_of_scope"), route_)
        .when((rows == 0) & (chunks == 0), "declined")
        .when((route_ == "structured_lookup") & (rows == 0), "noted")
        .when(~confident & (rows == 0), "low_confidence")
        .otherwise("answered")
    )
