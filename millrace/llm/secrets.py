"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over lower-cased
trigrams (:func:`query`): what every match must hold, as an OR of ANDs. A rule
whose expression demands no trigram (a run of hex digits) has no query and
scans every text. Postings (trigram, document) are made for the trigrams that
some rule asks for; a document is a candidate of a rule if the postings of all
trigrams of one of the rule's branches hold it. Candidates are then verified
with the whole expression, so a posting too many costs time only.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression and what a match must fulfil: ``group``
    is the part whose length, ``least`` at least, decides."""

    kind: str
    pattern: str
    group: int
    least: int


# The expressions and lengths of the contract.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

#: Strings that a part of an expression may be written as before they are turned into trigrams; branches of a query.
SPELLINGS, BRANCHES = 48, 64
#: A query: alternatives, each a set of trigrams that must all be there. ANY demands nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _simple(q: Query) -> Query:
    """Without alternatives that demand more than another one; ANY if too many are left."""
    q = frozenset(b for b in q if not any(c < b for c in q))
    return q if len(q) <= BRANCHES else ANY


def _both(a: Query, b: Query) -> Query:
    return _simple(frozenset(x | y for x in a for y in b))


def _of(strings: set[str]) -> Query:
    """What texts hold that hold one of these strings."""
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _sequence(items) -> tuple[set[str] | None, Query]:
    """(all lower-cased strings that the items may match, if few; what every match holds)."""
    whole, running, needed = True, {""}, ANY
    for op, arg in items:
        strings, own = _item(op, arg)
        if strings is not None and len(strings) * len(running) <= SPELLINGS:
            running = {a + b for a in running for b in strings}
            continue
        # what came so far ends here; what follows begins anew
        needed, whole = _both(_both(needed, _of(running)), own), False
        running = strings if strings is not None else {""}
    return (running if whole else None), _both(needed, _of(running))


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return ({chr(arg).lower()}, ANY) if arg < 128 else (None, ANY)
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:  # a class, a negation
                return None, ANY
        return (chars if len(chars) <= 4 else None), ANY
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        strings = set().union(*(s for s, _ in parts if s is not None))
        same = all(s is not None for s, _ in parts) and len(strings) <= SPELLINGS
        return (strings if same else None), _simple(frozenset().union(*(q for _, q in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, sub = arg
        strings, own = _sequence(sub)
        if strings is not None and most == 1:
            return strings | ({""} if not least else set()), ANY
        return None, own if least else ANY
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def query(pattern: str) -> Query:
    """What a text must hold, lower-cased, to match: read off the parsed expression."""
    return _sequence(parser.parse(pattern))[1]


def branches(rule: Rule) -> list[list[str]]:
    """The rule's query: a list of trigrams for each alternative; [] if it demands none."""
    q = query(rule.pattern)
    return [] if frozenset() in q else sorted(sorted(b) for b in q)


#: One character class and a plus, whose matches are the class's runs.
RUN = re.compile(r"\[\^?[^\[\]\\^]+\]\+")


def least_run(rule: Rule) -> str:
    """The expression of the matches that count: of a single class the runs of
    ``least`` characters or more, else the pattern itself."""
    if rule.group == 0 and RUN.fullmatch(rule.pattern):
        return rule.pattern[:-1] + "{%d,}" % rule.least
    return rule.pattern


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, key) for every trigram that a rule asks for and every text that holds it."""
    grams = sorted({g for r in rules for b in branches(r) for g in b})
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select("key", F.lower("text").alias("low")).select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Keys of the texts that the index cannot rule out, and the numbers of the rules that may match."""
    plan = [(nr, k, g, len(b)) for nr, r in enumerate(rules) for k, b in enumerate(branches(r)) for g in b]
    asked = docs.sparkSession.createDataFrame(plan, "rule int, branch int, trigram string, need int")
    hits = postings(docs, rules).join(F.broadcast(asked), "trigram")  # a row for each trigram of a rule
    full = hits.groupBy("key", "rule", "branch").agg(F.countDistinct("trigram").alias("n"), F.first("need").alias("need"))
    return full.where("n = need").groupBy("key").agg(F.collect_set("rule").alias("hit"))  # len(rules) at most


def running(items: Column, zero: Column, value: Callable, combine: Callable, out: Callable) -> Column:
    """``out(item, combined values of all items before it)`` for each item.

    An array can't be appended to without copying it, so the items are taken in
    about sqrt(n) chunks: n ** 1.5 steps instead of n ** 2. ``items`` must be a
    column that is there, not an expression: it is read again for each chunk."""
    n = F.size(items)
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    chunks = F.transform(numbers, lambda i: F.slice(items, i * chunk + 1, chunk))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: combine(a, value(x))))
    none = F.slice(F.array(zero), 1, 0)
    before = F.aggregate(
        totals, F.struct(zero.alias("at"), none.alias("out")),
        lambda a, t: F.struct(combine(a["at"], t).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    # per chunk, what lies before each of its items
    inner = F.zip_with(
        chunks, before,
        lambda c, b: F.aggregate(
            c, F.struct(b.alias("at"), none.alias("out")),
            lambda a, x: F.struct(combine(a["at"], value(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        ),
    )
    return F.zip_with(items, F.flatten(inner), out)


def found(rows: DataFrame, rule: Rule, nr: int, may: Column) -> DataFrame:
    """``rows`` with ``spans{nr}``, an array<struct<start,nr,stop,kind,size>> of
    the rule's matches in ``text``, in code points; none where ``may`` is not true.

    The pieces between matches (split) and the matches themselves give the
    positions; both are leftmost and don't overlap.
    """
    pattern, kept, text = least_run(rule), rows.columns, F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    rows = rows.withColumn("_may", may).select(*kept, F.when(F.col("_may"), whole).alias("_w"), F.when(F.col("_may"), judged).alias("_j"), F.when(F.col("_may"), F.split(text, pattern, -1)).alias("_g"))
    zipped = F.arrays_zip(F.slice("_g", 1, F.size("_w")).alias("g"), F.col("_w").alias("w"), F.col("_j").alias("j"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["g"]).cast("long").alias("g"), F.length(x["w"]).cast("long").alias("m"), F.length(x["j"]).alias("j")))
    spans = running(
        F.col("_s"), F.lit(0).cast("long"), lambda x: x["g"] + x["m"], lambda a, b: a + b,
        lambda x, at: F.struct((at + x["g"]).alias("start"), F.lit(nr).alias("nr"), (at + x["g"] + x["m"]).alias("stop"), F.lit(rule.kind).alias("kind"), x["j"].alias("size")),
    )
    spans = F.coalesce(F.filter(spans, lambda x: x["size"] >= rule.least), F.expr(NONE))
    return rows.select(*kept, F.when(F.size("_w") > 0, sizes).alias("_s")).select(*kept, spans.alias(f"spans{nr}"))


NONE = "cast(array() as array<struct<start:bigint,nr:int,stop:bigint,kind:string,size:int>>)"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with ``spans``, the matches of all rules by start, then rule.

    Rows are told apart by ``doc_id`` only to look up the index, so repeated
    rows and null ids are judged by their own text. A null text counts as
    empty. The input's columns stay, whatever they are called, under ``row``.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key")
    hinted = candidates(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), rules)
    # the text travels once, within its row
    joined = docs.select(F.struct("*").alias("row"), key).join(hinted.hint("shuffle_hash"), "key", "left")
    joined = joined.select("row", "hit", F.coalesce("row.text", F.lit("")).alias("text"))
    for nr, r in enumerate(rules):
        # most texts have none of the runs that a rule without trigrams asks for
        may = F.array_contains("hit", nr) if branches(r) else F.col("text").rlike(least_run(r))
        joined = found(joined, r, nr, may)
    return joined.select("row", "text", F.array_sort(F.concat(*[f"spans{nr}" for nr in range(len(rules))])).alias("spans"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(said, 256).alias("base_sha256"), said.alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every match replaced by ``mark``; overlapping spans
    become one. Columns stay as they are; ``n_chars``, if there, is recounted."""
    kept = running(F.col("spans"), F.lit(0).cast("long"), lambda x: x["stop"], lambda a, b: F.greatest(a, b), lambda x, at: F.struct(at.alias("a"), x["start"].alias("z")))
    end = F.array_max(F.transform("spans", lambda x: x["stop"]))
    gaps = F.concat(F.filter(kept, lambda x: x["z"] >= x["a"]), F.array(F.struct(end.alias("a"), F.length("text").cast("long").alias("z"))))
    # a piece is found from the text's beginning, so many pieces are cut from the list of its characters
    letters = F.when(F.size("spans") > 64, F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)))
    parted = scan(docs).select("row", "text", F.when(F.size("spans") > 0, gaps).alias("gaps"), letters.alias("letters"))
    few = F.transform("gaps", lambda x: F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["z"] - x["a"]).cast("int")))
    many = F.transform("gaps", lambda x: F.array_join(F.slice("letters", (x["a"] + 1).cast("int"), (x["z"] - x["a"]).cast("int")), ""))
    clean = F.array_join(F.when(F.col("letters").isNull(), few).otherwise(many), mark)
    done = parted.select("row", F.when(F.col("gaps").isNotNull(), clean).otherwise(F.col("row.text")).alias("clean"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            cols.append(F.coalesce(F.length("clean").cast("long"), F.col("row.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return done.select(*cols)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r(kind, nr, pattern, grp, least) AS (VALUES
 ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
 ('access', 1, 'AKIA[A-Z0-9]+', 0, 16),
 ('hex', 2, '[0-9a-f]+', 0, 32)),
a AS (SELECT doc_id, text, 'assign' AS kind, 0 AS nr, 8 AS least,
  string_split_regex(text, (SELECT pattern FROM r WHERE nr = 0)) AS gaps,
  regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS w,
  regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS j FROM t
 UNION ALL SELECT doc_id, text, 'access', 1, 16, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM t
 UNION ALL SELECT doc_id, text, 'hex', 2, 32, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM t),
b AS (SELECT doc_id, kind, nr, least, generate_subscripts(w, 1) AS i, unnest(w) AS m, unnest(j) AS g, unnest(gaps[1:len(w)]) AS gap FROM a WHERE len(w) > 0),
c AS (SELECT *, sum(length(gap)) OVER z + coalesce(sum(length(m)) OVER y, 0) AS start FROM b
 WINDOW z AS (PARTITION BY doc_id, kind ORDER BY i), y AS (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT), ',' ORDER BY start, nr) AS spans
 FROM c WHERE length(g) >= least GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN d USING (doc_id)
"""
