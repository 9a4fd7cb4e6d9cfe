"""The chat and health surfaces as functions over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dialogue as D
from millrace.operators import lookup, quality
from millrace.operators import retrieval as R

# Widths of the product tables and the categories that routes prefer.
NAME_WIDTH, OPEN_NAME_WIDTH, NUMBER_WIDTH, SCHEME_WIDTH, SOURCE_WIDTH = 45, 52, 20, 28, 36
PREFERRED = {"procedure_rag": ("certification", "qco", "hallmarking"), "faq_rag": ("faq", "consumer", "hallmarking")}


def product_context(rows: Column) -> Column:
    """Two tables of records: with an established status, and without; an empty one is left out.

    rows: array<struct<product_name, is_standard_number, scheme_type, mandatory_or_voluntary, qco_reference, status_basis>>."""
    known = F.filter(rows, lambda r: r["status_basis"] == "established")
    other = F.filter(rows, lambda r: r["status_basis"] != "established")
    a = F.transform(known, lambda r: F.concat_ws(" ", T.fixed_width(r["product_name"], NAME_WIDTH), T.fixed_width(r["is_standard_number"], NUMBER_WIDTH), T.fixed_width(r["scheme_type"], SCHEME_WIDTH), r["mandatory_or_voluntary"]))
    b = F.transform(other, lambda r: F.concat_ws(" ", T.fixed_width(r["product_name"], OPEN_NAME_WIDTH), T.fixed_width(r["is_standard_number"], NUMBER_WIDTH), F.substring(r["qco_reference"], 1, SOURCE_WIDTH)))
    part = lambda title, x: F.when(F.size(x) > 0, F.concat(F.lit(title + "\n"), F.array_join(x, "\n")))
    return F.concat_ws("\n\n", part("STATUS ESTABLISHED", a), part("STATUS NOT ESTABLISHED", b))


def chat(asked: DataFrame, docs: DataFrame, vectors: DataFrame, query_vectors: DataFrame, records: DataFrame, category: str) -> DataFrame:
    """item_id, route, n_rows, n_chunks, confidence, kind, sources of each asked(item_id, text).

    Greetings and off-topic queries reach no join. Dense search is by the given
    query vectors(item_id, embedding); queries without one are lexical only.
    The answer itself is the service's text model's and not made here."""
    routed = asked.where(D.query_ok(F.col("text"))).withColumn("route", D.route(F.col("text")))
    inside = routed.where(~F.col("route").isin("greeting", "out_of_scope"))
    fused = R.fuse(R.dense(vectors, query_vectors.join(inside.select("item_id"), "item_id", "left_semi")), R.bm25(docs, inside.select("item_id", "text")))
    faceted = fused.join(docs.select("doc_id", F.col(category).alias("_category")), "doc_id", "left").join(inside.select("item_id", "route"), "item_id")
    wanted = F.lit(False)
    for route, names in PREFERRED.items():
        wanted = wanted | ((F.col("route") == route) & F.col("_category").isin(*names))
    final = R.select_final(R.prefer(faceted, F.coalesce(wanted, F.lit(False))))
    chunks = final.groupBy("item_id").agg(F.count("*").alias("n_chunks"), F.max("similarity").alias("confidence"), F.array_sort(F.collect_list(F.struct("final", "doc_id"))).alias("s"))
    rows = lookup.cut(lookup.structured(records, inside.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), lookup.ROWS)).groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n_rows"))
    out = routed.join(chunks, "item_id", "left").join(rows, "item_id", "left").fillna(0, ["n_chunks", "n_rows"]).fillna(0.0, ["confidence"])
    kind = D.decision(F.col("route"), F.col("n_rows"), F.col("n_chunks"), F.col("confidence") >= R.THRESHOLD)
    return out.select("item_id", "route", "n_rows", "n_chunks", "confidence", kind.alias("kind"), F.transform(F.coalesce("s", F.array().cast("array<struct<final:int,doc_id:bigint>>")), lambda x: x["doc_id"]).alias("sources"))


def health(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """part, name, n: chunks, records, accepted ones and the reasons against the others."""
    checked = quality.validate(records)
    counts = checked.agg(F.count("*").alias("records"), F.count_if("ok").alias("accepted"))
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("records", "accepted")])).alias("x")).select(F.lit("records").alias("part"), "x.name", "x.n")
    reasons = quality.reason_counts(checked).select(F.lit("rejected").alias("part"), F.col("reason").alias("name"), "n")
    return chunks.agg(F.count("*").alias("n")).select(F.lit("index").alias("part"), F.lit("chunks").alias("name"), "n").unionByName(long).unionByName(reasons)


def systematic_sample(rows: DataFrame, keys: list[str], order: str, k: int, blocks: int = 65536) -> DataFrame:
    """Every max(1, n // k)-th row of each group by the whole number ``order``, from the first.

    Rows are numbered by two levels of counts (ranges of ``order``, then rows
    within one), so no group is one task's work."""
    dealt = rows.withColumn("_range", F.floor(F.col(order) / blocks))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    one = Window.partitionBy(*keys)
    base = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(one.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(one).alias("_all"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    placed = dealt.withColumn("_in", within).join(base, [*keys, "_range"])
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / k))
    return placed.withColumn("_step", step).where("(_in + _before) % _step = 0").select(*rows.columns)


def containing(rows: DataFrame, text: str, needle: str, order: str, most: int = 20) -> DataFrame:
    """The first ``most`` rows by ``order`` whose text holds ``needle`` in any case."""
    return rows.where(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(order).limit(most)


def extractive(text: Column, words: int = 12) -> Column:
    """The stand-in for the service's text model: the first words of the best source."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, words), " ")


def stream(answers: DataFrame) -> DataFrame:
    """stream_id, seq, type, text of the events that an answer is sent as.

    answers: stream_id, route, kind, confidence, low (low confidence), answer,
    removed (numbers that the guard took out, told only after the text was sent).
    First what is known before the text, then the text word by word, a note where
    confidence is low, the removed numbers if any, and the end."""
    said = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    meta = F.concat_ws("|", "route", "kind", F.format_number("confidence", 4), F.col("low").cast("string"))
    none = F.expr("cast(array() as array<struct<type:string,text:string>>)")
    parts = F.concat(
        F.array(said("meta", meta)),
        F.transform(F.split("answer", "(?<= )", -1), lambda w: said("token", w)),
        F.when(F.col("low"), F.array(said("token", F.lit(D.LOW_NOTE)))).otherwise(none),
        F.when(F.size("removed") > 0, F.array(said("stripped_is", F.array_join("removed", ",")))).otherwise(none),
        F.array(said("done", F.lit(""))),
    )
    return answers.select("stream_id", F.posexplode(parts).alias("seq", "e")).select("stream_id", F.col("seq").cast("long").alias("seq"), "e.type", "e.text")


def end_guard(deltas: DataFrame, contexts: DataFrame) -> DataFrame:
    """stream_id, removed: the numbers in a stream's whole text that its context
    doesn't hold. The text was sent before; this only reports.

    deltas: stream_id, seq, delta; contexts: stream_id, context."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    told = deltas.groupBy("stream_id").agg(T.strip_thinking(whole).alias("text")).join(contexts, "stream_id", "left")
    _, removed = D.guard(F.col("text"), F.coalesce("context", F.lit("")))
    return told.select("stream_id", removed.alias("removed"))
