"""Metrics of single answers, their summaries and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# The least values of the gate.
THRESHOLDS = {
    "retrieval_recall_at_k": 0.70,
    "mrr": 0.60,
    "faithfulness": 0.80,
    "answer_relevance": 0.75,
    "citation_accuracy": 0.85,
    "refusal_accuracy": 0.90,
    "route_accuracy": 0.80,
}
#: gate metric -> column of a result row
METRICS = {
    "retrieval_recall_at_k": "retrieval_recall", "mrr": "mrr", "faithfulness": "faithfulness", "answer_relevance": "answer_relevance",
    "citation_accuracy": "citation_accuracy", "refusal_accuracy": "refusal_correct", "route_accuracy": "route_correct",
}


def _holds(source: Column, digits: Column) -> Column:
    return F.contains(F.concat_ws(" ", source["title"], source["url"]), digits)


def row_metrics(rows: DataFrame) -> DataFrame:
    """The metrics of each answer, null where they don't apply.

    ``rows``: expected_route, route, must_refuse, answer, expected_number,
    expected_phrases array, sources array<struct<title, url>>, stripped array, error.
    """
    fine = F.col("error").isNull()
    digits = T.base_number(F.col("expected_number"), 1)
    expects = fine & F.col("expected_number").isNotNull() & (digits != "")
    at = F.array_position(F.transform("sources", lambda s: _holds(s, digits)), True)
    refused = T.is_refusal(F.col("answer"))
    low = F.lower("answer")
    hits = F.size(F.filter("expected_phrases", lambda p: F.contains(low, F.lower(p))))
    removed = F.size("stripped")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return rows.withColumns({
        "route_correct": F.when(fine & F.col("expected_route").isNotNull(), yes(F.col("route") == F.col("expected_route"))),
        "refusal_correct": F.when(fine, yes(refused == F.col("must_refuse"))),
        "retrieval_recall": F.when(expects, yes(at > 0)),
        "mrr": F.when(expects, F.when(at > 0, 1.0 / at).otherwise(0.0)),
        "answer_relevance": F.when(fine & F.col("must_refuse"), yes(refused)).when(fine & (F.size("expected_phrases") > 0), hits / F.size("expected_phrases")),
        "citation_accuracy": F.when(fine, yes(removed == 0)),
        "faithfulness": F.when(fine, F.greatest(F.lit(0.0), 1 - 0.3 * F.least(removed, F.lit(3)))),
    })


def mean(c: str) -> Column:
    return T.rounded(F.avg(c), 4)


def index_percentile(rows: DataFrame, value: str, p: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and the value at place max(1, floor(n p / 100)) of those above 0, in ascending order.

    Not an interpolated percentile. Counts of equal values come first, so a
    value that many rows share is one row of the window."""
    counts = rows.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    one = Window.partitionBy(*keys)
    upto = one.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(one)})
    hit = placed.where(F.col("_upto") >= F.greatest(F.lit(1), F.floor(F.col("_all") * p / 100)))
    return hit.groupBy(*keys).agg(F.min(value).alias(f"p{p}"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: counts, the gate's metrics and mean latency."""
    return rows.agg(
        F.count("*").alias("total"), F.count("error").alias("errors"), *[mean(c).alias(m) for m, c in METRICS.items()], mean("latency_s").alias("mean_latency")
    )


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Counts and means for each value of ``key``; rows without one are "unknown"."""
    name = F.coalesce(key, F.lit("unknown")).alias(key)
    return rows.groupBy(name).agg(F.count("*").alias("n"), mean("refusal_correct").alias("refusal"), mean("answer_relevance").alias("relevance"), mean("route_correct").alias("route"), mean("faithfulness").alias("faithfulness"))


def gate(summary_row: DataFrame) -> DataFrame:
    """metric, value, least of every metric below its threshold; null metrics pass."""
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("least")) for m, t in THRESHOLDS.items()]))
    return summary_row.select(long.alias("x")).select("x.*").where("value is not null and value < least")


def compare(runs: DataFrame, value: str) -> DataFrame:
    """Change of ``value`` from each run to the next; runs(run, value). Each run is
    numbered within its range of names, then meets the one before it by number."""
    ranged = runs.repartitionByRange("run").withColumn("_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    base = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("run")) + F.col("_b")
    placed = ranged.join(F.broadcast(base), "_part").withColumn("_n", nth)  # a row for each partition
    last = placed.select((F.col("_n") + 1).alias("_n"), F.col(value).alias("_last"))
    return placed.join(last, "_n", "left").withColumn("change", F.col(value) - F.col("_last")).select(*runs.columns, "change")


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled and share of rows whose field is neither null, empty nor 0."""
    filled = [F.count_if(F.col(f).isNotNull() & ~F.col(f).cast("string").isin("", "0")).alias(f) for f in fields]
    counts = rows.agg(F.count("*").alias("_all"), *filled)
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields]))
    return counts.select("_all", long.alias("x")).select("x.field", "x.filled", T.rounded(F.col("x.filled") / F.nullif("_all", F.lit(0)), 3).alias("share"))


def size_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, least, upper median and most of a length, by counts of equal values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    one = Window.partitionBy(*keys)
    placed = counts.withColumns({"_upto": F.sum("_n").over(one.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(one)})
    median = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col(value)))
    return placed.groupBy(*keys).agg(F.min(value).alias("least"), median.alias("median"), F.max(value).alias("most"))
