"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate (how often the mix takes it). Among all rates that
give a source its token target, those nearest to 1 in relative entropy are
``exp(lambda_source * size / mean size)``, held at ``CAP``. The dual is convex
and separates by source; it depends on a source's documents through their
histogram of sizes alone. Newton steps run on all sources' histograms side by
side, each in one expression, until every source has its target. Rates are
then rounded into copies so that each source's words follow its target.

Reruns agree: sums over rows are sums of whole numbers, and a histogram's
terms are added in the order of its sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop_stage, small, stage

#: The most copies of a document, and of a source's size in its target.
CAP = 3
# The weights of the sources in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Newton steps; a source that is not solved by then is an error.
STEPS = 400


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def ranges(df: DataFrame, name: str, *by: Column) -> tuple[DataFrame, Window, Window]:
    """``df`` dealt into ranges that follow each other in the order ``by`` (column
    ``_part``), the window of a range up to a row, and that of all ranges before one.

    The last one runs over a row for each partition, so no task sorts all rows."""
    dealt = stage(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), name)
    upto = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return dealt, upto, Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: shares by weight of all words, where a
    source stops at CAP times its size and the excess goes to the others.

    Sources in order of how soon they stop: with the first k stopped, the rest
    share ``(all - CAP * their sizes) / weights of the rest`` per weight; k is
    the first for which no further source would stop. One row for each source.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    named, upto, parts = ranges(every, "mix-sources", F.col("source").asc_nulls_last())
    base = named.groupBy("_part").agg(F.count("*").alias("n")).select("_part", zero(F.sum("n").over(parts)).alias("base"))
    nth = F.count(F.lit(1)).over(upto) - 1
    weighed = named.withColumn("nth", nth).join(F.broadcast(base), "_part")  # a row for each partition
    turn = F.pmod(F.col("nth") + F.col("base"), F.lit(len(weights))).cast("int")
    weighed = weighed.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))
    weighed = weighed.withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))

    dealt, upto, parts = ranges(weighed, "mix-ratios", F.col("ratio"), F.col("source").asc_nulls_last())
    total = dealt.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()  # two numbers
    base = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    base = base.select("_part", *[zero(F.sum(c).over(parts)).alias(f"base_{c}") for c in ("n", "s", "w")])
    steps = dealt.select("*", F.count(F.lit(1)).over(upto).alias("n"), F.sum("source_size").over(upto).alias("s"), F.sum("weight").over(upto).alias("w")).join(F.broadcast(base), "_part")
    steps = steps.withColumn("nth", F.col("n") + F.col("base_n"))
    stopped = F.col("s") + F.col("base_s") - F.col("source_size")  # of the sources before this one
    rest = F.lit(total["weight"]) - (F.col("w") + F.col("base_w") - F.col("weight"))
    steps = steps.withColumn("level", (F.lit(total["size"]) - CAP * stopped) / rest)
    at = steps.where("level <= ratio").agg(F.min(F.struct("nth", "level")).alias("at")).first()["at"]  # two numbers
    full = CAP * F.col("source_size").cast("double")
    target = full if at is None else F.when(F.col("nth") < at["nth"], full).otherwise(F.least(F.col("weight") * at["level"], full))
    out = stage(steps.select("source", "source_size", "weight", target.alias("target")), "mix-targets")
    for df in (named, dealt):
        drop_stage(df)
    return out


def tilt(mult: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(50.0), mult * size / mean)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def multipliers(histogram: DataFrame, goal: DataFrame, close: float = 1e-9) -> DataFrame:
    """The dual's solution: source, source_size, target, mean, full, lam.

    ``histogram``: source, size, n. Newton steps are kept inside a bracket that
    shrinks by halving where they would leave it, so long documents cannot throw
    them off. Sources whose target is CAP times their size need no multiplier:
    every rate is CAP. A source that STEPS steps don't bring within ``close`` of
    its target raises an error. A source's histogram has a row for each size, as
    many as its longest document has words at most.
    """
    filled = histogram.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct(F.col("size").cast("double").alias("size"), F.col("n").cast("double").alias("n")))).alias("hist"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    state = goal.join(filled.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    full = (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)) | (F.col("source_size") == 0)
    state = state.withColumn("full", full)
    wide = 1e300
    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-wide).alias("low"), F.lit(wide).alias("high"), F.lit(False).alias("done"))

    def sums(lam):
        """What the rates take, and how fast that grows with lam."""
        none = F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope"))
        return F.aggregate("hist", none, lambda a, x: _let(
            tilt(lam, x["size"], F.col("mean")),
            lambda r: F.struct((a["got"] + x["n"] * x["size"] * r).alias("got"), (a["slope"] + F.when(r < CAP, x["n"] * x["size"] * r * x["size"] / F.col("mean")).otherwise(0.0)).alias("slope")),
        ))

    def moved(a, t):
        short = t["got"] < F.col("target")
        low, high = F.when(short, a["lam"]).otherwise(a["low"]), F.when(short, a["high"]).otherwise(a["lam"])
        newton = a["lam"] + (F.col("target") - t["got"]) / F.nullif(t["slope"], F.lit(0.0))
        middle = F.when(low == -wide, high - 1 - F.abs(high)).when(high == wide, low + 1 + F.abs(low)).otherwise((low + high) / 2)
        inside = F.coalesce((newton > low) & (newton < high) & (F.abs(newton - a["lam"]) <= 1 + F.abs(a["lam"])), F.lit(False))
        done = F.abs(t["got"] / F.col("target") - 1) <= close
        lam = F.when(done, a["lam"]).when(inside, newton).otherwise(middle)
        return F.struct(lam.alias("lam"), low.alias("low"), high.alias("high"), done.alias("done"))

    step = lambda a, _: F.when(a["done"], a).otherwise(_let(sums(a["lam"]), lambda t: moved(a, t)))
    solved = F.when(~F.col("full"), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step))
    state = stage(state.withColumn("dual", solved).select("source", "source_size", "target", "mean", "full", "dual"), "mix-dual")
    open_ = state.where("not full and not dual.done").select("source").first()
    if open_:
        raise RuntimeError(f"mixing: {STEPS} Newton steps do not bring source {open_[0]!r} to its target")
    return state.select("source", "source_size", "target", "mean", "full", F.col("dual.lam").alias("lam"))


def running(df: DataFrame, group: list[str], order: list[str], value: str, name: str, blocks: int = 256) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group up to this one.

    The order begins with a uniform 64-bit hash; its top bits deal each group
    out to ``blocks`` blocks, whose sums (``blocks`` rows for each group) give
    every block its start. So no group is a single task's work.
    """
    df = df.withColumn("_block", F.shiftrightunsigned(F.col(order[0]), 64 - blocks.bit_length() + 1))
    sums = df.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias("_" + g) for g in group], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_block") == F.col("_b")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col("_" + g))
    within = F.sum(value).over(Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_in", within).join(base, same).withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_b", "_base", "_block", *["_" + g for g in group])


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repairs: int = 3) -> DataFrame:
    """doc_id, tie, source, size, source_size, target, rate, copies of every row.

    Sizes are words; a null text has none. A null source is a source, the last
    in order. Copies are whole: 0 to CAP of each document. They come from
    systematic rounding (along an order by hash, a document is taken where the
    running sum of rates passes a whole number), then ``repairs`` passes give a
    copy more or less to documents, along the same order, until a source's
    words miss its target by less than the next document. Equal rows may get
    different copies; a rerun gives the same. Documents of size 0 keep one
    copy. ``tie`` is a hash of the text, which tells rows of one doc_id apart.
    Other columns of ``docs`` are not read.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words(F.coalesce("text", F.lit(""))).alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), F.lit(17)).alias("order"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    sized = stage(sized, "mix-sizes")
    histogram = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("size"))
    goal = targets(by_source, weights)
    solved = multipliers(histogram, goal.drop("weight")).withColumnRenamed("source", "s2")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(CAP)).otherwise(tilt(F.col("lam"), F.col("size"), F.col("mean")))
    rated = sized.join(small(solved), F.col("source").eqNullSafe(F.col("s2"))).withColumn("rate", rate).drop("s2", "lam", "mean", "full")
    # whole parts in billionths, so that sums don't depend on their order
    rated = rated.withColumn("part", F.round(F.col("rate") * 10**9).cast("long"))
    order = ["order", "doc_id", "tie", "size"]
    summed = running(rated, ["source"], order, "part", "upto")
    chosen = summed.withColumn("copies", (F.floor(F.col("upto") / 10**9) - F.floor((F.col("upto") - F.col("part")) / 10**9)).cast("long"))
    chosen = chosen.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.col("copies"), F.lit(CAP))).cast("long"))
    keep = ["doc_id", "tie", "source", "size", "order", "source_size", "target", "rate", "copies"]
    chosen = stage(chosen.select(*keep), "mix-copies")
    for _ in range(repairs):
        got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("goal")).select(F.col("source").alias("s2"), F.round(F.col("goal") - F.col("got")).cast("long").alias("miss"))
        asked = chosen.join(small(got), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        sign = F.signum("miss").cast("long")
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("miss")) & (F.col("copies") + sign).between(0, CAP) & (sign != 0)
        asked = running(asked.withColumn("step", F.when(fits, F.col("size")).otherwise(F.lit(0))), ["source"], order, "step", "upto")
        turned = F.when(fits & (F.col("upto") <= F.abs("miss")), F.col("copies") + sign).otherwise(F.col("copies"))
        turned_ = stage(asked.withColumn("copies", turned).select(*keep), "mix-copies")
        drop_stage(chosen)
        chosen = turned_
    for df in (sized, histogram, goal):
        drop_stage(df)
    return chosen


def mixed_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    plan = copies(docs).groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.col("source").alias("_s"))
    plan = plan.agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_d0"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t0"), F.col("source").alias("_s0"))
    same = F.col("_d0").eqNullSafe(F.col("_d")) & (F.col("_t0") == F.col("_t")) & F.col("_s0").eqNullSafe(F.col("_s"))
    joined = keyed.join(plan.hint("shuffle_hash"), same)
    # rows that agree in id, text and source are dealt their copies in turn
    nth = F.row_number().over(Window.partitionBy("_d0", "_t0", "_s0").orderBy("_n"))
    shared = F.floor(F.col("_n") / F.col("_rows")) + (nth <= F.pmod("_n", "_rows")).cast("long")
    taken = joined.where("_rows = 1").select("_row", F.col("_n").alias("_c")).unionByName(joined.where("_rows > 1").select("_row", shared.alias("_c")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c")))
    return taken.where("_c > 0").select("_row", each).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
