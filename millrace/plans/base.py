"""Registration of queries, and small inline tables that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "part") else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a file of one row group would be one task's work.
    Tables of as many splits as there are cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Inline:
    """A table written out in place: a Spark schema and its rows.

    With ``key`` or ``vary`` its queries run at the scale of the tables: every
    part has all rows, with keys of its own (part * 100 + key) and, for odd
    parts, the part's number behind the text ``vary``."""

    def __init__(self, schema: str, rows: list[tuple], key: str | None = None, vary: str | None = None):
        self.schema, self.rows, self.key, self.vary = schema, rows, key, vary

    def df(self, spark: SparkSession) -> DataFrame:
        """The rows as they are written."""
        return spark.createDataFrame(self.rows, self.schema)

    def over(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The rows for every part."""
        out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_k")).join(F.broadcast(self.df(spark)), how="cross")
        if self.key:
            out = out.withColumn(self.key, F.col("_k") * 100 + F.col(self.key))
        if self.vary:
            out = out.withColumn(self.vary, F.when(F.col("_k") % 2 == 1, F.concat(F.col(self.vary), F.lit(" "), F.col("_k").cast("string"))).otherwise(F.col(self.vary)))
        return out.drop("_k")

    def sql(self) -> str:
        names = [c.strip().split()[0] for c in self.schema.split(", ")]
        rows = f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) AS t({', '.join(names)})"
        if not (self.key or self.vary):
            return rows
        told = {n: n for n in names}
        if self.key:
            told[self.key] = f"p_partkey * 100 + {self.key}"
        if self.vary:
            told[self.vary] = f"CASE WHEN p_partkey % 2 = 1 THEN {self.vary} || ' ' || p_partkey ELSE {self.vary} END"
        return f"(SELECT {', '.join(f'{c} AS {n}' for n, c in told.items())} FROM part CROSS JOIN {rows}) AS t"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"
