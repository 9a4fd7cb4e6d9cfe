"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; one of fewer splits than cores (a single row group
    is one task's work) is dealt out over all cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or
    the context's checkpoint folder. Where neither is set, a session on one
    machine (``local[...]``, as in tests) gets a temporary one; on a cluster that
    is an error, as executors would write to disks that others can't read."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(context, "_millrace_shared", None)
        if root is None:
            root = context._millrace_shared = "file://" + tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The tables that a query's last plan reads stay until :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _staged(spark).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_stage = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stage(df: DataFrame) -> None:
    """Delete a table made by :func:`stage` that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_millrace_stage", None)
    if path:
        _delete(spark, path)
        _staged(spark).discard(path)


def _staged(spark: SparkSession) -> set[str]:
    if not hasattr(spark.sparkContext, "_millrace_staged"):
        spark.sparkContext._millrace_staged = set()
    return spark.sparkContext._millrace_staged


def release(spark: SparkSession) -> None:
    """Delete all tables that this context's queries still hold in the shared
    folder. Results that are not written or collected yet can't be read after it."""
    for path in sorted(_staged(spark)):
        _delete(spark, path)
    _staged(spark).clear()


def texts(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` as long and the whole ``text`` (null: empty), without any other column."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)


def small(df: DataFrame, rows: int = 50_000, size: int = 8 << 20) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows of numbers and at
    most ``size`` bytes in its strings; beyond that, left to a shuffled join."""
    text = [F.coalesce(F.octet_length(name), F.lit(0)).cast("long") for name, kind in df.dtypes if kind == "string"]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(text, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df
