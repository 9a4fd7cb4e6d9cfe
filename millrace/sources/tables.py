"""Readers, writers and keyed upserts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT = "source_url string, source_type string, title string, category string, raw_text string, scraped_at string"


def _filled(rows: DataFrame) -> DataFrame:
    filled = rows.fillna("", subset=[f.name for f in rows.schema if f.dataType.simpleString() == "string"])
    return filled.withColumn("scraped_at", F.try_to_timestamp("scraped_at")) if "scraped_at" in filled.columns else filled


def read_json(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """A JSON array of records; missing fields are empty, the time is parsed."""
    return _filled(spark.read.option("multiLine", True).schema(schema).json(path))


def read_json_checked(spark: SparkSession, path: str, schema: str = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(:func:`read_json`'s records, file and text of what could not be parsed)."""
    raw = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path)
    # Spark reads no query that asks for the unparsed text alone
    bad = raw.where(F.col("_bad").isNotNull() & F.col(raw.columns[0]).isNull()).select(F.input_file_name().alias("file"), F.col("_bad").alias("text"))
    return _filled(raw.where("_bad is null").drop("_bad")), bad


def binary_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, text of UTF-8 files; bytes that are no UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def questions(rows: DataFrame, category: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Golden questions of a category, the first ``limit`` of them by ``order``."""
    kept = rows if category is None else rows.where(F.col("category") == category)
    return kept if limit is None else kept.orderBy(order).limit(limit)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, and only
    on one machine, where none is set, a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def paged_text(pages: DataFrame) -> DataFrame:
    """doc, text of page texts (doc, page, text): ``[Page n]`` before each page that isn't blank."""
    inked = pages.where("trim(text) <> ''").select("doc", "page", F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), F.col("text")).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("page", "t")))
    return inked.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def allowed(files: DataFrame, allow: DataFrame, deny: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, denied files with their reason), by filename."""
    return files.join(allow, "filename", "left_semi"), files.join(deny, "filename")


def latest(spark: SparkSession, pattern: str) -> DataFrame:
    """The records of the newest file by name that matches."""
    rows = spark.read.json(pattern).withColumn("_f", F.input_file_name())
    newest = rows.agg(F.max("_f").alias("_m"))
    return rows.join(F.broadcast(newest), F.col("_f") == F.col("_m")).drop("_f", "_m")


def upsert_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Both tables' rows, the first of each key kept; old rows come before new ones."""
    return _upsert(old, new, keys, F.col("_side"), F.col(seq))


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key kept."""
    return _upsert(old, new, keys, F.col("_side").desc(), F.col(seq).desc())


def _upsert(old, new, keys, *order):
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n", "_side")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON, in the columns of DOCUMENT; missing ones are empty."""
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in names]
    docs.select(*cols).write.mode("overwrite").json(path)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Projected columns, null as empty; every part file has a header."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cols).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def write_run(results: DataFrame, summary: DataFrame, path: str, run: str) -> None:
    results.write.mode("overwrite").json(f"{path}/{run}_results")
    summary.withColumn("run", F.lit(run)).coalesce(1).write.mode("overwrite").json(f"{path}/{run}_summary")


def log_failures(spark: SparkSession, path: str, failures: list[tuple[str, str]]) -> None:
    rows = spark.createDataFrame(failures, "url string, reason string").withColumn("at", F.current_timestamp())
    rows.write.mode("append").parquet(path)


def scalars(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Arrays as comma-separated text, other non-scalars as JSON."""
    out = []
    for f in (schema or df.schema).fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name))
        elif kind in ("struct", "map"):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def metadata(*columns: str) -> Column:
    """A row's metadata as JSON: arrays as comma-separated text, nulls left out."""
    return F.to_json(F.struct(*columns))


def events(df: DataFrame) -> DataFrame:
    """Server-sent event texts of rows (stream_id, seq, type, ...)."""
    body = F.to_json(F.struct(*[c for c in df.columns if c not in ("stream_id", "seq")]))
    return df.select("stream_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("event"))


def parse_events(df: DataFrame, schema: str) -> DataFrame:
    """Rows of event texts, possibly several in one text; others are skipped."""
    one = df.select("stream_id", F.posexplode(F.regexp_extract_all("event", F.lit(r"(?m)^data: (.*)$"), F.lit(1))).alias("nth", "json"))
    return one.select("stream_id", "nth", F.from_json("json", schema).alias("e")).select("stream_id", "nth", "e.*")
