"""Vector index folders: one for each embedding fingerprint, with a manifest."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import collection_name, fingerprint
from millrace.sources.tables import read_or_empty

MANIFEST = "name string, fingerprint string, provider string, model string, dim int, built_at timestamp"
#: Texts that a provider gets at once.
BATCH = 20


#: How often a provider is asked, and the first pause in seconds; each further one is twice as long.
ATTEMPTS, PAUSE = 4, 1.5
#: What goes before a text by what it is for; providers without it embed both alike.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}


class FingerprintMismatch(ValueError):
    pass


class Unavailable(Exception):
    """A provider that may answer later; ``after``: the pause in seconds that it asks for."""

    def __init__(self, why: str, after: float | None = None):
        super().__init__(why)
        self.after = after


def retried(provider, attempts: int = ATTEMPTS, pause: float = PAUSE, wait=time.sleep):
    """``provider`` asked again when it is :class:`Unavailable`, after a pause that doubles or that it names."""

    def ask(texts, dim):
        for n in range(attempts):
            try:
                return provider(texts, dim)
            except Unavailable as e:
                if n == attempts - 1:
                    raise RuntimeError(f"provider unavailable after {attempts} attempts: {e}") from e
                wait(e.after if e.after is not None else pause * 2**n)

    return ask


def prefixed(provider, purpose: str):
    """``provider`` for documents or queries: texts get the prefix of their purpose."""
    return lambda texts, dim: provider([PREFIXES[purpose] + t for t in texts], dim)


def hashed_words(texts: list[str], dim: int, prefix: str = "") -> np.ndarray:
    """The offline provider: signed hashed bags of words, of unit length."""
    import zlib

    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for w in (prefix + text).lower().split():
            h = zlib.crc32(w.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(chunks: DataFrame, dim: int, provider=hashed_words, batch: int = BATCH) -> DataFrame:
    """chunk_id, embedding of chunks(chunk_id, text), by Arrow batches; the provider's count is checked."""

    def run(batches):
        for b in batches:
            # a provider's texts at once are all that Python holds of a batch
            for i in range(0, b.num_rows, batch):
                some = b.slice(i, batch)
                part = [t or "" for t in some.column(1).to_pylist()]
                got = provider(part, dim)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.asarray(got).tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])

    return chunks.select(F.col("chunk_id").cast("string"), "text").mapInArrow(run, "chunk_id string, embedding array<double>")


def build(vectors: DataFrame, root: str, provider: str, model: str, dim: int, prefix: str = "chunks") -> str:
    """Write vectors of the right dimension and the manifest; the folder's path."""
    wrong = vectors.where(F.size("embedding") != dim).limit(1).count()
    if wrong:
        raise ValueError(f"vectors of another dimension than {dim}")
    mark = fingerprint(provider, model, dim)
    path = f"{root}/{collection_name(prefix, mark)}"
    spark = vectors.sparkSession
    fresh = f"{root}/.new-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{fresh}/vectors")
    row = spark.createDataFrame([(collection_name(prefix, mark), mark, provider, model, dim)], "name string, fingerprint string, provider string, model string, dim int")
    row.withColumn("built_at", F.current_timestamp()).coalesce(1).write.parquet(f"{fresh}/manifest")
    _swap(spark, fresh, path)
    return path


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a whole new folder in the place of the old one, which stays until then."""
    system, new = _files(spark, fresh)
    _, old = _files(spark, path)
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"can't move {fresh} to {path}")


def merged(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The index's vectors with those of ``new`` in the place of equal ids."""
    old = spark.read.parquet(f"{path}/vectors")
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def upsert(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Write :func:`merged` in the place of the index's vectors; its manifest stays."""
    fresh = f"{path}/.new-{uuid.uuid4().hex}"
    merged(spark, path, new).write.parquet(fresh)
    _swap(spark, fresh, f"{path}/vectors")


def load(spark: SparkSession, path: str, provider: str, model: str, dim: int) -> DataFrame:
    """The vectors, if the manifest has this fingerprint; else an error."""
    held = read_or_empty(spark, f"{path}/manifest", MANIFEST).select("fingerprint").head(1)
    mark = fingerprint(provider, model, dim)
    if not held:
        raise FingerprintMismatch("index without manifest")
    if held[0][0] != mark:
        raise FingerprintMismatch(f"index of {held[0][0]}, asked for {mark}")
    return spark.read.parquet(f"{path}/vectors")


def listed(spark: SparkSession, root: str, current: str | None = None) -> DataFrame:
    """name, fingerprint, chunks, current of the indexes under ``root``; fingerprint null without manifest."""
    system, at = _files(spark, root)
    names = sorted(x.getPath().getName() for x in system.listStatus(at) if x.isDirectory()) if system.exists(at) else []
    rows = []
    for name in names:
        if name.startswith("."):
            continue
        held = read_or_empty(spark, f"{root}/{name}/manifest", MANIFEST).select("fingerprint").head(1)
        rows.append((name, held[0][0] if held else None, spark.read.parquet(f"{root}/{name}/vectors").count(), name == current))
    return spark.createDataFrame(rows, "name string, fingerprint string, chunks long, current boolean")


def verified(spark: SparkSession, root: str, provider: str, model: str, dim: int, prefix: str = "chunks") -> str:
    """"ok", or why the index for this provider can't be used: missing, mismatch, empty."""
    path = f"{root}/{collection_name(prefix, fingerprint(provider, model, dim))}"
    system, at = _files(spark, path)
    if not system.exists(at):
        return "missing"
    try:
        return "ok" if load(spark, path, provider, model, dim).head(1) else "empty"
    except FingerprintMismatch:
        return "mismatch"


def prune(spark: SparkSession, root: str, current: str) -> list[str]:
    """Delete all indexes but the current one; their names."""
    gone = [r["name"] for r in listed(spark, root, current).where("not current").select("name").collect()]  # a name for each index
    for name in gone:
        system, at = _files(spark, f"{root}/{name}")
        system.delete(at, True)
    return sorted(gone)


def stale(names: DataFrame, current: DataFrame) -> DataFrame:
    """Names of indexes that are not current."""
    return names.select("name").subtract(current.select("name"))
