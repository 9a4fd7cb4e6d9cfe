"""Blocks of vectors: the unit in which the vector searches index and probe.

A block holds up to ``rows`` vectors of one dimension as one binary row and
stays where it is: its index is built once for each block of queries. Queries
go to the blocks in chunks of bounded size, broadcast one after the other, so
what is moved is the input once and, for each block, k rows a query. No pair
of single rows is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop_stage, stage

BLOCK = "dim int, marks binary, ids binary, data binary"
#: Bytes of query vectors that are broadcast at once, about.
CHUNK = 32 << 20


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out are null ids, null and empty vectors and those with null, NaN or
    infinite components. Every other row takes part, also where rows share a
    vec_id: each is a candidate, and each a query if its id is one. Other
    columns are dropped.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """BLOCK rows: the vectors of each partition, ``rows`` at most (of one dimension) together."""

    def pack(batches):
        held: dict[int, list] = {}

        def out(dim):
            marks, ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for a in range(0, len(ids), rows):
                one = [[dim], [marks[a : a + rows].tobytes()], [ids[a : a + rows].tobytes()], [data[a : a + rows].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["dim", "marks", "ids", "data"])

        for b in batches:
            marks, ids, vector = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            dims = np.diff(vector.offsets.to_numpy())
            flat, ends = vector.flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if len(at) < len(dims) else flat.reshape(-1, dim)
                held.setdefault(dim, []).append((marks[at], ids[at], data))
                if sum(len(x[1]) for x in held[dim]) >= rows:
                    yield from out(dim)
        for dim in list(held):
            yield from out(dim)

    return vectors.select("mark", "vec_id", "vector").mapInArrow(pack, BLOCK)


def search(vectors: DataFrame, every: int, k: int, score_type: str, probe, index=lambda x: x, rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query.

    Queries are the rows whose vec_id ``every`` divides. ``index(data)`` is
    built for each block; ``probe(index, data, q)`` gives for one query vector
    candidate rows and their scores, the k+1 best among them (the query itself
    may be one). ``mark`` tells rows apart, so a query meets all rows but itself.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors.withColumn("mark", F.monotonically_increasing_id()), "vectors")
    parts = max(1, -(-vectors.count() // rows))
    # without a key: rows are dealt in turn, so blocks are full
    stored = stage(blocks(vectors.repartition(parts), rows), "vector-blocks").repartition(parts)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    size = asked.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    results = []
    for c in range(chunks):
        table = asked.where(F.pmod(F.xxhash64("mark"), F.lit(chunks)) == c).select("mark", "vec_id", "vector").toArrow()
        wanted: dict[int, list] = {}
        for mark, q, v in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_pylist()):
            wanted.setdefault(len(v), []).append((mark, q, np.array(v)))
        sent = spark.sparkContext.broadcast(wanted)

        def run(batches, sent=sent):
            for b in batches:
                for dim, marks, ids, data in zip(*(x.to_pylist() for x in b.columns)):
                    asks = sent.value.get(dim, [])
                    if not asks:
                        continue
                    marks, own = np.frombuffer(marks, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                    matrix = np.frombuffer(data, dtype=np.float64).reshape(-1, dim)
                    built, out = index(matrix), []
                    for mark, q, v in asks:
                        at, score = probe(built, matrix, v)
                        other = marks[at] != mark
                        at, score = at[other], score[other]
                        best = np.lexsort((own[at], -score))[:k]
                        out.append((np.full(len(best), mark), np.full(len(best), q), own[at][best], score[best]))
                    columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays(columns, ["mark", "query_id", "vec_id", "score"])

        found = stored.mapInArrow(run, f"mark long, query_id long, vec_id long, score {score_type}")
        order = Window.partitionBy("mark").orderBy(F.col("score").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(stage(best, "nearest"))
        sent.destroy()
    drop_stage(vectors)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
