"""Connected components of a link table, without gathering links anywhere.

Each round first contracts the links of every partition with a union-find (as
much memory as the partition has links) and then applies large-star and
small-star steps (Kiveris et al., 2014), whose minima are pre-aggregated. A hub
is a key of joins only, which Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_stage, stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find: (node, smallest node of its component) for all but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    other = roots != np.arange(len(nodes))
    return nodes[other], nodes[roots[other]]


def _contract(links: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, least = forest(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its
    smallest node. Self-links and repeated links do no harm. Links that have not
    settled after ``rounds`` are an error."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = stage(_contract(edges), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(down, F.col("u") == F.col("w"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v")))
        new = stage(_contract(small.distinct()), "links")
        drop_stage(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    )
