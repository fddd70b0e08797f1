"""Connected components of an edge table: large stars, and contraction of the edges of each partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import checkpointed

#: Edges of a task, and shuffle partitions whose shrunk edges make one file.
EDGES, FILES = 1 << 19, 16
EDGE = "u long, v long"


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and edges between a and b the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        low = np.minimum(x, y)[apart]
        np.minimum.at(label, x[apart], low)
        np.minimum.at(label, y[apart], low)
        while (label[label] != label).any():
            label = label[label]


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: every node with the smallest node that the partition's edges tie it to."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if held:
        edges = np.concatenate(held, axis=1)
        nodes, place = np.unique(edges.reshape(-1), return_inverse=True)
        a, b = place.reshape(2, -1)
        root = smallest_labels(a, b, len(nodes))
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v) but the roots themselves; a root is its component's smallest node.

    Edges first shrink to stars in a few tasks (after a shuffle, so that no stage holds two Python workers a core). What is left is
    dealt out by u, so many edges to a task, and each task's edges shrink again, which ties all smaller neighbours of a
    node together; a single task's worth is done with that. Else a large star leads every u to the smallest neighbour of its v instead, and so on until nothing changes, after about
    log(n) rounds, mostly one or two. The caller's edges must give a node few smaller neighbours (here one per
    signature), as rounds don't add any; a node may have any number of larger ones: they meet its one minimum in a join on
    a key that both sides are dealt out by anew, so that Spark can split them.
    """
    dealt = -(-int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FILES)
    first = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = checkpointed(first.repartition(dealt).mapInArrow(contracted, EDGE))
    tasks = -(-e.count() // EDGES)
    if tasks <= 1:
        done = checkpointed(e.coalesce(1).mapInArrow(contracted, EDGE))
        return done.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def shrunk(df: DataFrame) -> DataFrame:
        return checkpointed(df.where("u != v").repartition(tasks, "u").mapInArrow(contracted, EDGE))

    e = shrunk(e)
    before = None
    while (now := _state(e)) != before and now[0]:
        before = now
        least = e.groupBy("u").agg(F.min("v").alias("m")).select((-F.col("u")).alias("key"), "m")
        moved = e.withColumn("key", -F.col("v")).join(least, "key", "left")
        e = shrunk(moved.select("u", F.coalesce("m", "v").alias("v")))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
