"""Connected components of an edge table that is never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .runtime import cut, forget, in_few

#: Edges that a task gathers before it makes stars of them and of the stars it has.
GATHER = 1 << 20


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) from every other node of each component of the edges (u, v) to its smallest node."""
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, n = [np.zeros((2, 0), np.int64)], 0
    for batch in batches:
        kept.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        n += batch.num_rows
        if n >= GATHER:
            kept, n = [np.stack(contracted(*np.concatenate(kept, axis=1)))], 0
    u, v = contracted(*np.concatenate(kept, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not the smallest reachable; root is that smallest node.

    In every round each task makes stars of its edges before and after they are dealt by their greater node,
    so all smaller neighbours of a node meet, and a node comes from each task once, however many edges it has.
    Then edges to a node that has a smaller neighbour itself lead to the smallest of these. That is one
    aggregation with map-side combining and one join, which Spark can split where it is skewed. It ends when
    every node has one edge and none leads to a node that has one. Each round is cut off in the shared folder.
    """
    ship(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        now = cut(now.mapInArrow(_contracted, "u bigint, v bigint").repartition("u").mapInArrow(_contracted, "u bigint, v bigint"))
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        n, more = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up = 1 and least = 0"))).first()
        now = in_few(now, n or 0)
        if not more:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        now = now.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        del ends, low
        forget(edges.sparkSession)
