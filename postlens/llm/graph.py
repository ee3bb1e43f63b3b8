"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.shared import Scratch, by_value

by_value(__name__)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(links: DataFrame) -> DataFrame:
    """A spanning forest of the links of each batch of a task: as connected, but no more rows than nodes."""
    first, second = links.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            nodes, at = np.unique(both, return_inverse=True)
            root = roots(len(nodes), at[: batch.num_rows], at[batch.num_rows :])
            rest = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], names=[first, second])

    return links.mapInArrow(task, f"{first} long, {second} long")


def _large(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    hung = both.join(least, "node").where("other > node")
    return hung.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of those."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    `links` has two long columns, in any order and with repeats; nulls and loops are ignored. Each round is
    written to the shared folder and needs one pass of aggregation, so a hub costs no more than its links."""
    a, b = (F.col(c) for c in links.columns)
    edges = links.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    edges = scratch.keep(edges, "edges-0")
    state, turn = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state, turn = mark, turn + 1
        edges = scratch.keep(_small(_large(edges)), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
