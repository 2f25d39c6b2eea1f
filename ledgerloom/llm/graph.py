"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Links that one task relates at most; more are related in distributed steps.
ONE_TASK = 1 << 18
#: Rows that the task gives back at once.
ROWS = 1 << 14


def _related(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    low = np.arange(len(nodes))  # numbers stand in the order of nodes
    while (low[a] != low[b]).any():
        x, y = low[a], low[b]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots hang on smaller ones
        while (low[low] != low).any():
            low = low[low]
    return nodes, nodes[low]


def _in_one_task(batches):
    """(hi, lo) to (node, component)."""
    given = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    found = _related(*np.concatenate([np.empty((2, 0), np.int64), *given], axis=1))
    for i in range(0, len(found[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS]) for x in found], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `links` reaches.

    Up to ONE_TASK links are related by one task: each distributed step costs the driver a plan of some
    ten exchanges, whatever it moves, and Spark keeps a thread of each for a minute. More links
    alternate large-star and small-star steps (each a group-by minimum and a join back on the
    node, so no group is gathered) until nothing changes. Every step ends in a written table.
    Null ends and self-links say nothing and are left out; repeated links count once; no links
    give an empty table.
    """
    edges = written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if state == before or not state["n"]:
            break
        if state["n"] <= ONE_TASK:
            return edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
        before = state
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, edges = edges, written(moved.union(least.select("hi", "m")).distinct(), "edges")
        forget(old)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo")).distinct()
