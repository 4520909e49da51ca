"""Connected components of an edge table by alternating large-star and small-star steps.

Each round begins with what can be joined without moving a row: the edges of each partition are contracted to stars
(one pass of numpy), so a hub is one row a partition before anything is shuffled.  A star step is a partially aggregated
minimum per vertex and a join back; every round is written to the shared folder, which cuts the lineage, and the round
before it is deleted.  The rounds grow with the logarithm of the longest chain that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import durable, forget, ship


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the graph with the edges a - b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        u, v = (np.concatenate((x, b.column(k).to_numpy(zero_copy_only=False))) for x, k in ((u, "u"), (v, "v")))
        if len(u) > 4_000_000:  # contract early, so that a partition holds its vertices and not its edges
            u, v = contracted(u, v)
    u, v = contracted(u, v)
    keep = u != v
    for at in range(0, int(keep.sum()), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(x[keep][at : at + (1 << 17)]) for x in (u, v)], names=["u", "v"])


#: Rows of a task, and tasks at least, once the number of rows is known.
TASK_ROWS, LEAST_TASKS = 1 << 16, 12


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """``pairs`` (u, v): each u hands its least neighbour to the larger (large star) or to all of the given ones."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    told = pairs.join(least, "u")
    if large:
        return told.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint, none null) to (node, component): the least reachable node, for nodes with an edge to another."""
    ship(edges.sparkSession)
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        e = durable(pairs.mapInArrow(_local, "u bigint, v bigint").distinct(), "stars", batch_rows=1 << 16)
        if before is not None:
            forget(before)
        # stars of different partitions are all one when no node has two centres and no centre is a node
        centres = e.groupBy("v").agg(F.lit(True).alias("centre")).withColumnRenamed("v", "u")
        nodes = e.groupBy("u").agg(F.count("*").alias("n"))
        if nodes.filter("n > 1").unionByName(nodes.join(centres, "u", "left_semi")).isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # no round makes more rows than twice the last one's, so few rows are few tasks
        pairs, before = _star(_star(both, True).distinct(), False).coalesce(max(LEAST_TASKS, -(-e.count() // TASK_ROWS))), e
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    made = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    made._durable_path = e._durable_path  # whoever has written the result may forget it
    return made
