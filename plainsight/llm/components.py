"""Distributed union-find over an edge table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import join_hot, save, small_components

#: Edges that one task contracts at most.
TASK = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.withColumn("m", F.least("a", "m"))
    return (join_hot(both.filter("b > a"), least, ["a"], 2 * rows, "n")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = join_hot(down, least, ["a"], rows, "n").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _contract(batches):
    """A spanning star of each component of the task's own edges: union-find in arrays."""
    found = [b for b in batches if b.num_rows]
    if found:
        table = pa.Table.from_batches(found)
        names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        root = small_components(len(names), at[:table.num_rows], at[table.num_rows:])
        tied = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[root[tied]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    First every ``TASK`` edges or fewer are contracted by union-find within a task; then alternating large-star
    and small-star steps, each written to the shared folder, join what tasks have found. Nodes are long
    integers. Loops and repeated edges are allowed, null ends are left out, an empty table gives an empty one. It ends when no node is
    tied to two others, or tied and a centre itself."""
    edges = save(edges.filter("a <> b").select("a", "b"), "edges")
    edges = save(edges.repartition(max(1, math.ceil(edges.count() / TASK))).mapInArrow(_contract, "a long, b long"), "edges")
    while True:
        rows = edges.count()
        roles = edges.select(F.col("a").alias("x"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(
            edges.select(F.col("b").alias("x"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
        if not rows or roles.groupBy("x").agg(F.sum("tied").alias("t"), F.max("centre").alias("c")).filter(
                "t > 1 or (t > 0 and c > 0)").isEmpty():
            break
        edges = save(_small_star(_large_star(edges, rows), rows), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
