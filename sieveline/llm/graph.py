"""Connected components by hooking and contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, label) of every end of an edge (a, b): label is the smallest id of its component.

    Each round every node takes its smallest neighbour as parent, parents are followed twice, and edges are drawn
    between the parents; a round at least halves paths, so rounds grow with the logarithm of the longest one. A hot
    node is only ever aggregated with min() before the shuffle or joined, where skewed partitions split.
    """
    e = scratch.save(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    labels = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    k = 0
    while not e.isEmpty():
        hook = e.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p"))
        up = hook.select(F.col("x").alias("x2"), F.col("p").alias("p2"))
        parent = scratch.save(hook.join(up, hook.p == up.x2, "left").select("x", F.coalesce("p2", "p").alias("p")), f"{name}-p{k}")
        pa, pb = parent.select(F.col("x").alias("xa"), F.col("p").alias("p_a")), parent.select(F.col("x").alias("xb"), F.col("p").alias("p_b"))
        moved = e.join(pa, e.a == pa.xa, "left").select(F.coalesce("p_a", "a").alias("a"), "b").join(pb, F.col("b") == F.col("xb"), "left").select("a", F.coalesce("p_b", "b").alias("b"))
        nxt = scratch.save(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e{k + 1}")
        labels = scratch.save(labels.join(parent, labels.label == parent.x, "left").select("id", F.coalesce("p", "label").alias("label")), f"{name}-l{k}")
        for gone in [f"{name}-e{k}", f"{name}-p{k}"] + ([f"{name}-l{k - 1}"] if k else []):
            scratch.drop(gone)
        e, k = nxt, k + 1
    return labels if k else scratch.save(labels, f"{name}-l")
