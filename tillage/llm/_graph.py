"""Connected components on DataFrames: contraction with pointer jumping, every round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.llm._common import discard, stored


def _follow(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) with every node's pointer followed to the end, and the stored table that it reads; pointers
    only lead to smaller nodes."""
    held = parents
    while True:
        ups = parents.select(F.col("node").alias("_up"), F.col("root").alias("_top"))
        ahead = stored(parents.join(ups, F.col("root") == F.col("_up"), "left").select("node", F.coalesce("_top", "root").alias("next"), "root"), "jump")
        moved = ahead.where("next <> root").limit(1).count()
        discard(held)
        held, parents = ahead, ahead.select("node", F.col("next").alias("root"))
        if not moved:
            return parents, held


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, and the smallest node reachable from it.

    Each round every node points to its smallest neighbour if that is smaller, pointers are followed
    to their ends and edges are redrawn between the ends; at least half of the nodes with edges go,
    so the rounds grow with the logarithm of the nodes. Minima are aggregated before the shuffle, so
    a node of any degree is safe. Loops, repeated edges and nulls do no harm.
    """
    left = stored(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "edges")
    labels = None
    while True:
        near = left.select("u", "v").union(left.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.min("v").alias("v"))
        roots, held = _follow(stored(near.select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "near"))
        if labels is None:
            labels = roots
            first = held
        else:
            ups = roots.select(F.col("node").alias("_up"), F.col("root").alias("_top"))
            joined = stored(labels.join(ups, F.col("root") == F.col("_up"), "left").select("node", F.coalesce("_top", "root").alias("root")), "labels")
            discard(first, labels)
            labels = first = joined
        of = lambda c, n: roots.select(F.col("node").alias(n), F.col("root").alias(c))
        drawn = left.join(of("ru", "nu"), F.col("u") == F.col("nu")).join(of("rv", "nv"), F.col("v") == F.col("nv"))
        before, left = left, stored(drawn.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        discard(before)
        if held is not first:
            discard(held)
        if left.isEmpty():
            discard(left)
            return labels
