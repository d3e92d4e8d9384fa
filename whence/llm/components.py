"""Connected components of an edge list, in Spark: alternating large-star and small-star steps over tables.

Minima are aggregated map-side and joined back, so the hub of a star with any number of leaves is never one task's list. Each round is
written to the shared folder, which cuts lineage; rounds end when every edge leads straight to a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. Each node's neighbours are linked to the least of the node and its neighbours."""
    if large:  # neighbours above a node move to its minimum
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        moved = edges.select(F.col("v").alias("n"), F.col("u").alias("x")).join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
        return moved.filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    moved = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: no node has two edges, none that edges lead to has one of its own."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.unionByName(chained).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node of an edge, and the least node of its component."""
    now = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    while not _settled(now):
        now = keep(_stars(_stars(now, True), False), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_further(roots: DataFrame, more: DataFrame, a: str, b: str) -> DataFrame:
    """The output of `components` once `more` edges are added."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    moved = more.join(of(a), a, "left").join(of(b), b, "left").select(F.coalesce(f"root_{a}", a).alias("a"), F.coalesce(f"root_{b}", b).alias("b"))
    tops = components(moved, "a", "b").withColumnRenamed("node", "old").withColumnRenamed("root", "top")
    known = roots.unionByName(tops.select(F.col("old").alias("node"), F.col("old").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return known.join(tops, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))
