"""Connected components of a distributed edge list by alternating star steps.

Each round makes two passes over the edges: a *large-star* pass hangs every
larger neighbour of a node on the node's smallest neighbour, a *small-star* pass
does the same with the smaller neighbours. The forest of stars that remains when
a round changes nothing names each component by its smallest node. Every pass is
one map-side-combined minimum per node and one equi-join; minima are written
before the join, so that both join sides are plain shuffles and adaptive
execution can split a hub's partition. Nothing is collected but a row count and
a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored


def _hang(edges: DataFrame, name: str) -> DataFrame:
    """Neighbours ``b`` of each ``a`` with the least of ``a`` and its neighbours."""
    least = stored(
        edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-least")
    return edges.join(least.hint("shuffle_merge"), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hung = _hang(both, "large").where("b > a")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _hang(edges, "small")
    moved = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(hung.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)`` (longs).

    ``component`` is the smallest node reachable, the node itself included.
    Self-links, repeated edges, either direction and nulls are accepted: a row
    with a null end or two equal ends is no link.
    """
    now = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-edges")
    before = _mark(now)
    while before[0]:
        now = stored(_small_star(stored(_large_star(now), f"{name}-large")), f"{name}-small")
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
