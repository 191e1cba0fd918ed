"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidy


def _state(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's greater neighbours to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its lesser neighbours to the least of them (a > b in every edge)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node that has an edge.

    ``edges`` has two bigint columns ``a`` and ``b``; null ends and loops are ignored, repeated
    and reversed edges count once, an empty table gives an empty one. Each round is written to
    the shared folder; only two numbers a round reach the driver. A hub's rows meet its least
    neighbour in a plain equi-join, whose large partitions adaptive execution splits.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        then = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now, before, state = then, state, _state(then)
        tidy(now.sparkSession)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def stars(parts: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of ``parts`` (node, component): one from each node to its least.
    They stand for the edges that gave ``parts`` in a search over more edges."""
    return parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
