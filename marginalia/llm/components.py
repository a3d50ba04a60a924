"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import join_facts, materialise

#: Neighbours of a node, some bytes each, that one task holds together; the rows of a larger star's centre are split.
WHOLE = 1 << 16


def components(edges: DataFrame, rounds: int = 60, whole: int = WHOLE) -> DataFrame:
    """``node, component``: the smallest node that ``a, b`` edges reach, for every node that has an edge.

    Alternating large-star and small-star steps: each step hangs nodes on the smallest neighbour seen, the number of
    edges never grows, and a few rounds reach a forest of stars. Each round is a written table, so lineage stays short
    and a lost executor costs one round. Where no node has more than ``whole`` neighbours, which is sure of no more edges
    than that, a round is three shuffles; else the rows of a large star's centre are split, by joins and broadcasts,
    and every stage of those takes the driver's memory. At most three numbers a round come to the driver. Self-loops and nulls are
    ignored.
    """
    now = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    now = materialise(now, "edges")
    seen, size = None, now.count()
    for _ in range(rounds):
        split = size > whole and _both(now).groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] > whole
        now = materialise(_small_star(_large_star(now, size), size) if split else _stars(now), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen, size = tuple(mark), mark[0]
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    # a star forest: b is the centre of a, and no centre hangs on another node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def _stars(edges: DataFrame) -> DataFrame:
    """The large and the small star of nodes whose neighbours fit a task: what the two functions below give.

    The large star gives a node no more smaller neighbours than it had, so both stars are bounded alike.
    """
    met = lambda rows: rows.groupBy("a").agg(F.collect_set("b").alias("all")).select("a", "all", F.array_min("all").alias("m"))
    large = met(_both(edges)).select(F.explode(F.filter("all", lambda b: b > F.col("a"))).alias("a"), F.least("a", "m").alias("b"))
    hung = F.array_append(F.filter("all", lambda b: b != F.col("m")), F.col("a"))
    return met(large).select(F.explode(hung).alias("a"), F.col("m").alias("b")).distinct()


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, itself included."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = join_facts(both.where(F.col("b") > F.col("a")), least, ["a"], 2 * size)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = join_facts(down, least, ["a"], size).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()
