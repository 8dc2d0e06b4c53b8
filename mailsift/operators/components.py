"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift.session import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the least neighbour of ``a``. Minima are combined before the shuffle; a hub, whose edges fill a
    partition beyond Spark's skew threshold, is split by the join."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _mark(edges: DataFrame):
    """Count, sum and digest of an edge table: the same once nothing changes any more."""
    return edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("a", "b"))).head()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _with_least(edges)
    return hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        hung.where("b = m").select("a", "b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every node of (a, b); the component is its least node.

    Each step is written to the shared folder: a lost executor never rolls back the loop, and no plan grows
    with the rounds.
    """
    loose = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = loose.select(F.col("a").alias("id")).unionByName(loose.select(F.col("b").alias("id"))).distinct()
    now = written(loose.where("a <> b").distinct(), "links")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark["n"]:
            break
        now = written(_small_star(written(_large_star(now).distinct(), "large-star")), "small-star")
        seen, mark = mark, _mark(now)
        if seen == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
