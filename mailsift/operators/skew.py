"""Joins on keys of which a few may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than one row in HOT_SHARE. By counting, at most HOT_SHARE keys can.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Keys that hold more than one row in HOT_SHARE: at most HOT_SHARE of them, however large the table."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * HOT_SHARE > total).select(key)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``rows`` left joined to ``facts`` (one row a key at most).

    Without ``hot`` it is one join: facts that Spark measures as small are broadcast, and where a key fills a shuffle
    partition beyond the skew threshold, Spark deals its rows out over more tasks. With ``hot``, at most HOT_SHARE keys, the
    facts of these are broadcast, and only the other rows are shuffled.
    """
    if hot is None:
        return rows.join(facts, key, "left")
    mark = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    marked = rows.join(mark, key, "left")
    told = facts.join(mark, key, "left")
    cold = marked.where("_hot IS NULL").drop("_hot").join(told.where("_hot IS NULL").drop("_hot"), key, "left")
    warm = marked.where("_hot").drop("_hot").join(F.broadcast(told.where("_hot").drop("_hot")), key, "left")
    return cold.unionByName(warm)
