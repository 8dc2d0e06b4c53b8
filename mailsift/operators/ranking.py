"""Ranks, running totals and exact quantiles without sending a group through one task.

A plain window over a label, or over nothing, sorts its whole group in one task. Here rows fall
into ordered buckets first (equal hash ranges, or ranges between approximate percentiles of the
distinct values). Per-bucket totals are small and give each bucket its offset; sorting happens
inside buckets only. The bucket borders steer the balance, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.functions import seeded
from mailsift.session import written


def range_levels(df: DataFrame) -> int:
    """Borders are 2**levels - 1: about twice the shuffle partitions, so the sorts spread evenly."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, math.ceil(math.log2(2 * partitions)))


def with_value_bucket(df: DataFrame, value: str, levels: int | None = None) -> DataFrame:
    """``_bucket`` grows with ``value``; borders are percentiles of the values at hand.

    The bucket is the number of borders below the value, found by halving: one step per level,
    each a plain projection inside the same generated stage. Approximate percentiles depend on the order in which
    tasks finish, so the borders are stored: whatever reads the result, in one plan or in several, sees the same buckets.
    """
    levels = levels or range_levels(df)
    ranges = 2 ** levels
    borders = df.agg(
        F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), ranges * 4)
        .alias("b")
    )
    out = df.withColumns({"_borders": written(borders, "borders").scalar(), "_bucket": F.lit(0)})
    for level in reversed(range(levels)):
        step = 2 ** level
        below = F.get("_borders", F.col("_bucket") + (step - 1)) < F.col(value)
        out = out.withColumn("_bucket", F.when(below, F.col("_bucket") + step).otherwise(F.col("_bucket")))
    return out.drop("_borders")


def with_hash_bucket(df: DataFrame, digest: str) -> DataFrame:
    """Equal ranges of the digest's leading bits, in its order: 4096, or 16 for each shuffle partition if that is more."""
    buckets = max(4096, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead = F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint")
    return df.withColumn("_bucket", F.shiftright(lead * F.lit(min(buckets, 1 << 22)), 40).cast("int"))


def running_totals(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
                   descending: bool = False) -> DataFrame:
    """``cum_<c>`` for every summed column, up to and including the row, in order of ``value``.

    ``value`` must be unique within ``by`` (aggregate first). Also adds ``total_<c>``.
    """
    by = by or []
    rows = with_value_bucket(df, value)
    direction = F.desc if descending else F.asc
    per_bucket = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(direction(value)).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*by, "_bucket"])
        .withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(inside) for c in sums})
        .drop("_bucket", *[f"_o_{c}" for c in sums])
    )


def order_statistics(rows: DataFrame, value: str, weight: str, ranks: dict[str, Column],
                     by: list[str] | None = None) -> DataFrame:
    """Values at given 1-based ranks, per group, exactly. ``rows`` carry ``_bucket``.

    ``ranks`` maps an output name to an expression over ``n`` (total weight of the group); ranks
    of 0 or less give null. Only rows of the buckets that hold a wanted rank are sorted.
    """
    by = by or []
    per_bucket = rows.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_bucket")
    cum = per_bucket.select(
        *by, "_bucket", "_c",
        (F.sum("_c").over(upto) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("n"),
    )
    wanted = F.array(*[
        F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()
    ])
    targets = cum.select("*", F.explode(wanted).alias("t")).where(
        (F.col("t.rank") > F.col("_before")) & (F.col("t.rank") <= F.col("_before") + F.col("_c"))
    )
    hit = targets.groupBy(*by, "_bucket", "_before", "n").agg(F.collect_list("t").alias("_ts"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    ranked = rows.join(hit, [*by, "_bucket"]).withColumn(
        "_hi", F.col("_before") + F.sum(weight).over(inside)
    )
    picked = ranked.select(*by, "n", value, "_hi", (F.col("_hi") - F.col(weight)).alias("_lo"),
                           F.explode("_ts").alias("t")).where(
        (F.col("t.rank") > F.col("_lo")) & (F.col("t.rank") <= F.col("_hi"))
    )
    return picked.groupBy(*by, "n").agg(*[
        F.max(F.when(F.col("t.name") == k, F.col(value))).alias(k) for k in ranks
    ])


def exact_quantiles(df: DataFrame, value: str, fractions: dict[str, float],
                    by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles, per group. Equal values are counted before any shuffle."""
    by = by or []
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_w"))
    )
    ranks: dict[str, Column] = {}
    for name, q in fractions.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        ranks[f"_lo_{name}"] = F.floor(at) + 1
        ranks[f"_hi_{name}"] = F.ceil(at) + 1
    stats = order_statistics(with_value_bucket(counts, value), value, "_w", ranks, by)
    out = []
    for name, q in fractions.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return stats.select(*by, "n", *out)


def random_cuts(df: DataFrame, key: str, seed: str, upto: dict[str, Column], by: list[str]) -> DataFrame:
    """Per group, the digest at given ranks of the seeded random order: a row has rank <= r
    exactly if its digest <= the cut. Rows themselves are never moved."""
    rows = df.select(*by, seeded.digest(seed, F.col(key)).alias("_d")).withColumn("_w", F.lit(1))
    return order_statistics(with_hash_bucket(rows, "_d"), "_d", "_w", upto, by)


def random_rank(df: DataFrame, key: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """``rank`` (1-based) of each row in the seeded random order, and the group size ``n``."""
    by = by or []
    rows = with_hash_bucket(df.withColumn("_d", seeded.digest(seed, F.col(key))), "_d")
    per_bucket = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"),
        F.sum("_c").over(Window.partitionBy(*by)).alias("n"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_d", key)
    return (
        rows.join(offsets, [*by, "_bucket"])
        .withColumn("rank", F.col("_o") + F.row_number().over(inside))
        .drop("_d", "_bucket", "_o")
    )
