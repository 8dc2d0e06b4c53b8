"""Profiles of a table: null counts, class balance, means, correlations, histograms, top-k.

Aggregates combine on the map side, so a class that holds most rows costs one partial row per
partition. Windows are used over aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mailsift.operators.ranking import exact_quantiles
from mailsift.operators.skew import join_facts


def long_form(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature",
              value: str = "value") -> DataFrame:
    """One row per key row and column, values as doubles."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, name, value)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count per column, most first; one pass, then a row turned into rows."""
    columns = columns or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "missing").orderBy(F.desc("missing"), "column_name")


def null_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Null counts of two tables aligned on the column name; a missing column gives null."""
    b = null_profile(before).withColumnRenamed("missing", "before_cleaning")
    a = null_profile(after).withColumnRenamed("missing", "after_cleaning")
    return b.join(a, "column_name", "full_outer")


def table_overview(df: DataFrame) -> DataFrame:
    """Row count, column position, name, type and non-null count."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_rows"))
    kinds = F.create_map(*[
        x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))
    ])
    places = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i + 1))])
    out = row.unpivot(["_rows"], df.columns, "column_name", "non_null")
    return out.select(
        "column_name", places[F.col("column_name")].alias("position"),
        kinds[F.col("column_name")].alias("type"), "non_null",
        F.col("_rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
    )


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def with_share(counts: DataFrame, within: list[str] | None = None, n: str = "n",
               share: str = "share", scale: float = 1.0) -> DataFrame:
    """Share of each counted row in its group (or in all counted rows)."""
    total = F.sum(n).over(Window.partitionBy(*(within or [])))
    return counts.withColumn(share, F.col(n) * F.lit(scale) / total)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return value_counts(df, label).orderBy(F.desc("n"), label)


def label_pct(df: DataFrame, label: str = "label") -> DataFrame:
    return with_share(value_counts(df, label), share="pct", scale=100.0)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return value_counts(df.where(F.col(label).isNotNull()), label).agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"),
        (F.min("n") / F.max("n")).alias("ratio"),
    )


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """Distinct values per column: exact, one column at a time, or sketched in one pass."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.unpivot([], list(columns), "column_name", "n_distinct")
    out = None
    for c in columns:
        one = (
            df.select(c).where(F.col(c).isNotNull()).distinct()
            .agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_distinct"))
        )
        out = one if out is None else out.unionByName(one)
    return out


#: Binary logarithm of a sketch's registers; the relative standard error of its counts is about 1.04 / sqrt(2 ** SKETCH_SIZE).
SKETCH_SIZE = 12


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(by, column_name, sketch): a mergeable sketch of the distinct values of each column in each group.

    One row of a few kilobytes a group, say a day of an organisation, however many rows it has: the table is written once and
    counts over any range are merged from it without another look at the mails. Nulls do not count.
    """
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(*by, values).where("value IS NOT NULL").groupBy(*by, "column_name").agg(
        F.hll_sketch_agg("value", size).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, column_name, n_distinct) from the sketches of any groups, as if their rows had been counted together."""
    return sketches.groupBy(*(by or []), "column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def feature_overview(df: DataFrame) -> DataFrame:
    """Overall means, sums and shares reported after feature engineering."""
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return df.agg(
        F.avg("subject_length").alias("avg_subject_length"),
        F.sum("subject_has_re_fwd").alias("n_re_fwd"),
        share("subject_has_re_fwd").alias("share_re_fwd"),
        F.avg("body_length").alias("avg_body_length"),
        F.avg("body_num_exclaim").alias("avg_exclaim"),
        F.sum("contains_html").alias("n_html"), share("contains_html").alias("share_html"),
        F.avg("num_urls").alias("avg_urls"),
        F.sum("has_suspicious_url").alias("n_suspicious"),
        share("has_suspicious_url").alias("share_suspicious"),
        F.sum("is_weekend").alias("n_weekend"), share("is_weekend").alias("share_weekend"),
        F.count_if(F.col("urgency_score") > 0).alias("n_urgent"),
        F.count_if(F.col("financial_score") > 0).alias("n_financial"),
    )


def means_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def sums_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])


def feature_summary(df: DataFrame, columns: list[str], by: str = "label") -> DataFrame:
    """Mean, sample deviation, least and greatest per feature and class, in long form.

    One wide aggregate per class, turned into rows afterwards; rows are never multiplied by the
    number of features.
    """
    wide = df.groupBy(by).agg(*[
        F.struct(
            F.avg(c).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c) for c in columns
    ])
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns
    ])).alias("e")
    return wide.select(by, entries).select(by, "e.feature", "e.s.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, null for a constant column.

    All sums come from one pass over one scan. Rows with a null in either column are left out of
    that pair, as pairwise-complete correlation wants; columns that cannot be null share their
    deviations between pairs.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    nullable = {f.name for f in df.schema if f.nullable}

    def one(a: str, b: str) -> Column:
        xa, xb = F.col(a), F.col(b)
        if a != b and (a in nullable or b in nullable):
            both = xa.isNotNull() & xb.isNotNull()
            xa, xb = F.when(both, xa), F.when(both, xb)
        return F.try_divide(F.covar_samp(xa, xb), F.stddev_samp(xa) * F.stddev_samp(xb))

    row = df.agg(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), one(a, b).alias("r")) for a, b in pairs
    ]).alias("rs"))
    half = row.select(F.explode("rs").alias("e")).select("e.x", "e.y", "e.r")
    return half.unionByName(half.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))


def weekend_crosstab(df: DataFrame, label: str = "label") -> DataFrame:
    return with_share(value_counts(df, "is_weekend", label), [label], share="pct", scale=100.0)


def crosstab_with_margins(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Counts per pair plus margins (null marks a margin). The cube runs over counted pairs."""
    counted = value_counts(df, rows, cols)
    return counted.cube(rows, cols).agg(F.sum("n").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def _by_class(rows: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Rows with the facts of their class; a class that holds many rows is not gathered for it."""
    return join_facts(rows, facts.withColumn("_told", F.lit(True)), by).where("_told").drop("_told")


def boxplot(df: DataFrame, value: str, by: str = "label") -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 spreads of the box) and outlier counts.

    Works on counted values; the quartile table has one row per class.
    """
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by]).withColumns({
        "low_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "high_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })
    counted = value_counts(df.where(F.col(value).isNotNull()), by, value, name="w")
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return _by_class(counted, quartiles, by).groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).cast("double").alias("low_whisker"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("high_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("w"))), F.lit(0)).alias("n_outliers"),
    )


def outliers(df: DataFrame, value: str, by: str = "label", key: str = "email_id") -> DataFrame:
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75}, [by])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return (
        _by_class(df.select(key, by, value), q, by)
        .where((F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread))
        .select(key, by, value)
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int,
              by: list[str] | None = None) -> DataFrame:
    """Equal bins over [low, high]; the top border belongs to the last bin. Bins start at 1."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins)).cast("int")
    inside = F.col(value).between(low, high)
    return df.where(inside).groupBy(*(by or []), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def feature_histogram(df: DataFrame, value: str, by: str, bins: int) -> DataFrame:
    """Bins between the least and the greatest value of the table, counted per class."""
    counted = value_counts(df.where(F.col(value).isNotNull()), by, value, name="w")
    ends = counted.agg(F.struct(
        F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).alias("e"))
    spread = F.col("_e.hi") - F.col("_e.lo")
    place = F.when(spread == 0, 1).otherwise(
        F.least(F.floor((F.col(value) - F.col("_e.lo")) * bins / F.nullif(spread, F.lit(0.0))) + 1, F.lit(bins))
    ).cast("int")
    return (
        counted.withColumn("_e", ends.scalar())
        .groupBy(by, place.alias("bin")).agg(F.sum("w").alias("n"))
    )


def scatter(df: DataFrame, x: str, y: str, by: str = "label") -> DataFrame:
    """Every point of the table, equal points counted once."""
    return value_counts(df, x, y, by)


def hour_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return value_counts(df, label, "hour").orderBy(label, "hour")


def cluster_profile(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def cluster_top_features(df: DataFrame, columns: list[str], cluster: str = "cluster", least: float = 0.5,
                         top: int = 5, by_size: bool = False) -> DataFrame:
    """Features whose cluster mean lies more than ``least`` deviations off the overall mean.

    Both aggregates are wide and small; only their rows are unpivoted and ranked. Signed order
    puts strong negatives last; ``by_size`` ranks by distance instead.
    """
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])
    overall = df.agg(F.array(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"))
        for c in columns
    ]).alias("g"))
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"), F.lit(i).alias("i"))
        for i, c in enumerate(columns)
    ])).alias("e")
    rows = means.withColumn("_g", overall.scalar()).select(
        cluster, "_g", entries).select(
        cluster, "e.feature", "e.mean", F.get("_g", F.col("e.i")).alias("s"))
    std = F.when(F.col("s.std") == 0, 1e-6).otherwise(F.col("s.std"))
    z = (F.col("mean") - F.col("s.mean")) / std
    order = F.desc(F.abs("z")) if by_size else F.desc("z")
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(order, "feature"))
    return (
        rows.withColumn("z", z).where(F.abs("z") > least).withColumn("rank", rank)
        .where(F.col("rank") <= top)
        .select(cluster, "rank", "feature", "z",
                F.when(F.col("z") > 0, "Higher").otherwise("Lower").alias("direction"))
    )


def noise_share(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    noise = F.count_if(F.col(cluster) == -1)
    return df.agg(
        noise.alias("n_noise"), (noise * 100.0 / F.count(F.lit(1))).alias("pct_noise"),
        F.countDistinct(F.when(F.col(cluster) >= 0, F.col(cluster))).alias("n_clusters"),
    )


def cumulative_variance(variances: DataFrame, k: str = "k", share: str = "share") -> DataFrame:
    """Running sum over components: as many rows as features."""
    upto = Window.orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    return variances.withColumn("cumulative", F.sum(share).over(upto))


def rank_by(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Result rows (models, algorithms, cluster counts), best first; the first listed wins ties."""
    order = Window.orderBy(F.desc_nulls_last(metric), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(order))


def best_by(df: DataFrame, metric: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), F.asc(tie)).limit(1)
