"""Cleaning: duplicates, fills, dates, trimming, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from mailsift import fixed
from mailsift.functions import dates, text, urls


def drop_exact_duplicates(df: DataFrame, key: str = "email_id") -> DataFrame:
    """One row per distinct payload, with the lowest key. Nulls compare equal.

    A hot group of copies shrinks to one row per input partition before the shuffle.
    """
    payload = [c for c in df.columns if c != key]
    return df.groupBy(*payload).agg(F.min(key).alias(key)).select(*df.columns)


def duplicate_count(df: DataFrame, key: str = "email_id") -> DataFrame:
    payload = [c for c in df.columns if c != key]
    return (
        df.groupBy(*payload).agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.sum("copies").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
    )


def fill_receiver(df: DataFrame) -> DataFrame:
    return df.withColumn("receiver", F.coalesce("receiver", F.lit(fixed.UNKNOWN)))


def fill_links(df: DataFrame) -> DataFrame:
    """Given links, else those found in the body, else ``none``."""
    found = urls.joined(F.col("body"))
    given = [F.col("links")] if "links" in df.columns else []
    return df.withColumn("links", F.coalesce(*given, found, F.lit(fixed.NO_LINKS)))


def parse_dates(df: DataFrame, column: str = "date") -> DataFrame:
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, dates.parse_utc(F.col(column)))
    return df


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent non-null value, the lowest one on ties; one row or none.

    Counts are combined before the shuffle and no task ever holds all distinct values.
    """
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column)).limit(1).select(column)
    )


def fill_date_with_mode(df: DataFrame, column: str = "date") -> DataFrame:
    """The mode is a scalar subquery: computed once, then a plain projection."""
    kind = df.schema[column].dataType
    default = F.lit(fixed.DEFAULT_DATE).cast(kind)
    return df.withColumn(column, F.coalesce(F.col(column), most_frequent(df, column).scalar(), default))


def add_date_parts(df: DataFrame, column: str = "date") -> DataFrame:
    return df.withColumns(dates.parts(F.col(column)))


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[
        text.strip(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema
    ])


def label_last(df: DataFrame, label: str = "label") -> DataFrame:
    if label not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != label], label)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("label", "email_id")) -> list[str]:
    """Numeric feature names, without anything called a hash."""
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude and "hash" not in f.name.lower()
    ]


def choose_features(df: DataFrame, wanted: list[str], least: int = 2) -> list[str]:
    present = [c for c in wanted if c in df.columns]
    if len(present) < least:
        raise ValueError(f"at least {least} features are needed, got {present}")
    return present


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column means come from one aggregate row, used as scalar subqueries of the projection."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m"))
    out = df.withColumn("_means", means.scalar())
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col("_means")[c]) for c in columns
    }).drop("_means")


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, subset=columns)


def preview(df: DataFrame, n: int, key: str = "email_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def clean_emails(df: DataFrame, stage_path: str | None = None) -> DataFrame:
    """The whole cleaning chain.

    The mode of the date is taken after the removal of duplicates. With ``stage_path`` the
    distinct rows are written there first, so that second read touches the date column only;
    without it the duplicates are removed once for the rows and once for the mode.
    """
    df = drop_exact_duplicates(df)
    if stage_path:
        df.write.mode("overwrite").parquet(stage_path)
        df = df.sparkSession.read.parquet(stage_path)
    df = fill_links(fill_receiver(df))
    df = fill_date_with_mode(parse_dates(df))
    return label_last(trim_strings(add_date_parts(df)))
