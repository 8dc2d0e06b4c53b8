"""Writers for the cleaned, engineered and result tables, and for fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F


def write_cleaned(df: DataFrame, path: str, dated_path: str | None = None) -> None:
    """The learning copy has no ``date``; the dated copy is written on request."""
    if dated_path:
        df.write.mode("overwrite").parquet(dated_path)
    df.drop("date").write.mode("overwrite").parquet(path)


def write_engineered(df: DataFrame, path: str, files_per_month: int = 64) -> None:
    """Partitioned by year and month, so time filters prune files.

    Rows are first spread by month and a hash of the key: at most ``files_per_month`` files a month, to be
    raised with the table, and a month that holds most of the rows is still written by many tasks.
    """
    spread = F.pmod(F.xxhash64("email_id"), F.lit(files_per_month))
    (
        df.repartition("year", "month", spread)
        .write.mode("overwrite").partitionBy("year", "month").parquet(path)
    )


def write_result(df: DataFrame, path: str) -> None:
    """A small result table (metrics, sizes, profiles) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def export_history(df: DataFrame, path: str) -> None:
    """The scan log can be long, so it keeps its partitions."""
    df.write.mode("overwrite").csv(path, header=True)


def save_model(model: PipelineModel, path: str) -> None:
    """Imputer, feature list, scaler and classifier travel in one folder."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
