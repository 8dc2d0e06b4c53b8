"""From raw mails to the engineered table and its profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mailsift import fixed
from mailsift.operators import cleaning, features, profiling
from mailsift.session import keep
from mailsift.sources import sinks


def build_tables(raw: DataFrame, out: str, key: str | None = None) -> DataFrame:
    """Writes distinct, cleaned and engineered mails below ``out``; returns the engineered table.

    The texts are read once per stage; everything after that reads narrow columns of parquet.
    """
    spark = raw.sparkSession
    cleaned = cleaning.clean_emails(raw, f"{out}/distinct")
    sinks.write_cleaned(cleaned, f"{out}/cleaned", f"{out}/cleaned_dated")
    engineered = features.engineered(spark.read.parquet(f"{out}/cleaned_dated"), key)
    sinks.write_engineered(engineered, f"{out}/engineered")
    return spark.read.parquet(f"{out}/engineered")


def profile_tables(engineered: DataFrame) -> dict[str, DataFrame]:
    """The profile tables of an engineered table; each is small."""
    df = engineered.drop("subject", "body", "links")
    return {
        "label_counts": profiling.label_pct(df),
        "feature_overview": profiling.feature_overview(df),
        "means_by_label": profiling.means_by(df, "label", fixed.CORRELATED_FEATURES[:5]),
        "sums_by_label": profiling.sums_by(df, "label", ["has_suspicious_url"]),
        "hour_histogram": profiling.hour_histogram(df),
        "weekend_crosstab": profiling.weekend_crosstab(df),
        "time_of_day": profiling.value_counts(df, "time_of_day"),
        "top_domains": profiling.top_values(df, "sender_domain", 15),
        "correlations": profiling.correlations(df, fixed.CORRELATED_FEATURES),
        "feature_summary": profiling.feature_summary(df, fixed.CORRELATED_FEATURES),
        "subject_length_box": profiling.boxplot(df, "subject_length"),
        "body_length_box": profiling.boxplot(df, "body_length"),
    }


def write_profiles(engineered: DataFrame, out: str) -> None:
    slim = keep(engineered.drop("subject", "body", "links"))
    for name, table in profile_tables(slim).items():
        sinks.write_result(table, f"{out}/{name}")
    slim.unpersist()
