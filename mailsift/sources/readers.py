"""Readers: raw email CSV, parquet tables, column-name clean-up, alias columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mailsift import fixed

EMAIL_SCHEMA = T.StructType([
    T.StructField("sender", T.StringType()),
    T.StructField("receiver", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("links", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_emails_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = EMAIL_SCHEMA,
    encoding: str = "ISO-8859-1",
    null_tokens: list[str] | None = None,
) -> DataFrame:
    """CSV with quoted multi-line bodies; extra null tokens become null in string columns.

    Multi-line CSV files cannot be split, so large inputs should come as many files and be
    written to parquet once.
    """
    raw = spark.read.schema(schema).csv(
        path, header=True, encoding=encoding, multiLine=True, quote='"', escape='"',
    )
    return nullify_tokens(normalise_columns(raw), null_tokens)


def nullify_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    tokens = fixed.NULL_TOKENS if tokens is None else tokens
    return df.select(*[
        F.when(~F.col(f.name).isin(tokens), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema
    ])


def normalise_name(name: str) -> str:
    return re.sub(r"[^\w]", "", name.strip().replace(" ", "_"))


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip, space to underscore, drop what is not a word character."""
    return df.toDF(*[normalise_name(c) for c in df.columns])


def resolve_aliases(df: DataFrame, need_label: bool = True) -> DataFrame:
    """``Email_Subject``, ``Email_Content`` and ``Label`` stand for subject, body and label.

    The first two win over an existing column; ``Label`` is used only where ``label`` is absent.
    """
    have = set(df.columns)
    for alias, name in (("Email_Subject", "subject"), ("Email_Content", "body")):
        if alias in have:
            df = df.withColumn(name, F.col(f"`{alias}`"))
    if "label" not in have and "Label" in have:
        df = df.withColumn("label", F.col("`Label`"))
    if need_label and "label" not in df.columns:
        raise ValueError("the table needs a 'label' or 'Label' column")
    for name in ("subject", "body"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    return df.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in ("subject", "body")})
