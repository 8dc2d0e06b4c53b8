"""Pieces shared by the corpus operators: written intermediates, hot keys, bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mailsift.session import written  # noqa: F401
from mailsift.sources import table

#: Text that a Python task holds at once; a single longer text makes a slice of its own.
SLICE_BYTES = 2_000_000
#: Rows of one Arrow batch between the JVM and Python.
BATCH_ROWS = 256


def documents(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Columns of ``documents``; only these are read from the files."""
    return table(spark, folder, "documents").select(*(names or ("doc_id", "text")))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut where the texts reach SLICE_BYTES."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = [0 if v is None else v for v in pa.compute.binary_length(batch.column(at)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [v or "" for v in column.to_pylist()]


def schema_with(df: DataFrame, keep: list[str], **added: str) -> T.StructType:
    """The kept columns as they are in ``df``, and added ones by name and type."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added.items()]
    return T.StructType([df.schema[k] for k in keep] + more)


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """(text, _row): all columns in one, so that operators can add columns whatever the names of these."""
    return df.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def range_of(value: Column, starts: list[int]) -> Column:
    """How many of the ascending ``starts`` are not above the value, by halving; null for a null value."""
    array = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    found = F.lit(0)
    for level in reversed(range(len(starts).bit_length())):
        step = 1 << level
        below = F.coalesce(F.get(array, found + (step - 1)) <= value, F.lit(False))
        found = found + F.when(below, F.lit(step)).otherwise(F.lit(0))
    return F.when(value.isNotNull(), found.cast("bigint"))


def held_out(divisor: int, remainder: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text falls on the remainder; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null"))) % divisor == remainder


def known_labels(labels: DataFrame, label: str, left_out: Column, key: str = "doc_id") -> DataFrame:
    """(key, label) of the rows that may be learned from; a key with several labels has the largest."""
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~left_out).groupBy(key).agg(
        F.max(label).cast("double").alias("label"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, left_out: Column,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of all labelled rows.

    Rows without a label, and rows whose labels are held out, are not in it. Texts are shuffled once at every size:
    labels grow as they do, and a broadcast of them would only put that off.
    """
    known = known_labels(labels, label, left_out, key)
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")).join(known.hint("merge"), key)
