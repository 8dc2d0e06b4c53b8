"""The scanner as a Structured Streaming job: mails in, scan records and running counts out.

State lives in the checkpoint and in the sink tables. The same feature and scoring functions serve
the batch tables.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mailsift.operators import scoring
from mailsift.session import scratch_path


def read_emails(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(mails: DataFrame, model: PipelineModel, name: str, **options) -> DataFrame:
    return scoring.score(mails, model, name, **options)


def write_scans(scans: DataFrame, path: str, checkpoint: str):
    """Append sink, split by verdict: the threat log is one partition of it. Runs until caught up."""
    return (
        scans.writeStream.outputMode("append").format("parquet").partitionBy("is_phishing")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )


def running_totals(scans: DataFrame) -> DataFrame:
    return scans.groupBy().agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_phishing")).alias("threats"))


def hourly_counts(events: DataFrame, timestamp: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per clock hour; state older than the watermark is dropped in update and append mode."""
    return events.withWatermark(timestamp, late).groupBy(F.window(timestamp, "1 hour").alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour_start"), *by, "n")


def distinct_scans(scans: DataFrame, key: str = "email_id", timestamp: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Each key once, however often its mail is delivered again within the watermark; later rows are dropped."""
    return scans.withWatermark(timestamp, late).dropDuplicatesWithinWatermark([key])


def run_to_table(result: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run an aggregate until its source is exhausted and return the table it leaves.

    Each batch is written to a folder of its own, so a repeated batch replaces itself, and what has
    been written is found again after a restart. In append mode all batches together are the result,
    in complete mode the last one, in update mode the last row of each of the ``keys``.
    """
    spark = result.sparkSession
    base = scratch_path(spark, name)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")

    query = (
        result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}-state")
        .foreachBatch(save).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], result.schema)
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(base)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())
    elif mode == "update":
        values = [c for c in result.columns if c not in (keys or [])]
        rows = rows.groupBy(*(keys or [])).agg(*[F.max_by(c, "batch").alias(c) for c in values])
    return rows.select(*result.columns)
