"""One stream of mails, three tables: scan log, threat log and rejected mails, committed together.

Every micro-batch writes its part of the three tables under its number and then one commit row with the counts. Readers see
the parts of committed batches only. A batch that comes again after a crash overwrites what it left behind, and one that is
committed already is left alone, so a replay changes nothing, not even with another model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.operators import scoring

TABLES = ("scans", "threats", "rejected")
COMMIT = "scans bigint, threats bigint, rejected bigint, batch bigint"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batch_writer(score: Callable[[DataFrame], DataFrame], folder: str, key: str = "email_id"):
    """The ``foreachBatch`` function; ``score`` makes scans (with ``is_phishing``) of the mails that have a text."""
    def save(mails: DataFrame, number: int) -> None:
        spark = mails.sparkSession
        if exists(spark, f"{folder}/commits/batch={number}/_SUCCESS"):
            return
        part = {t: f"{folder}/{t}/batch={number}" for t in TABLES}
        scoring.rejected(mails).select(key).write.mode("overwrite").parquet(part["rejected"])
        scans = score(scoring.scannable(mails))
        scans.write.mode("overwrite").parquet(part["scans"])
        stored = spark.read.schema(scans.schema).parquet(part["scans"])
        scoring.threat_log(stored).write.mode("overwrite").parquet(part["threats"])
        turned_away = spark.read.parquet(part["rejected"]).agg(F.count(F.lit(1))).scalar()
        counts = stored.agg(F.count(F.lit(1)).alias("scans"), F.count_if("is_phishing").alias("threats"))
        counts.select("scans", "threats", turned_away.alias("rejected")).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/commits/batch={number}")

    return save


def write_outputs(mails: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, key: str = "email_id"):
    """Start the stream; it runs until its source is exhausted."""
    return (mails.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(score, folder, key))
            .trigger(availableNow=True).start())


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(scans, threats, rejected, batch) of each committed batch."""
    if not exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits")


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of TABLES, of committed batches only; with the number of the ``batch``."""
    if name not in TABLES:
        raise ValueError(f"{name!r} is none of {TABLES}")
    done = commits(spark, folder).select("batch").distinct()
    if done.isEmpty():
        raise FileNotFoundError(f"nothing is committed in {folder}")
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("bigint"))
    return rows.join(done, "batch", "left_semi")
