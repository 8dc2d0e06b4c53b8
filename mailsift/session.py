"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "mailsift", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the operators are tuned for; a cluster passes its own master."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = (
            b.master(master)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
        )
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once for each Spark application.

    The archive is written by the driver for the driver; Spark's own file service hands it out.
    """
    sc = spark.sparkContext
    if getattr(sc, "_mailsift_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="mailsift-"), "mailsift.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._mailsift_shipped = True


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are read and rendered in UTC everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master may fall back to a scratch folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mailsift-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and stops plans growing in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Stored in the shared folder and read again: cuts lineage, survives lost executors, and keeps plans small."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Reused several times: held in memory and on disk, recomputed if an executor goes."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


ROWS_PER_PARTITION = 1_000_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Even partitions by key for a narrow table of about ``rows`` rows that many passes will read.

    One partition per core at least, more as the table grows; a small table is not cut into more
    tasks than there are cores. Undoes the skew that joins and synthetic rows leave behind.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_PER_PARTITION)), key)
