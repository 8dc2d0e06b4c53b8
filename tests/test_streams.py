"""The streaming scanner gives the batch scanner's rows."""

import os
from datetime import timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.operators import features, models, scoring
from mailsift.plans import batch
from mailsift.sources import emails
from mailsift.streaming import (
    commits, distinct_scans, hourly_counts, last_by_sender, read_emails, read_output, run_to_table, running_totals, score_stream,
    sender_totals, write_outputs, write_scans)
from mailsift.streaming.outputs import batch_writer


def test_stream_equals_batch(spark, folder, tmp_path):
    rows = features.single_features(emails(spark, folder)).select("email_id", "label", *fixed.APP_FEATURES)
    data = models.Prepared(rows, fixed.APP_FEATURES, balance=False, profile="single")
    model = data.pipeline(models.fit_classifier("Logistic Regression", data.train))
    mails = emails(spark, folder)
    mails.repartition(3).write.parquet(str(tmp_path / "in"))
    live = score_stream(read_emails(spark, str(tmp_path / "in"), mails.schema, 1), model, "LR")
    write_scans(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scoring.score(mails, model, "LR")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()

    stored = read_emails(spark, str(tmp_path / "in"), mails.schema, 1)
    totals = run_to_table(running_totals(score_stream(stored, model, "LR")), "complete", "t").head()
    rate = scoring.threat_rate(want).head()
    assert (totals["total"], totals["threats"]) == (rate["total"], rate["threats"])


def test_a_model_is_scored_with_its_own_features(spark, folder):
    plain = PipelineModel(stages=[models.FeatureProfile(profile="app", columns=["no_such_feature"])])
    with pytest.raises(ValueError):
        scoring.score(emails(spark, folder), plain, "LR")
    with pytest.raises(ValueError):
        scoring.score(emails(spark, folder), plain, "LR", profile="single")
    with pytest.raises(ValueError):
        scoring.score(emails(spark, folder), PipelineModel(stages=[StandardScalerModel()]), "LR")


def test_late_and_repeated_mails(spark, tmp_path):
    """A repeat within the watermark and a mail later than it are dropped; hours come out once closed.

    A batch drops what the watermark of the batch before it calls late.
    """
    schema = "email_id bigint, timestamp timestamp, is_phishing boolean"
    days = [[(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:30:00")], [(1, "2024-01-01 10:05:00"), (3, "2024-01-01 15:00:00")],
            [(5, "2024-01-01 18:00:00")], [(4, "2024-01-01 10:40:00")], [(6, "2024-01-01 23:00:00")]]
    for i, rows in enumerate(days):
        df = spark.createDataFrame(rows, "email_id bigint, t string").select(
            "email_id", F.to_timestamp("t").alias("timestamp"), F.lit(True).alias("is_phishing"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{i}"))
        for f in (tmp_path / "in" / f"part-{i}").glob("part-*.parquet"):
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    ids = run_to_table(distinct_scans(live), "append", "distinct")
    assert sorted(r.email_id for r in ids.collect()) == [1, 2, 3, 5, 6]
    hours = run_to_table(hourly_counts(live, "timestamp", ["is_phishing"]), "append", "closed")
    assert {(r.hour_start.hour, r.n) for r in hours.collect()} == {(10, 3), (15, 1), (18, 1)}


def test_whole_batch_job(spark, folder, tmp_path):
    table = batch.build_tables(emails(spark, folder), str(tmp_path / "tables"))
    assert table.count() == emails(spark, folder).drop("email_id").distinct().count()
    assert not {"sender", "receiver", "date"} & set(table.columns)
    one = table.where((F.col("year") == 2024) & (F.col("month") == 1)).select("email_id")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString().replace("PartitionFilters: [isnotnull(month", "PartitionFilters: [isnotnull(year")
    batch.write_profiles(table, str(tmp_path / "profiles"))
    assert (tmp_path / "profiles" / "correlations").exists()


SCANS = "email_id bigint, timestamp timestamp, sender string, probability double, is_phishing boolean"


def _scan_files(spark, tmp_path, lots, first=0):
    for i, rows in enumerate(lots, first):
        df = spark.createDataFrame(rows, "email_id bigint, t string, sender string, probability double, is_phishing boolean")
        df.withColumn("timestamp", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in" / f"part-{i}"))
        for f in (tmp_path / "in" / f"part-{i}").glob("part-*.parquet"):
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    return spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def _run(result, base):
    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out-{number}")
    result.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(save).trigger(
        availableNow=True).start().awaitTermination()
    rows = result.sparkSession.read.parquet(f"{base}/out-*")
    return rows


def _want(lots):
    out = {}
    for email_id, t, sender, _, flag in (r for lot in lots for r in lot):
        out.setdefault(sender or "", []).append((t or "", email_id, flag))
    return {s: (len(v), sum(f for *_, f in v), [i for _, i, _ in sorted(v, reverse=True)[:3]]) for s, v in out.items()}


def test_senders_on_a_stream_after_a_restart(spark, tmp_path):
    """State goes on from the checkpoint: a second run sees only new files and knows the old ones."""
    lots = [[(10 * i + j, None if (i + j) % 7 == 0 else f"2024-01-0{1 + (i * j) % 5} 10:00:00",
              None if j == 9 else "hot" if j < 5 else f"s{j % 3}", 0.1 * j, j % 2 == 0) for j in range(10)] for i in range(6)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for part in (lots[:3], lots[3:]):
            live = _scan_files(spark, tmp_path, part, 0 if part is lots[:3] or part[0][0][0] == 0 else 3)
            rows = _run(sender_totals(live), str(tmp_path / "run"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    final = rows.groupBy("sender").agg(*[F.max_by(c, "batch").alias(c) for c in ("total", "threats", "times", "ids", "flags")])
    got = {r.sender: (r.total, r.threats, list(r.ids)) for r in final.collect()}
    assert got == _want(lots)
    ranked = last_by_sender(final).where("sender = 'hot'").orderBy("rank").collect()
    assert [r.email_id for r in ranked] == got["hot"][2]


def test_idle_senders_are_closed(spark, tmp_path):
    """Once the watermark is past the idle time a sender is closed; its next mail opens a new state."""
    lots = [[(1, "2024-01-01 10:00:00", "a", 0.9, True)], [(2, "2024-01-02 10:00:00", "b", 0.1, False)],
            [(3, "2024-01-03 10:00:00", "b", 0.1, False)], [(4, "2024-01-04 10:00:00", "a", 0.2, False)]]
    rows = _run(sender_totals(_scan_files(spark, tmp_path, lots), idle=timedelta(hours=5)), str(tmp_path / "run"))
    a = rows.where("sender = 'a'").orderBy("batch", "closed").collect()
    assert [(r.closed, r.total) for r in a if r.closed][:1] == [(True, 1)]
    assert max(r.total for r in a) == 1 and len({r.opened for r in a}) == 2


def test_three_outputs_of_one_stream(spark, tmp_path):
    """Counts add up, uncommitted parts are not seen, and a replayed batch changes nothing."""
    mails = spark.createDataFrame(
        [(i, None if i % 5 == 0 else f"s{i}", "" if i % 5 == 0 else "b") for i in range(40)],
        "email_id bigint, subject string, body string")
    mails.repartition(4).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def score(rows):
        return rows.select("email_id", (F.col("email_id") % 3 == 0).alias("is_phishing"))

    def never(rows):
        raise AssertionError("a committed batch is scored again")

    live = read_emails(spark, str(tmp_path / "in"), mails.schema, 1)
    write_outputs(live, score, out, state).awaitTermination()

    def seen():
        return {t: sorted(r.email_id for r in read_output(spark, out, t).collect()) for t in ("scans", "threats", "rejected")}

    want = {"scans": [i for i in range(40) if i % 5], "rejected": list(range(0, 40, 5)),
            "threats": [i for i in range(40) if i % 5 and i % 3 == 0]}
    assert seen() == want
    done = commits(spark, out)
    assert done.count() == 4
    sums = done.agg(F.sum("scans"), F.sum("threats"), F.sum("rejected")).head()
    assert tuple(sums) == tuple(len(want[t]) for t in ("scans", "threats", "rejected"))
    batch_writer(never, out)(mails, 0)
    score(mails).write.parquet(f"{out}/scans/batch=99")
    mails.select("email_id").write.parquet(f"{out}/rejected/batch=99")
    assert seen() == want
    write_outputs(live, never, out, state).awaitTermination()
    assert seen() == want
