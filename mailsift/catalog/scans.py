"""Scan log, its reports, and the streaming scanner."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.inputs import scans, scans_ctes
from mailsift.catalog.features import SINGLE_SQL
from mailsift.catalog.registry import B, S, columns, query, r, rounded, with_emails
from mailsift.operators import features, models, scoring
from mailsift.functions import seeded
from mailsift.session import cut_lineage, scratch_path, use_utc
from mailsift.sources import emails, sinks, table, tasks_for
from mailsift.streaming import (
    hourly_counts, last_by_sender, read_emails, read_output, run_to_table, running_totals, score_stream, sender_totals,
    write_outputs, write_scans)


@query("reject_empty", with_emails(f"SELECT email_id FROM emails WHERE {S} = '' AND {B} = ''"))
def _(spark, folder):
    return scoring.rejected(emails(spark, folder)).select("email_id")


@query("scannable", with_emails(f"SELECT email_id FROM emails WHERE {S} <> '' OR {B} <> ''"))
def _(spark, folder):
    return scoring.scannable(emails(spark, folder)).select("email_id")


@query("threat_log", f"WITH {scans_ctes()} SELECT * FROM scans WHERE is_phishing")
def _(spark, folder):
    return scoring.threat_log(scans(spark, folder))


@query("threat_rate", f"""WITH {scans_ctes()} SELECT count(*) AS total, CAST(count_if(is_phishing) AS BIGINT) AS threats,
  CAST(count(*) - count_if(is_phishing) AS BIGINT) AS safe, {r('count_if(is_phishing) * 100.0::DOUBLE / count(*)')} AS rate FROM scans""")
def _(spark, folder):
    return rounded(scoring.threat_rate(scans(spark, folder)))


@query("last_scans", f"WITH {scans_ctes()} SELECT * FROM scans ORDER BY timestamp DESC NULLS LAST, email_id DESC LIMIT 3")
def _(spark, folder):
    return scoring.last_scans(scans(spark, folder))


@query("scan_history", f"""WITH {scans_ctes()} SELECT timestamp AS Timestamp, subject AS Subject, sender AS Sender,
  printf('%.1f%%', probability * 100) AS "Threat Score", CASE WHEN is_phishing THEN 'Phishing' ELSE 'Safe' END AS Status, model AS Model FROM scans""")
def _(spark, folder):
    return scoring.display(scans(spark, folder))


@query("history_export", f"""WITH {scans_ctes()} SELECT CASE WHEN is_phishing THEN 'Phishing' ELSE 'Safe' END AS Status, count(*) AS n FROM scans GROUP BY 1""")
def _(spark, folder):
    path = scratch_path(spark, "history")
    sinks.export_history(scoring.display(scans(spark, folder)), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape="\\")
    return back.groupBy("Status").agg(F.count(F.lit(1)).alias("n"))


@query("verdicts", f"WITH {scans_ctes()} SELECT CASE WHEN is_phishing THEN 'Phishing' ELSE 'Safe' END AS verdict, count(*) AS n FROM scans GROUP BY 1")
def _(spark, folder):
    return scoring.verdicts(scans(spark, folder))


@query("scans_by_hour", f"""WITH {scans_ctes()} SELECT CAST(coalesce(hour(timestamp), -1) AS INT) AS hour, CASE WHEN is_phishing THEN 'Phishing' ELSE 'Safe' END AS type,
  count(*) AS n FROM scans GROUP BY 1, 2""")
def _(spark, folder):
    return scoring.scans_by_hour(scans(spark, folder)).na.fill(-1, ["hour"])  # -1: no date


def _dealt(spark, folder):
    """The mails, dealt to all cores where their file is not."""
    return emails(spark, folder, tasks_for(spark, folder))


def _scorer(spark, folder):
    """Trained on the features that scoring computes, all of them."""
    rows = features.single_features(_dealt(spark, folder)).select("email_id", "label", *fixed.APP_FEATURES)
    data = models.Prepared(cut_lineage(rows), fixed.APP_FEATURES, profile="single")
    return data.pipeline(models.fit_classifier("Logistic Regression", data.train))


@query("score_batch")
def _(spark, folder):
    return scoring.score(_dealt(spark, folder), _scorer(spark, folder), "Logistic Regression")


@query("score_features", with_emails(f", single AS (SELECT *, {columns(SINGLE_SQL)} FROM emails) SELECT email_id, "
                                     + ", ".join(fixed.APP_FEATURES) + f" FROM single WHERE {S} <> '' OR {B} <> ''"))
def _(spark, folder):
    """The features a saved scorer asks for, of every mail that is scored."""
    path = scratch_path(spark, "scorer")
    sinks.save_model(_scorer(spark, folder), path)
    kept = scoring.trained_with(sinks.load_model(path))
    return features.PROFILES[kept.getProfile()](scoring.scannable(_dealt(spark, folder))).select("email_id", *kept.getColumns())


# --- streams -----------------------------------------------------------------------------

def _event_stream(spark, folder):
    """Every event as a scan: flagged where its type is an error."""
    use_utc(spark)
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.select(F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") == "error").alias("is_phishing"))


@query("stream_totals", "SELECT count(*) AS total, CAST(count_if(event_type = 'error') AS BIGINT) AS threats FROM events")
def _(spark, folder):
    return run_to_table(running_totals(_event_stream(spark, folder)), "complete", "totals")


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS hour_start, event_type = 'error' AS is_phishing, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, folder):
    out = run_to_table(hourly_counts(_event_stream(spark, folder), "timestamp", ["is_phishing"]), "update", "hourly", ["hour_start", "is_phishing"])
    return out.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("stream_scores")
def _(spark, folder):
    """The mails, written once as files, scored as a stream into the scan log."""
    model = _scorer(spark, folder)
    source, sink = scratch_path(spark, "mail-in"), scratch_path(spark, "scan-log")
    mails = _dealt(spark, folder)
    mails.write.parquet(source)
    found = score_stream(read_emails(spark, source, mails.schema), model, "Logistic Regression")
    write_scans(found, sink, f"{sink}-state").awaitTermination()
    return spark.read.parquet(sink)


@query("stream_senders", f"""WITH {scans_ctes()}, s AS (SELECT coalesce(sender, '') AS sender, email_id, CAST(timestamp AS TIMESTAMP) AS timestamp, is_phishing,
  count(*) OVER (PARTITION BY coalesce(sender, '')) AS total,
  CAST(sum(CAST(is_phishing AS BIGINT)) OVER (PARTITION BY coalesce(sender, '')) AS BIGINT) AS threats,
  row_number() OVER (PARTITION BY coalesce(sender, '') ORDER BY timestamp DESC NULLS LAST, email_id DESC) AS rank FROM scans)
SELECT sender, total, threats, CAST(rank AS INT) AS rank, email_id, timestamp, is_phishing FROM s WHERE rank <= 3""")
def _(spark, folder):
    """The scan log, written once as files, read as a stream: totals and last scans of each sender."""
    use_utc(spark)
    source = scratch_path(spark, "scans-in")
    log = scans(spark, folder).select("email_id", "timestamp", "sender", "probability", "is_phishing")
    log.write.parquet(source)
    live = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    table_ = run_to_table(sender_totals(live), "update", "senders", ["sender"])
    out = last_by_sender(table_)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("stream_outputs", f"""WITH {scans_ctes()}, m AS (SELECT email_id, {S} = '' AND {B} = '' AS empty FROM emails)
SELECT 'scans' AS output, email_id FROM m WHERE NOT empty UNION ALL SELECT 'rejected', email_id FROM m WHERE empty
UNION ALL SELECT 'threats', email_id FROM m JOIN scans USING (email_id) WHERE NOT empty AND is_phishing""")
def _(spark, folder):
    """The mails, written once as files, read as a stream into three tables that are committed together."""
    source, sink = scratch_path(spark, "mail-in"), scratch_path(spark, "outputs")
    mails = emails(spark, folder)
    mails.write.parquet(source)
    chance = F.round(seeded.uniform("scan", F.col("email_id")), 4)

    def score(rows):
        return rows.select("email_id", chance.alias("probability"), (chance >= 0.5).alias("is_phishing"))

    write_outputs(read_emails(spark, source, mails.schema), score, sink, f"{sink}-state").awaitTermination()
    parts = [read_output(spark, sink, name).select(F.lit(name).alias("output"), "email_id") for name in ("scans", "threats", "rejected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
