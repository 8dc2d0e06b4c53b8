"""Sources, cleaning and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.catalog.inputs import featured, prepared
from mailsift.catalog.registry import (
    B, FEATURE_SQL, LINKS, PARTS_SQL, S, address_sql, alpha_sql, clean_sql, columns, query, r, rounded, with_emails,
    with_features)
from mailsift.fixed import WS
from mailsift.functions import addresses, dates, text, urls
from mailsift.operators import cleaning, profiling
from mailsift.session import scratch_path
from mailsift.sources import emails, normalise_columns, read_emails_csv, resolve_aliases, sinks, table
from mailsift.sources.readers import nullify_tokens


@query("emails_adapter", with_emails("SELECT * FROM emails"))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return emails(spark, folder)


@query("normalise_columns", "SELECT doc_id AS Doc_Id, text AS Body_text, lang AS lang, source AS sourcename, n_chars AS n_chars FROM documents")
def _(spark, folder):
    odd = table(spark, folder, "documents").toDF(" Doc Id", "Body text ", "lang?", "source-name", "n_chars!")
    return normalise_columns(odd)


@query("null_tokens", "SELECT doc_id, CASE WHEN lang IN ('na', 'NA', 'Unknown', '') THEN NULL ELSE lang END AS lang, "
       "CASE WHEN text IN ('na', 'NA', 'Unknown', '') THEN NULL ELSE text END AS text FROM documents")
def _(spark, folder):
    return nullify_tokens(table(spark, folder, "documents").select("doc_id", "lang", "text"))


@query("csv_roundtrip", with_emails(
    "SELECT sender, receiver, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, "
    "nullif(subject, '') AS subject, nullif(body, '') AS body, label, links FROM emails"))
def _(spark, folder):
    path = scratch_path(spark, "emails-csv")
    rows = emails(spark, folder).select(
        "sender", "receiver", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "subject", "body", "label", "links")
    rows.write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_emails_csv(spark, path, encoding="UTF-8")


@query("engineered_roundtrip", with_features(
    "SELECT coalesce(year, 0) AS year, coalesce(month, 0) AS month, count(*) AS n, "
    "CAST(sum(body_length) AS BIGINT) AS body_length FROM featured GROUP BY 1, 2"))
def _(spark, folder):
    path = scratch_path(spark, "engineered")
    sinks.write_engineered(featured(spark, folder), path)
    kept = spark.read.parquet(path).na.fill(0, ["year", "month"])
    return kept.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("body_length").alias("body_length"))


@query("clean_dedup", "SELECT min(doc_id) AS doc_id, text, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars")
def _(spark, folder):
    return cleaning.drop_exact_duplicates(table(spark, folder, "documents"), "doc_id")


@query("dedup_removed", """
SELECT CAST(sum(c) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(c) - count(*) AS BIGINT) AS removed
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)""")
def _(spark, folder):
    return cleaning.duplicate_count(table(spark, folder, "documents"), "doc_id")


@query("fill_receiver", with_emails("SELECT email_id, coalesce(receiver, 'unknown') AS receiver FROM emails"))
def _(spark, folder):
    return cleaning.fill_receiver(emails(spark, folder).select("email_id", "receiver"))


@query("extract_links", with_emails(
    f"SELECT email_id, nullif(array_to_string(regexp_extract_all(body, '(https?://[^{WS}]+)', 1), '; '), '') AS found FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select("email_id", urls.joined(F.col("body")).alias("found"))


@query("fill_links", with_emails(f"SELECT email_id, {LINKS} AS links FROM emails"))
def _(spark, folder):
    return cleaning.fill_links(emails(spark, folder)).select("email_id", "links")




@query("parse_dates", with_emails(
    "SELECT email_id, CASE WHEN email_id % 31 = 3 THEN NULL WHEN email_id % 2 = 0 THEN date_trunc('second', date) "
    "ELSE date_trunc('second', date) - INTERVAL 2 HOUR END AS date FROM emails"))
def _(spark, folder):
    e = emails(spark, folder)
    even = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss")
    odd = F.concat(F.date_format("date", "dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    raw = F.when(F.col("email_id") % 31 == 3, "garbage").when(F.col("email_id") % 2 == 0, even).otherwise(odd)
    return e.select("email_id", dates.parse_utc(raw).cast("timestamp_ntz").alias("date"))


@query("fill_mode_date", with_emails("""
, coarse AS (SELECT email_id, date_trunc('hour', date) AS date FROM emails),
best AS (SELECT date FROM coarse WHERE date IS NOT NULL GROUP BY date ORDER BY count(*) DESC, date LIMIT 1)
SELECT email_id, coalesce(date, (SELECT date FROM best), TIMESTAMP '2000-01-01 00:00:00') AS date FROM coarse"""))
def _(spark, folder):
    coarse = emails(spark, folder).select("email_id", F.date_trunc("hour", "date").cast("timestamp_ntz").alias("date"))
    return cleaning.fill_date_with_mode(coarse)


@query("date_parts", with_emails(
    "SELECT email_id, " + ", ".join(f"coalesce({e}, -1) AS {c}" for c, e in PARTS_SQL.items()) + " FROM emails"))
def _(spark, folder):
    return cleaning.add_date_parts(emails(spark, folder).select("email_id", "date")).drop("date").na.fill(-1)


@query("trim_strings", f"SELECT doc_id, regexp_replace('\t ' || text || '　\n', '^[{WS}]+|[{WS}]+$', '', 'g') AS text, "
       f"regexp_replace(lang, '^[{WS}]+|[{WS}]+$', '', 'g') AS lang FROM documents")
def _(spark, folder):
    padded = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("\t "), "text", F.lit("　\n")).alias("text"), "lang")
    return cleaning.trim_strings(padded)


@query("label_last", with_emails("SELECT email_id, sender, label FROM emails"))
def _(spark, folder):
    return cleaning.label_last(emails(spark, folder).select("label", "email_id", "sender"))


@query("resolve_aliases", with_emails(f"SELECT email_id, {S} AS subject, {B} AS body, label FROM emails"))
def _(spark, folder):
    odd = emails(spark, folder).select(
        "email_id", F.col("subject").alias("Email_Subject"), F.col("body").alias("Email_Content"),
        F.col("label").alias("Label"))
    return resolve_aliases(odd).select("email_id", "subject", "body", "label")


@query("clean_text", with_emails(f"SELECT email_id, {clean_sql(B)} AS clean_content FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select("email_id", text.clean(F.col("body")).alias("clean_content"))


@query("clean_text_alpha", with_emails(f"SELECT email_id, {alpha_sql(S)} AS subject, {alpha_sql(B)} AS body FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select(
        "email_id", text.clean(F.col("subject"), "alpha").alias("subject"), text.clean(F.col("body"), "alpha").alias("body"))


DOUBLES = ["body_percent_caps", "subject_body_ratio"]
NUMERIC = ["has_attachment", "num_attachments", *PARTS_SQL, *[c for c in FEATURE_SQL if c != "time_of_day"]]


@query("numeric_features", with_features(
    "SELECT email_id, " + ", ".join(f"{r(c)} AS {c}" if c in DOUBLES else f"coalesce({c}, -1) AS {c}" for c in NUMERIC)
    + " FROM featured"))
def _(spark, folder):
    df = featured(spark, folder).withColumn("subject_hash", F.hash("subject"))
    rows = df.select("email_id", *cleaning.numeric_columns(df))
    return rounded(rows.na.fill(-1, [c for c in rows.columns if c not in DOUBLES]))


@query("choose_features", with_features("SELECT email_id, subject_length, num_urls FROM featured"))
def _(spark, folder):
    df = featured(spark, folder)
    return df.select("email_id", *cleaning.choose_features(df, ["subject_length", "no_such_column", "num_urls"]))


@query("write_cleaned", with_emails("SELECT email_id, sender, label FROM emails"))
def _(spark, folder):
    """The learning copy has no date, the dated one has it."""
    plain, dated = scratch_path(spark, "cleaned"), scratch_path(spark, "dated")
    sinks.write_cleaned(emails(spark, folder).select("email_id", "sender", "date", "label"), plain, dated)
    both = spark.read.parquet(plain).join(spark.read.parquet(dated).select("email_id", "date"), "email_id")
    return both.drop("date")


@query("write_result", with_emails("SELECT label, count(*) AS n FROM emails GROUP BY 1"))
def _(spark, folder):
    path = scratch_path(spark, "result")
    sinks.write_result(emails(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("label int, n bigint").csv(path, header=True)


@query("impute_mean", with_features(
    f"SELECT email_id, {r('coalesce(hour::DOUBLE, avg(hour) OVER ())')} AS hour, "
    f"{r('coalesce(weekday::DOUBLE, avg(weekday) OVER ())')} AS weekday FROM featured"))
def _(spark, folder):
    return rounded(cleaning.impute_mean(prepared(spark, folder).select("email_id", "hour", "weekday"), ["hour", "weekday"]))


@query("impute_zero", with_features("SELECT email_id, coalesce(hour, 0) AS hour, coalesce(weekday, 0) AS weekday FROM featured"))
def _(spark, folder):
    return cleaning.impute_zero(prepared(spark, folder).select("email_id", "hour", "weekday"), ["hour", "weekday"])


@query("preview", with_emails("SELECT email_id, subject, label FROM emails ORDER BY email_id LIMIT 10"))
def _(spark, folder):
    return cleaning.preview(emails(spark, folder).select("email_id", "subject", "label"), 10)


@query("class_filter", with_features("SELECT email_id, label, num_attachments FROM featured WHERE label = 1"))
def _(spark, folder):
    return prepared(spark, folder).where("label = 1").select("email_id", "label", "num_attachments")


@query("sender_domain", with_emails(
    f"SELECT email_id, {address_sql('sender')[0]} AS sender_domain, {address_sql('receiver')[0]} AS receiver_domain FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select(
        "email_id", addresses.domain(F.col("sender")).alias("sender_domain"),
        addresses.domain(F.col("receiver")).alias("receiver_domain"))


@query("hash_addresses", with_emails(
    f"SELECT email_id, {address_sql('sender')[1]} AS sender_hash, {address_sql('receiver')[1]} AS receiver_hash FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select(
        "email_id", addresses.pseudonym(F.col("sender")).alias("sender_hash"),
        addresses.pseudonym(F.col("receiver")).alias("receiver_hash"))


@query("short_hash", with_emails(
    "SELECT email_id, CASE WHEN sender IS NULL OR sender = '' THEN 'unknown' ELSE sha256(sender)[1:16] END AS sender_hash FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select("email_id", addresses.short_pseudonym(F.col("sender")).alias("sender_hash"))


@query("table_overview", with_emails("""
, s AS (SELECT count(*) AS row_count, count(email_id) AS email_id, count(sender) AS sender, count(receiver) AS receiver,
  count(date) AS date, count(subject) AS subject, count(body) AS body, count(links) AS links FROM emails)
SELECT column_name, CAST(list_position(['email_id', 'sender', 'receiver', 'date', 'subject', 'body', 'links'], column_name) AS INT) AS position,
  CASE column_name WHEN 'email_id' THEN 'bigint' WHEN 'date' THEN 'timestamp_ntz' ELSE 'string' END AS type,
  non_null, row_count, CAST(7 AS INT) AS column_count
FROM (UNPIVOT s ON email_id, sender, receiver, date, subject, body, links INTO NAME column_name VALUE non_null)"""))
def _(spark, folder):
    return profiling.table_overview(emails(spark, folder).select(
        "email_id", "sender", "receiver", "date", "subject", "body", "links"))


PROFILED = ["sender", "receiver", "date", "subject", "body", "links", "label"]


def _nulls(source: str, name: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS {name} FROM {source}" for c in PROFILED)
    return f"SELECT column_name, CAST({name} AS BIGINT) AS {name} FROM ({rows})"


@query("null_profile", with_emails(_nulls("emails", "missing")))
def _(spark, folder):
    return profiling.null_profile(emails(spark, folder), PROFILED)


@query("null_compare", with_features(
    ", cleaned AS (SELECT *, 1 AS extra FROM (SELECT * REPLACE (coalesce(receiver, 'unknown') AS receiver, "
    "coalesce(date, TIMESTAMP '2000-01-01') AS date) FROM prepared)) "
    f"SELECT coalesce(b.column_name, a.column_name) AS column_name, coalesce(before_cleaning, -1) AS before_cleaning, after_cleaning FROM "
    f"({_nulls('emails', 'before_cleaning')}) b FULL OUTER JOIN "
    f"({_nulls('cleaned', 'after_cleaning')} UNION ALL SELECT 'hour', CAST(0 AS BIGINT)) a "
    "ON a.column_name = b.column_name"))
def _(spark, folder):
    before = emails(spark, folder).select(*PROFILED)
    after = cleaning.add_date_parts(cleaning.fill_date_with_mode(cleaning.fill_links(cleaning.fill_receiver(
        emails(spark, folder))))).select(*PROFILED, "hour")
    return profiling.null_compare(before, after).na.fill(-1, ["before_cleaning"])


