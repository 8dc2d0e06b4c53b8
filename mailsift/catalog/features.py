"""Feature projections and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.inputs import featured, scans, scans_ctes
from mailsift.catalog.registry import (
    B, BODY_SQL, DERIVED_SQL, FEATURE_SQL, LINKS, PARTS_SQL, S, SUBJECT_SQL, UPPER, address_sql, clean_sql,
    columns, count_found, count_left, count_removed, keywords, query, r, rounded, upper_words, with_emails, with_features)
from mailsift.fixed import WS
from mailsift.functions import dates, scores, text, urls
from mailsift.operators import cleaning, features, scoring
from mailsift.session import scratch_path
from mailsift.sources import emails, table


def _select(parts: dict[str, str]) -> str:
    return ", ".join(f"{r(e)} AS {c}" if "::DOUBLE" in e else f"{e} AS {c}" for c, e in parts.items())


@query("subject_features", with_emails(f"SELECT email_id, {_select(SUBJECT_SQL)}, "
       f"CAST(length(regexp_replace(regexp_replace({S}, '[^{WS}]+', 'w', 'g'), '[{WS}]+', '', 'g')) AS INT) AS subject_word_count FROM emails"))
def _(spark, folder):
    s = text.filled(F.col("subject"))
    return emails(spark, folder).select(
        "email_id", F.length(s).alias("subject_length"), text.num_special(s).alias("subject_num_special"),
        text.upper_words(s).alias("subject_upper_words"), text.has_reply_mark(s).alias("subject_has_re_fwd"),
        text.word_count(s).alias("subject_word_count"))


@query("body_features", with_emails(f"SELECT email_id, {_select(BODY_SQL)}, {count_removed(B, f'[{UPPER}]+')} AS body_num_caps, "
       f"CAST(len(regexp_extract_all({B}, '[^{WS}]+')) AS INT) AS body_word_count FROM emails"))
def _(spark, folder):
    b = text.filled(F.col("body"))
    return rounded(emails(spark, folder).select(
        "email_id", F.length(b).alias("body_length"), text.num_digits(b).alias("body_num_digits"),
        text.count_char(b, "!").alias("body_num_exclaim"), text.count_char(b, "?").alias("body_num_question"),
        text.percent_caps(b).alias("body_percent_caps"), text.contains_html(b).alias("contains_html"),
        text.num_caps(b).alias("body_num_caps"), text.word_count(b).alias("body_word_count")))


@query("url_features", with_features("SELECT email_id, num_urls, has_suspicious_url FROM featured"))
def _(spark, folder):
    links = F.col("links")
    return cleaning.fill_links(emails(spark, folder)).select(
        "email_id", urls.count_listed(links).alias("num_urls"), urls.suspicious(links).alias("has_suspicious_url"))


URL_LIST = f"regexp_extract_all({B}, 'https?://[^{WS}]+')"
URL_RISK_SQL = {
    "num_urls": f"CAST(len({URL_LIST}) AS INT)",
    "has_url": f"CAST(len({URL_LIST}) > 0 AS INT)",
    "has_ip_url": rf"CAST(len(list_filter({URL_LIST}, lambda u: regexp_matches(u, '\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+'))) > 0 AS INT)",
    "has_url_shortener": (
        f"CAST(len(list_filter({URL_LIST}, lambda u: contains(lower(u), 'bit.ly') OR contains(lower(u), 'tinyurl') "
        "OR contains(lower(u), 'goo.gl'))) > 0 AS INT)"),
}


@query("url_risk", with_emails(f"SELECT email_id, {columns(URL_RISK_SQL)}, {count_found(B, f'http[^{WS}]+')} AS num_urls_batch FROM emails"))
def _(spark, folder):
    b = text.filled(F.col("body"))
    return emails(spark, folder).select(
        "email_id", urls.count_single(b).alias("num_urls"), (urls.count_single(b) > 0).cast("int").alias("has_url"),
        urls.has_ip(b).alias("has_ip_url"), urls.has_shortener(b).alias("has_url_shortener"),
        urls.count_batch(b).alias("num_urls_batch"))


SINGLE_TIME_SQL = {
    "hour_of_day": "CAST(coalesce(hour(date), 12) AS INT)",
    "is_weekend": "CAST(coalesce(isodow(date) >= 6, false) AS INT)",
    "is_night": "CAST(coalesce(hour(date) < 6 OR hour(date) > 22, false) AS INT)",
}


@query("time_features", with_emails(f"SELECT email_id, {columns(SINGLE_TIME_SQL)} FROM emails"))
def _(spark, folder):
    return emails(spark, folder).select("email_id", *[c.alias(n) for n, c in dates.single_parts(F.col("date")).items()])


@query("time_of_day", with_features("SELECT email_id, time_of_day FROM featured"))
def _(spark, folder):
    df = cleaning.add_date_parts(emails(spark, folder).select("email_id", "date"))
    return df.select("email_id", dates.time_of_day(F.col("hour")).alias("time_of_day"))


@query("subject_body_ratio", with_emails(f"SELECT email_id, {r(DERIVED_SQL['subject_body_ratio'])} AS subject_body_ratio FROM emails"))
def _(spark, folder):
    s, b = text.filled(F.col("subject")), text.filled(F.col("body"))
    return rounded(emails(spark, folder).select("email_id", (F.length(s) / (F.length(b) + 1)).alias("subject_body_ratio")))


BOTH = f"lower({S}) || ' ' || lower({B})"


@query("keyword_scores", with_emails(
    f"SELECT email_id, {keywords(f'lower({S})', fixed.URGENCY_BATCH)} AS urgency_batch, "
    f"{keywords(f'lower({B})', fixed.FINANCIAL_BATCH)} AS financial_batch, "
    f"{keywords(BOTH, fixed.URGENCY_SINGLE)} AS urgency_single, {keywords(BOTH, fixed.FINANCIAL_SINGLE)} AS financial_single, "
    f"{keywords(BOTH, fixed.PERSONAL)} AS personal_info FROM emails"))
def _(spark, folder):
    low = emails(spark, folder).select(
        "email_id", F.lower(text.filled(F.col("subject"))).alias("s"), F.lower(text.filled(F.col("body"))).alias("b"))
    low = low.withColumn("both", F.concat_ws(" ", "s", "b"))
    return low.select(
        "email_id", scores.keyword_score(F.col("s"), fixed.URGENCY_BATCH).alias("urgency_batch"),
        scores.keyword_score(F.col("b"), fixed.FINANCIAL_BATCH).alias("financial_batch"),
        scores.keyword_score(F.col("both"), fixed.URGENCY_SINGLE).alias("urgency_single"),
        scores.keyword_score(F.col("both"), fixed.FINANCIAL_SINGLE).alias("financial_single"),
        scores.keyword_score(F.col("both"), fixed.PERSONAL).alias("personal_info"))


APP_SQL = {
    **{c: SUBJECT_SQL[c] for c in ("subject_length", "subject_num_special", "subject_upper_words")},
    "body_length": BODY_SQL["body_length"],
    "body_word_count": f"CAST(len(regexp_extract_all({clean_sql(B)}, '[^ ]+')) AS INT)",
    **{c: BODY_SQL[c] for c in ("body_num_digits", "body_num_exclaim", "body_num_question")},
    "num_urls": count_found(B, f"http[^{WS}]+"),
    "has_url": f"CAST(len(regexp_extract_all({B}, 'http[^{WS}]+')) > 0 AS INT)",
    "urgency_score": DERIVED_SQL["urgency_score"],
    "financial_score": DERIVED_SQL["financial_score"],
}
SINGLE_SQL = {
    "subject_length": SUBJECT_SQL["subject_length"],
    "subject_word_count": f"CAST(len(regexp_extract_all({S}, '[^{WS}]+')) AS INT)",
    "subject_num_special": count_left(S, f"[a-zA-Z0-9{WS}]+"),
    "subject_upper_words": upper_words(S),
    **{c: BODY_SQL[c] for c in ("body_length", "body_num_digits", "body_num_exclaim", "body_num_question")},
    "body_word_count": f"CAST(len(regexp_extract_all({B}, '[^{WS}]+')) AS INT)",
    "body_num_caps": count_removed(B, f"[{UPPER}]+"),
    **URL_RISK_SQL,
    "urgency_score": keywords(BOTH, fixed.URGENCY_SINGLE),
    "financial_score": keywords(BOTH, fixed.FINANCIAL_SINGLE),
    "personal_info_score": keywords(BOTH, fixed.PERSONAL),
    **SINGLE_TIME_SQL,
    "has_attachment": "coalesce(has_attachment, 0)",
    "num_attachments": "coalesce(num_attachments, 0)",
}


@query("app_features", with_emails(f"SELECT email_id, label, {columns(APP_SQL)} FROM emails"))
def _(spark, folder):
    return features.app_features(emails(spark, folder)).select("email_id", "label", *fixed.APP_FEATURES)


@query("single_features", with_emails(f"SELECT email_id, {columns(SINGLE_SQL)} FROM emails"))
def _(spark, folder):
    return features.single_features(emails(spark, folder)).select("email_id", *SINGLE_SQL)


def _full_sql() -> str:
    sender, receiver = address_sql("sender"), address_sql("receiver")
    strip = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g') AS {c}"
    return with_emails(f"""
, kept AS (SELECT min(email_id) AS email_id, sender, receiver, date, subject, body, links, has_attachment, num_attachments, label
  FROM emails GROUP BY ALL),
best AS (SELECT date FROM kept WHERE date IS NOT NULL GROUP BY date ORDER BY count(*) DESC, date LIMIT 1),
filled AS (SELECT * REPLACE (coalesce(receiver, 'unknown') AS receiver, {LINKS} AS links,
  coalesce(date, (SELECT date FROM best), TIMESTAMP '2000-01-01 00:00:00') AS date) FROM kept),
parts AS (SELECT *, {columns(PARTS_SQL)} FROM filled),
trimmed AS (SELECT * REPLACE ({", ".join(strip(c) for c in ("sender", "receiver", "subject", "body", "links"))}) FROM parts)
SELECT email_id, subject, body, links, has_attachment, num_attachments, year, month, day, hour, weekday,
  {sender[0]} AS sender_domain, {receiver[0]} AS receiver_domain, {sender[1]} AS sender_hash, {receiver[1]} AS receiver_hash,
  {_select(FEATURE_SQL)}, label FROM trimmed""")


@query("features_full", _full_sql())
def _(spark, folder):
    stage = scratch_path(spark, "distinct-emails")
    return rounded(features.engineered(cleaning.clean_emails(emails(spark, folder), stage)))


LEVEL = (
    "CASE WHEN {p} >= 0.9 THEN 'CRITICAL' WHEN {p} >= 0.75 THEN 'HIGH' WHEN {p} >= 0.5 THEN 'MEDIUM' "
    "WHEN {p} >= 0.25 THEN 'LOW' ELSE 'SAFE' END"
)


@query("threat_level", f"WITH {scans_ctes()} SELECT email_id, probability, {LEVEL.format(p='probability')} AS threat_level FROM scans")
def _(spark, folder):
    s = scans(spark, folder)
    return s.select("email_id", "probability", scores.threat_level(F.col("probability")).alias("threat_level"))


_TEXTS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in fixed.THREAT_TEXTS)


@query("threat_texts", f"WITH {scans_ctes()}, t(threat_level, title, message) AS (VALUES {_TEXTS}), "
       f"s AS (SELECT email_id, {LEVEL.format(p='probability')} AS threat_level FROM scans) "
       "SELECT email_id, threat_level, title, message FROM s JOIN t USING (threat_level)")
def _(spark, folder):
    s = scans(spark, folder).select("email_id", scores.threat_level(F.col("probability")).alias("threat_level"))
    return scoring.threat_texts(s)


@query("privacy_band", """
SELECT CASE WHEN l_quantity / 10 < 1 THEN 'Strong' WHEN l_quantity / 10 <= 2 THEN 'Medium' ELSE 'Weak' END AS band,
       count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, folder):
    band = scores.privacy_band(F.col("l_quantity") / 10)
    return table(spark, folder, "lineitem").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("verdict_bands", """
SELECT CASE WHEN l_discount * 150 < 5 THEN 'good' WHEN l_discount * 150 < 10 THEN 'acceptable' ELSE 'high cost' END AS cost,
       CASE WHEN 1 - l_tax * 3 > 0.95 THEN 'excellent' WHEN 1 - l_tax * 3 > 0.90 THEN 'strong'
            WHEN 1 - l_tax * 3 > 0.85 THEN 'good' ELSE 'needs improvement' END AS quality, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.groupBy(
        scores.cost_verdict(F.col("l_discount") * 150).alias("cost"),
        scores.accuracy_verdict(1 - F.col("l_tax") * 3).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


_FACTORS = " UNION ALL ".join(
    f"SELECT email_id, {i} AS pos, '{n}' AS factor, {c}::DOUBLE AS score FROM featured"
    for i, (n, c) in enumerate(fixed.KEY_FACTORS))


@query("key_factors", with_features(f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY score DESC, pos) AS k FROM ({_FACTORS}) WHERE score > 0)
SELECT email_id, CAST(k AS INT) AS rank, factor, score FROM f WHERE k <= 5"""))
def _(spark, folder):
    return scoring.key_factors(featured(spark, folder))


@query("risk_indicators", with_emails(
    f", single AS (SELECT email_id, {columns(SINGLE_SQL)} FROM emails) " + " UNION ALL ".join(
        f"SELECT email_id, '{k}' AS kind, '{n}' AS indicator, CAST({c} AS INT) AS value FROM single"
        for k, n, c in fixed.INDICATORS)))
def _(spark, folder):
    return scoring.indicators(features.single_features(emails(spark, folder)))
