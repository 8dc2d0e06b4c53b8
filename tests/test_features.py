"""Hand-made mails and the values they must have."""

import pytest
from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.functions import addresses, dates, scores, text, urls
from mailsift.operators import features

#: Hand-made mails with the values they must have; counts that are not named are 0.
GOLDEN = [
    ('', {'clean': '', 'alpha': '', 'strip': '', 'links': None}),
    ('plain words', {'length': 11, 'words': 2, 'clean': 'plain words', 'clean_words': 2, 'alpha': 'plain words', 'strip': 'plain words', 'links': None}),
    ('Re: x', {'length': 5, 'special': 1, 'special_all': 1, 'reply': 1, 'caps': 1, 'words': 2, 'clean': 're x', 'clean_words': 2, 'alpha': 'x', 'strip': 'Re: x', 'links': None}),
    ('afwd b', {'length': 6, 'words': 2, 'clean': 'afwd b', 'clean_words': 2, 'alpha': 'afwd b', 'strip': 'afwd b', 'links': None}),
    ('FWD now', {'length': 7, 'upper_words': 1, 'reply': 1, 'caps': 3, 'words': 2, 'clean': 'fwd now', 'clean_words': 2, 'alpha': 'fwd now', 'strip': 'FWD now', 'links': None}),
    ('ALLCAPS A1 12 É ẞ straße STRASSE', {'length': 32, 'special': 3, 'special_all': 3, 'upper_words': 5, 'digits': 3, 'caps': 17, 'words': 7, 'clean': 'allcaps a1 12 stra e strasse', 'clean_words': 6, 'alpha': 'allcaps a stra e strasse', 'strip': 'ALLCAPS A1 12 É ẞ straße STRASSE', 'links': None}),
    ('emoji 😀 é', {'length': 9, 'special': 2, 'special_all': 2, 'words': 3, 'clean': 'emoji', 'clean_words': 1, 'alpha': 'emoji', 'strip': 'emoji 😀 é', 'links': None}),
    ('ßß ß', {'length': 4, 'special': 3, 'special_all': 3, 'words': 2, 'clean': '', 'alpha': '', 'strip': 'ßß ß', 'links': None}),
    ('see http://a.b/c and https://x.y;z', {'length': 34, 'special': 10, 'special_all': 10, 'words': 4, 'clean': 'see link and link', 'clean_words': 4, 'alpha': 'see and', 'strip': 'see http://a.b/c and https://x.y;z', 'links': 'http://a.b/c; https://x.y;z', 'batch_urls': 2, 'single_urls': 2}),
    ('http://10.0.0.7/ in', {'length': 19, 'special': 7, 'special_all': 7, 'digits': 5, 'words': 2, 'clean': 'link in', 'clean_words': 2, 'alpha': 'in', 'strip': 'http://10.0.0.7/ in', 'links': 'http://10.0.0.7/', 'batch_urls': 1, 'single_urls': 1, 'ip': 1}),
    ('HTTP://BIT.LY/x http://BIT.ly/q', {'length': 31, 'special': 10, 'special_all': 10, 'caps': 12, 'words': 2, 'clean': 'link link', 'clean_words': 2, 'alpha': '', 'strip': 'HTTP://BIT.LY/x http://BIT.ly/q', 'links': 'http://BIT.ly/q', 'batch_urls': 1, 'single_urls': 1, 'short': 1, 'suspicious': 1}),
    ('<b>tag</b> <>', {'length': 13, 'special': 7, 'special_all': 7, 'html': 1, 'words': 2, 'clean': 'b tag b', 'clean_words': 3, 'alpha': 'tag', 'strip': '<b>tag</b> <>', 'links': None}),
    ('shipping pin', {'length': 12, 'words': 2, 'clean': 'shipping pin', 'clean_words': 2, 'alpha': 'shipping pin', 'strip': 'shipping pin', 'links': None, 'personal': 1}),
    ('a@b @c d@ @@ @@e x@@y mail me@x.org!', {'length': 36, 'special': 12, 'special_all': 12, 'exclaim': 1, 'words': 8, 'clean': 'email c d email email mail email', 'clean_words': 7, 'alpha': 'a b c d e x y mail me x org', 'strip': 'a@b @c d@ @@ @@e x@@y mail me@x.org!', 'links': None}),
    ('tab\tnew\nline\u2003wide\xa0hard\x1csep', {'length': 26, 'special': 5, 'words': 6, 'clean': 'tab new line wide hard sep', 'clean_words': 6, 'alpha': 'tab new line wide hard sep', 'strip': 'tab\tnew\nline\u2003wide\xa0hard\x1csep', 'links': None}),
    ('digits ١٢ 34', {'length': 12, 'special': 2, 'special_all': 2, 'digits': 4, 'words': 3, 'clean': 'digits 34', 'clean_words': 2, 'alpha': 'digits', 'strip': 'digits ١٢ 34', 'links': None}),
    ('Ⅷ ǅ ªA', {'length': 6, 'special': 3, 'special_all': 3, 'upper_words': 1, 'caps': 2, 'words': 3, 'clean': 'a', 'clean_words': 1, 'alpha': 'a', 'strip': 'Ⅷ ǅ ªA', 'links': None}),
    ('http:// x', {'length': 9, 'special': 3, 'special_all': 3, 'words': 2, 'clean': 'link x', 'clean_words': 2, 'alpha': 'x', 'strip': 'http:// x', 'links': None, 'batch_urls': 1}),
    ('https://ok?q=1.2.3.4 ', {'length': 21, 'special': 8, 'special_all': 8, 'digits': 4, 'words': 1, 'clean': 'link', 'clean_words': 1, 'alpha': '', 'strip': 'https://ok?q=1.2.3.4', 'links': 'https://ok?q=1.2.3.4', 'batch_urls': 1, 'single_urls': 1, 'ip': 1}),
    ('verify URGENT alert alert', {'length': 25, 'upper_words': 1, 'caps': 6, 'words': 4, 'clean': 'verify urgent alert alert', 'clean_words': 4, 'alpha': 'verify urgent alert alert', 'strip': 'verify URGENT alert alert', 'links': None, 'urgent': 3}),
    ('Bank account, PayPal', {'length': 20, 'special': 1, 'special_all': 1, 'caps': 3, 'words': 3, 'clean': 'bank account paypal', 'clean_words': 3, 'alpha': 'bank account paypal', 'strip': 'Bank account, PayPal', 'links': None}),
    ('éré ré re', {'length': 9, 'special': 3, 'special_all': 3, 'reply': 1, 'words': 3, 'clean': 'r r re', 'clean_words': 3, 'alpha': 'r r re', 'strip': 'éré ré re', 'links': None}),
]

COLUMNS = {
    "length": F.length, "special": text.num_special, "special_all": lambda c: text.num_special(c, True),
    "upper_words": text.upper_words, "reply": text.has_reply_mark, "digits": text.num_digits,
    "exclaim": lambda c: text.count_char(c, "!"), "caps": text.num_caps, "html": text.contains_html,
    "words": text.word_count, "clean": text.clean, "clean_words": lambda c: text.squeezed_word_count(text.clean(c)),
    "alpha": lambda c: text.clean(c, "alpha"), "strip": text.strip, "links": urls.joined,
    "batch_urls": urls.count_batch, "single_urls": urls.count_single, "ip": urls.has_ip, "short": urls.has_shortener,
    "urgent": lambda c: scores.keyword_score(F.lower(c), fixed.URGENCY_BATCH),
    "personal": lambda c: scores.keyword_score(F.lower(c), fixed.PERSONAL), "suspicious": urls.suspicious,
}


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    return {r["i"]: r for r in df.select("i", *[make(F.col("t")).alias(n) for n, make in COLUMNS.items()]).collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_golden(results, name):
    bad = [(t, results[i][name]) for i, (t, want) in enumerate(GOLDEN) if results[i][name] != want.get(name, 0)]
    assert not bad


def test_addresses(spark):
    df = spark.createDataFrame([(None,), ("unknown",), ("plain",), ("a@b@C.Org",), ("",)], "a string")
    got = [tuple(r) for r in df.select(
        addresses.domain(F.col("a")), F.length(addresses.pseudonym(F.col("a"))), F.length(addresses.short_pseudonym(F.col("a")))).collect()]
    assert got == [("unknown", 7, 7), ("unknown", 7, 16), ("plain", 64, 16), ("c.org", 64, 16), ("", 64, 7)]


def test_hours_and_levels(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 11, 12, 17, 18, 21, 22, 23, None)], "h int")
    assert [r[0] for r in df.select(dates.time_of_day(F.col("h"))).collect()] == [
        "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night", "night", "unknown"]
    p = spark.createDataFrame([(v,) for v in (0.1, 0.25, 0.5, 0.75, 0.9)], "p double")
    assert [r[0] for r in p.select(scores.threat_level(F.col("p"))).collect()] == ["SAFE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_dates(spark):
    raw = ["Tue, 05 Aug 2008 16:31:02 -0700", "5 Aug 2008 16:31:02", "2008-08-05 16:31:02+00:00", "2008-08-05", "garbage", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    got = [r[0] for r in df.select(F.date_format(dates.parse_utc(F.col("r")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2008-08-05 23:31:02", "2008-08-05 16:31:02", "2008-08-05 16:31:02", "2008-08-05 00:00:00", None, None]


def test_profiles_disagree_where_they_should(spark):
    df = spark.createDataFrame([(1, "a\tb", "wire http: https://x.y warning", None)], "email_id int, subject string, body string, date timestamp")
    app, one = features.app_features(df).head(), features.single_features(df).head()
    assert (app["subject_num_special"], one["subject_num_special"]) == (1, 0)
    assert (app["num_urls"], one["num_urls"]) == (2, 1)
    assert (app["financial_score"], one["financial_score"]) == (0, 1)
    assert (one["hour_of_day"], one["is_night"], one["has_attachment"]) == (12, 0, 0)


def test_mails_dealt_to_more_tasks_are_the_same(spark, folder):
    from mailsift.sources.emails import PARTITIONS, emails
    plain, dealt = emails(spark, folder), emails(spark, folder, partitions=3)
    assert plain.count() == dealt.count() and plain.exceptAll(dealt).isEmpty()
    shuffled = "REPARTITION_BY_NUM"
    read = lambda df: df._jdf.queryExecution().toString()
    assert shuffled not in read(plain) and shuffled in read(dealt)
    spark.conf.set(PARTITIONS, "3")
    try:
        assert shuffled in read(emails(spark, folder))
    finally:
        spark.conf.unset(PARTITIONS)


def test_words_of_uploads_are_those_of_the_cleaned_text(spark):
    df = spark.createDataFrame([(i, None, t, None) for i, (t, _) in enumerate(GOLDEN)] + [(-1, None, None, None), (-2, "", "HTTP a@b http@c d", None)],
                               "email_id int, subject string, body string, date timestamp")
    out = features.app_features(df)
    assert out.where(F.size(F.split("clean_content", " ")) - (F.col("clean_content") == "").cast("int") != F.col("body_word_count")).isEmpty()
    plan = out.select("body_word_count")._jdf.queryExecution().optimizedPlan().toString()
    assert "clean_content" not in plan and "contains" in plan.lower()


def test_mails_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    from mailsift.sources import emails, tasks_for
    folder = str(tmp_path)
    cores = spark.sparkContext.defaultParallelism
    spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "concat('t', id) AS text", "'web' AS source").write.parquet(f"{folder}/documents.parquet")
    spark.range(3000, numPartitions=1).selectExpr("id AS event_id", "id % 7 AS user_id", "timestamp_seconds(id) AS ts").write.parquet(f"{folder}/events.parquet")
    spark.range(0).selectExpr("id AS doc_id", "CAST(1 AS INT) AS quality").write.parquet(f"{folder}/labels.parquet")
    assert tasks_for(spark, folder) == (cores if cores > 2 else None)
    rows = emails(spark, folder, cores).collect()
    assert len(rows) == 3000 and sorted(map(repr, rows)) == sorted(map(repr, emails(spark, folder).collect()))
    few = str(tmp_path / "few")
    spark.range(10).selectExpr("id AS doc_id", "'t' AS text").write.parquet(f"{few}/documents.parquet")
    assert tasks_for(spark, few) is None
