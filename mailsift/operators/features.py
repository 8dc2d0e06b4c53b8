"""Feature projections: ``batch`` for engineered tables, ``app`` for uploads, ``single`` for scoring.

The three profiles differ on purpose in a few counts and word lists; a fitted pipeline keeps the
name of the profile it was trained with. Each is one projection over one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift import fixed
from mailsift.functions import addresses, dates, scores, text, urls


def _lowered(df: DataFrame) -> DataFrame:
    """Filled and lower-case texts, computed once and shared by the expressions above them."""
    df = df.withColumns({
        "_subject": text.filled(F.col("subject")),
        "_body": text.filled(F.col("body")),
    })
    return df.withColumns({"_lsubject": F.lower("_subject"), "_lbody": F.lower("_body")})


def _drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop("_subject", "_body", "_lsubject", "_lbody", "_linked", "_marked")


def anonymise(df: DataFrame, key: str | None = None, drop: bool = True) -> DataFrame:
    """Domains and pseudonyms of both addresses; the addresses themselves go."""
    df = df.withColumns({
        "sender_domain": addresses.domain(F.col("sender")),
        "receiver_domain": addresses.domain(F.col("receiver")),
        "sender_hash": addresses.pseudonym(F.col("sender"), key),
        "receiver_hash": addresses.pseudonym(F.col("receiver"), key),
    })
    return df.drop("sender", "receiver") if drop else df


def batch_features(df: DataFrame) -> DataFrame:
    """Engineered columns of a cleaned table (needs links, hour and weekday)."""
    s, b = F.col("_subject"), F.col("_body")
    new = {
        "subject_length": F.length(s),
        "subject_num_special": text.num_special(s),
        "subject_upper_words": text.upper_words(s),
        "subject_has_re_fwd": text.has_reply_mark(s),
        "body_length": F.length(b),
        "body_num_digits": text.num_digits(b),
        "body_num_exclaim": text.count_char(b, "!"),
        "body_num_question": text.count_char(b, "?"),
        "body_percent_caps": text.percent_caps(b),
        "num_urls": urls.count_listed(F.col("links")),
        "has_suspicious_url": urls.suspicious(F.col("links")),
        "time_of_day": dates.time_of_day(F.col("hour")),
        "subject_body_ratio": F.length(s) / (F.length(b) + 1),
        "urgency_score": scores.keyword_score(F.col("_lsubject"), fixed.URGENCY_BATCH),
        "financial_score": scores.keyword_score(F.col("_lbody"), fixed.FINANCIAL_BATCH),
    }
    if "contains_html" not in df.columns:
        new["contains_html"] = text.contains_html(b)
    if "is_weekend" not in df.columns:
        new["is_weekend"] = dates.is_weekend(F.col("weekday"))
    return _drop_helpers(_lowered(df).withColumns(new))


def engineered(df: DataFrame, key: str | None = None) -> DataFrame:
    """Cleaned table to engineered table: label last, no addresses, no date."""
    out = batch_features(anonymise(df, key)).drop("date")
    return out.select(*[c for c in out.columns if c != "label"], "label")


def app_features(df: DataFrame) -> DataFrame:
    s, b = F.col("_subject"), F.col("_body")
    # Steps of their own: each text is made once, whatever looks at it.
    marked = _lowered(df).withColumn("_linked", text.mark_links(F.col("_lbody"))).withColumn(
        "_marked", text.mark_addresses(F.col("_linked")))
    out = marked.withColumn("clean_content", text.clean(F.col("_body"))).withColumns({
        "subject_length": F.length(s),
        "subject_num_special": text.num_special(s),
        "subject_upper_words": text.upper_words(s),
        "body_length": F.length(b),
        "body_word_count": text.plain_word_count(F.col("_marked")),
        "body_num_digits": text.num_digits(b),
        "body_num_exclaim": text.count_char(b, "!"),
        "body_num_question": text.count_char(b, "?"),
        "num_urls": urls.count_batch(b),
        "urgency_score": scores.keyword_score(F.col("_lsubject"), fixed.URGENCY_BATCH),
        "financial_score": scores.keyword_score(F.col("_lbody"), fixed.FINANCIAL_BATCH),
    }).withColumn("has_url", (F.col("num_urls") > 0).cast("int"))
    return _drop_helpers(out)


def single_features(df: DataFrame, timestamp: str = "date") -> DataFrame:
    """Features of incoming mails, on batch tables and on streams alike."""
    s, b = F.col("_subject"), F.col("_body")
    both = F.col("_both")
    zero = F.lit(0)
    out = _lowered(df).withColumn("_both", F.concat_ws(" ", "_lsubject", "_lbody")).withColumns({
        "subject_length": F.length(s),
        "subject_word_count": text.word_count(s),
        "subject_num_special": text.num_special(s, keep_all_space=True),
        "subject_upper_words": text.upper_words(s),
        "body_length": F.length(b),
        "body_word_count": text.word_count(b),
        "body_num_digits": text.num_digits(b),
        "body_num_exclaim": text.count_char(b, "!"),
        "body_num_question": text.count_char(b, "?"),
        "body_num_caps": text.num_caps(b),
        "num_urls": urls.count_single(b),
        "has_ip_url": urls.has_ip(b),
        "has_url_shortener": urls.has_shortener(b),
        "urgency_score": scores.keyword_score(both, fixed.URGENCY_SINGLE),
        "financial_score": scores.keyword_score(both, fixed.FINANCIAL_SINGLE),
        "personal_info_score": scores.keyword_score(both, fixed.PERSONAL),
        **dates.single_parts(F.col(timestamp)),
        **{
            c: F.coalesce(F.col(c), zero) if c in df.columns else zero
            for c in ("has_attachment", "num_attachments")
        },
    }).withColumn("has_url", (F.col("num_urls") > 0).cast("int"))
    return _drop_helpers(out).drop("_both")


PROFILES = {"batch": batch_features, "app": app_features, "single": single_features}
