"""Link expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import fixed
from mailsift.functions.text import SPACE


def extract(body: Column) -> Column:
    """All links of a body as an array."""
    return F.regexp_extract_all(body, F.lit(f"(?U)(https?://[^{SPACE}]+)"), F.lit(1))


def joined(body: Column) -> Column:
    """Links joined by ``; ``; null if there are none."""
    return F.nullif(F.array_join(extract(body), "; "), F.lit(""))


def count_listed(links: Column) -> Column:
    """Parts of a links text; ``none`` has 0. A ``;`` inside a link counts, as it always did."""
    return F.when(links == fixed.NO_LINKS, 0).otherwise(F.size(F.split(links, ";")))


def suspicious(links: Column) -> Column:
    return F.coalesce(links, F.lit("")).rlike(fixed.SUSPICIOUS_URL).cast("int")


def count_batch(body: Column) -> Column:
    return F.regexp_count(body, F.lit(f"(?U)http[^{SPACE}]+"))


def count_single(body: Column) -> Column:
    return F.regexp_count(body, F.lit(f"(?U)https?://[^{SPACE}]+"))


def has_ip(body: Column) -> Column:
    """A link with four dotted numbers in it; one scan of the body, no array of links."""
    return body.rlike(rf"(?U)https?://[^{SPACE}]*\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}+\.\p{{Nd}}").cast("int")


def has_shortener(body: Column) -> Column:
    return body.rlike(f"(?U)https?://[^{SPACE}]*{fixed.SHORTENERS}").cast("int")
