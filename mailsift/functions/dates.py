"""Date expressions. ``weekday`` counts Monday as 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import fixed


def parse_utc(raw: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, in UTC; null if none does. A leading day name is ignored."""
    text = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    formats = fixed.DATE_FORMATS if formats is None else formats
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "weekday": F.weekday(ts),
    }


def is_weekend(weekday: Column) -> Column:
    return weekday.isin(5, 6).cast("int")


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), "unknown")
        .when((hour >= 6) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 18) & (hour < 22), "evening")
        .otherwise("night")
    )


def single_parts(ts: Column) -> dict[str, Column]:
    """Time features of one scored email; 12, 0, 0 without a timestamp."""
    hour = F.hour(ts)
    return {
        "hour_of_day": F.coalesce(hour, F.lit(12)),
        "is_weekend": F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)),
        "is_night": F.coalesce(((hour < 6) | (hour > 22)).cast("int"), F.lit(0)),
    }
