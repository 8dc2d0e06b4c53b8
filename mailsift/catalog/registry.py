"""Registry and the shared pieces of the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from mailsift import fixed
from mailsift.fixed import WS
from mailsift.sources.emails import emails_cte

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


# --- SQL pieces --------------------------------------------------------------------------

def r(expression: str, digits: int = 6) -> str:
    """Rounded like the Spark side, without negative zero."""
    return f"round({expression}, {digits}) + 0.0"


def u(seed: str, *keys: str) -> str:
    digest = f"sha256('{seed}|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"((CAST(('0x' || {digest}[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)"


def laplace(seed: str, scale: float, *keys: str) -> str:
    c = f"({u(seed, *keys)} - 0.5)"
    return f"(-{scale}::DOUBLE * sign({c}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({c})))"


def keywords(text: str, words: list[str]) -> str:
    return "CAST(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + " AS INT)"


def count_left(text: str, pattern: str) -> str:
    return f"CAST(length(regexp_replace({text}, '{pattern}', '', 'g')) AS INT)"


def count_removed(text: str, pattern: str) -> str:
    return f"CAST(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')) AS INT)"


def count_found(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INT)"


UPPER = r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}"
LOWER = r"\p{Ll}\p{Lt}\x{aa}\x{ba}\x{2170}-\x{217F}\x{24D0}-\x{24E9}"
S, B = "coalesce(subject, '')", "coalesce(body, '')"

LINKS = (
    f"coalesce(links, nullif(array_to_string(regexp_extract_all(body, '(https?://[^{WS}]+)', 1), '; '), ''), 'none')"
)


def clean_sql(text: str) -> str:
    t = f"lower({text})"
    t = f"regexp_replace({t}, 'http[^{WS}]+', ' link ', 'g')"
    t = f"regexp_replace({t}, '[^{WS}]+@[^{WS}]+', ' email ', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9{WS}]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '[{WS}]+', ' ', 'g'))"


def alpha_sql(text: str) -> str:
    t = f"lower({text})"
    t = f"regexp_replace({t}, '<[^\n]*?>', '', 'g')"
    t = f"regexp_replace({t}, 'http[^{WS}]+|www[^{WS}]+', '', 'g')"
    t = f"regexp_replace({t}, '^(re|fwd):', '')"
    t = f"regexp_replace({t}, '[^a-z{WS}]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '[{WS}]+', ' ', 'g'))"


def upper_words(text: str) -> str:
    return (
        f"CAST(len(list_filter(regexp_split_to_array({text}, '[{WS}]+'), "
        f"lambda w: regexp_matches(w, '[{UPPER}]') AND NOT regexp_matches(w, '[{LOWER}]'))) AS INT)"
    )


SUBJECT_SQL = {
    "subject_length": f"CAST(length({S}) AS INT)",
    "subject_num_special": count_left(S, "[a-zA-Z0-9 ]+"),
    "subject_upper_words": upper_words(S),
    "subject_has_re_fwd": (
        rf"CAST(regexp_matches({S}, '(?i)(^|[^\p{{L}}\p{{N}}_])(re|fwd)($|[^\p{{L}}\p{{N}}_])') AS INT)"),
}
BODY_SQL = {
    "body_length": f"CAST(length({B}) AS INT)",
    "body_num_digits": count_removed(B, r"\p{Nd}+"),
    "body_num_exclaim": count_found(B, "!"),
    "body_num_question": count_found(B, r"\?"),
    "body_percent_caps": (
        f"(length({B}) - length(regexp_replace({B}, '[{UPPER}]+', '', 'g'))) / greatest(length({B}), 1)::DOUBLE"),
    "contains_html": f"CAST(regexp_matches({B}, '<[^>]+>') AS INT)",
}
LINK_SQL = {
    "num_urls": "CAST(CASE WHEN links = 'none' THEN 0 ELSE len(string_split(links, ';')) END AS INT)",
    "has_suspicious_url": f"CAST(regexp_matches(links, '{fixed.SUSPICIOUS_URL}') AS INT)",
}
PARTS_SQL = {
    "year": "CAST(year(date) AS INT)", "month": "CAST(month(date) AS INT)", "day": "CAST(day(date) AS INT)",
    "hour": "CAST(hour(date) AS INT)", "weekday": "CAST(isodow(date) - 1 AS INT)",
}
TIME_OF_DAY = (
    "CASE WHEN hour IS NULL THEN 'unknown' WHEN hour >= 6 AND hour < 12 THEN 'morning' "
    "WHEN hour >= 12 AND hour < 18 THEN 'afternoon' WHEN hour >= 18 AND hour < 22 THEN 'evening' ELSE 'night' END"
)
DERIVED_SQL = {
    "is_weekend": "CAST(weekday IN (5, 6) AS INT)",
    "time_of_day": TIME_OF_DAY,
    "subject_body_ratio": f"length({S}) / (length({B}) + 1)::DOUBLE",
    "urgency_score": keywords(f"lower({S})", fixed.URGENCY_BATCH),
    "financial_score": keywords(f"lower({B})", fixed.FINANCIAL_BATCH),
}


def address_sql(a: str) -> tuple[str, str]:
    unknown = f"{a} IS NULL OR {a} = 'unknown'"
    return (
        f"CASE WHEN {unknown} THEN 'unknown' ELSE lower(string_split({a}, '@')[-1]) END",
        f"CASE WHEN {unknown} THEN 'unknown' ELSE sha256({a}) END",
    )


def columns(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in parts.items())


FEATURE_SQL = {**SUBJECT_SQL, **BODY_SQL, **LINK_SQL, **DERIVED_SQL}


def featured_ctes() -> str:
    """``emails`` -> ``prepared`` (links, date parts) -> ``featured``; no rows are dropped."""
    return (
        f"{emails_cte()}, "
        f"prepared AS (SELECT * REPLACE ({LINKS} AS links), {columns(PARTS_SQL)} FROM emails), "
        f"featured AS (SELECT *, {address_sql('sender')[0]} AS sender_domain, "
        f"{address_sql('receiver')[0]} AS receiver_domain, {columns(FEATURE_SQL)} FROM prepared)"
    )


def with_emails(select: str) -> str:
    return f"WITH {emails_cte()} {select}"


def with_features(select: str) -> str:
    return f"WITH {featured_ctes()} {select}"
