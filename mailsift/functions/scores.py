"""Keyword scores, threat levels, privacy bands and verdicts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from mailsift import fixed


def keyword_score(lowered: Column, words: list[str]) -> Column:
    """How many different words of the list occur anywhere in the (lower-case) text."""
    return reduce(add, [F.contains(lowered, F.lit(w)).cast("int") for w in words])


def threat_level(p: Column) -> Column:
    out = None
    for least, name in fixed.THREAT_LEVELS:
        out = F.when(p >= least, name) if out is None else out.when(p >= least, name)
    return out.otherwise(fixed.THREAT_FLOOR)


def privacy_band(epsilon: Column) -> Column:
    return F.when(epsilon < 1, "Strong").when(epsilon <= 2, "Medium").otherwise("Weak")


def cost_verdict(loss: Column) -> Column:
    return F.when(loss < 5, "good").when(loss < 10, "acceptable").otherwise("high cost")


def accuracy_verdict(acc: Column) -> Column:
    return (
        F.when(acc > 0.95, "excellent").when(acc > 0.90, "strong")
        .when(acc > 0.85, "good").otherwise("needs improvement")
    )


def key_factors(columns: dict[str, str] | None = None, top: int = 5) -> Column:
    """Positive scores of one email, highest first; equal scores keep the listed order."""
    named = list(columns.items()) if columns else fixed.KEY_FACTORS
    entries = F.array(*[
        F.struct(
            (-F.col(c).cast("double")).alias("neg"), F.lit(i).alias("pos"),
            F.lit(n).alias("factor"), F.col(c).cast("double").alias("score"),
        )
        for i, (n, c) in enumerate(named)
    ])
    positive = F.filter(entries, lambda e: e["score"] > 0)
    return F.slice(F.array_sort(positive), 1, top)
