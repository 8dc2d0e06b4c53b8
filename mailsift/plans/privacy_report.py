"""Baseline, privacy sweep, averaged organisations and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift import fixed
from mailsift.operators import cleaning, metrics, models, prep, privacy
from mailsift.session import cut_lineage


def privacy_report(engineered: DataFrame, columns: list[str] | None = None, seed: int = fixed.SEED) -> dict[str, DataFrame]:
    columns = columns or cleaning.numeric_columns(engineered)
    data = models.Prepared(engineered, columns, {"train": 0.8, "test": 0.2}, balance=False)
    train, test = (cut_lineage(privacy.as_array(data.part(p), models.FEATURES)) for p in ("train", "test"))
    sweep = cut_lineage(privacy.epsilon_sweep(train, test, seed=seed))
    plain = metrics.weighted_metrics(privacy.score_linear(test, {"baseline": privacy.plain_fit(train)}), ["model"])
    averaged = cut_lineage(privacy.averaged(train, test))
    return {
        "baseline": plain, "sweep": sweep, "recommended": privacy.recommend(sweep), "averaged": averaged,
        "sizes": prep.group_sizes(data.split, "split"),
        "comparison": privacy.compare_methods(
            sweep, plain.select("accuracy").scalar(),
            averaged.where(F.col("who") == "averaged").select("accuracy").scalar()),
    }
