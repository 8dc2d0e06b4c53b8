"""Several logistic fits in one pass per step.

MLlib fits one model per run. Here a step reads the rows once and returns, for every model, loss,
gradient and curvature: one short table per partition, summed by Spark. That serves a sweep of
privacy levels (all models see all rows) and per-organisation fits (each row belongs to one model).
The driver only ever holds (d+1)^2 numbers per model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass
class Objective:
    """Mean log loss + l2/2 |w|^2 (over penalised coordinates) + linear . w"""

    n: int
    l2: float
    linear: np.ndarray
    penalise: np.ndarray


def step_sums(rows: DataFrame, weights: np.ndarray, own_model: bool) -> dict[int, np.ndarray]:
    """Per model: summed loss, gradient and curvature at ``weights`` (models x coordinates)."""
    models, d = weights.shape

    def partial(batches):
        total = np.zeros((models, 1 + d + d * d))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            sign = np.where(pdf["label"].to_numpy() == 1, 1.0, -1.0)
            group = pdf["model"].to_numpy() if own_model else None
            for m in range(models):
                xm, sm = (x[group == m], sign[group == m]) if own_model else (x, sign)
                if not len(xm):
                    continue
                z = sm * (xm @ weights[m])
                miss = 0.5 * (1.0 - np.tanh(0.5 * z))      # 1 / (1 + exp(z)), no overflow
                total[m, 0] += np.logaddexp(0.0, -z).sum()
                total[m, 1:1 + d] += -(sm * miss) @ xm
                total[m, 1 + d:] += ((xm * (miss * (1 - miss))[:, None]).T @ xm).ravel()
        yield pd.DataFrame({
            "model": np.repeat(np.arange(models), total.shape[1]).astype("int32"),
            "at": np.tile(np.arange(total.shape[1]), models).astype("int32"),
            "v": total.ravel()})

    columns = ["x", "label"] + (["model"] if own_model else [])
    sums = rows.select(*columns).mapInPandas(partial, "model int, at int, v double")
    out = {m: np.zeros(1 + d + d * d) for m in range(models)}
    for r in sums.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():
        out[r["model"]][r["at"]] = r["v"]
    return out


def fit(rows: DataFrame, objectives: list[Objective], own_model: bool, max_steps: int = 100,
        tolerance: float = 1e-8) -> np.ndarray:
    """Damped Newton for all models at once. ``rows``: x array<double>, label, and model if owned."""
    models, d = len(objectives), len(objectives[0].linear)
    best = np.zeros((models, d))
    trial = best.copy()
    value = np.full(models, np.inf)
    step = np.zeros((models, d))
    done = np.zeros(models, dtype=bool)
    for _ in range(max_steps):
        sums = step_sums(rows, trial, own_model)
        for m, o in enumerate(objectives):
            if done[m]:
                continue
            s, w = sums[m] / o.n, trial[m]
            pen = o.l2 * o.penalise * w
            now = s[0] + 0.5 * float(pen @ w) + float(o.linear @ w)
            if now > value[m] + 1e-12 * abs(value[m]):
                step[m] /= 2
                done[m] = np.abs(step[m]).max() < tolerance
                trial[m] = best[m] + step[m]
                continue
            best[m], value[m] = w, now
            gradient = s[1:1 + d] + pen + o.linear
            curve = s[1 + d:].reshape(d, d) + np.diag(o.l2 * o.penalise) + 1e-12 * np.eye(d)
            step[m] = -np.linalg.solve(curve, gradient)
            done[m] = np.abs(gradient).max() < tolerance
            trial[m] = best[m] if done[m] else best[m] + step[m]
        if done.all():
            return best
    raise RuntimeError(f"no optimum within {max_steps} steps")
