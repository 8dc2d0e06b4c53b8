"""Privacy: noise on values, private logistic regression, parameter averaging, comparison."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from mailsift import fixed
from mailsift.functions import scores, seeded
from mailsift.operators import accounting, logistic, metrics, prep
from mailsift.session import keep


#: Equal rows that one step of a task lists at once.
COPIES_AT_ONCE = 4096


def laplace_noise(df: DataFrame, columns: list[str], epsilon: float = 1.0, key: str | list[str] = "email_id",
                  seed: str = "noise") -> DataFrame:
    """Laplace noise of scale 1/epsilon on each value; each value has its own draw.

    Draws depend on the seed, the key, the row's other values and, among equal rows, a running number, so rows that share a
    key or even all values never share the noise, and a task run again draws the same. Equal rows are counted before
    the shuffle and listed again afterwards: neither a key nor a row that is very common meets in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    at = lambda c: F.col(f"`{c}`")
    own = [F.coalesce(at(c).cast("string"), F.lit("\\N")) for c in [*keys, *(c for c in df.columns if c not in keys)]]
    scale = 1.0 / max(epsilon, fixed.MIN_NOISE_EPSILON)
    n, lot, copy = (f"_{w}{len(df.columns)}{max(df.columns, key=len)}" for w in ("n", "lot", "copy"))
    counted = df.groupBy(*[at(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(n))
    lots = counted.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("bigint"), at(n) - 1, F.lit(COPIES_AT_ONCE).cast("bigint"))))
    rows = lots.withColumn(copy, F.explode(F.sequence(at(lot), F.least(at(n), at(lot) + COPIES_AT_ONCE) - 1)))
    noisy = {c: (at(c) + seeded.laplace(f"{seed}-{c}", scale, *own, at(copy))) for c in columns if c in df.columns}
    return rows.select(*[noisy[c].alias(c) if c in noisy else at(c) for c in df.columns])


# --- private logistic regression (objective perturbation) --------------------------------

def clipped(x: Column, norm: float) -> Column:
    """The vector, shortened to ``norm`` where it is longer."""
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(length > norm, F.transform(x, lambda v: v * (norm / length))).otherwise(x)


def perturbation(n: int, d: int, epsilon: float, norm: float, c: float, seed: int) -> logistic.Objective:
    """Noise term and extra penalty for rows of length at most ``norm`` and an intercept of 1.

    Rows are rescaled to length 1 first; 1/4 bounds the curvature of the log loss. The noise has a
    Gamma distributed length and a uniform direction.
    """
    reach = math.sqrt(norm * norm + 1.0)
    l2 = 1.0 / (c * n * reach * reach)
    curvature = 0.25
    left = epsilon - math.log(1 + 2 * curvature / (n * l2) + (curvature / (n * l2)) ** 2)
    extra = 0.0
    if left <= 0:
        extra = max(0.0, curvature / (n * math.expm1(epsilon / 4)) - l2)
        left = epsilon / 2
    rng = np.random.default_rng(seed)
    direction = rng.normal(size=d)
    noise = rng.gamma(d, 2.0 / left) * direction / np.linalg.norm(direction)
    return logistic.Objective(n, l2 + extra, noise / n, np.ones(d))


def private_fits(train: DataFrame, epsilons: list[float], norm: float = fixed.DATA_NORM, c: float = 1.0,
                 seed: int = fixed.SEED) -> dict[float, np.ndarray]:
    """Weights per epsilon (intercept last), all fitted in the same passes over the rows.

    ``train`` has x array<double> (scaled) and label. The column statistics used for scaling are
    not covered by epsilon. A published seed gives the noise away: pass a secret one in earnest.
    """
    reach = math.sqrt(norm * norm + 1.0)
    x = F.transform(F.concat(clipped(F.col("x"), norm), F.array(F.lit(1.0))), lambda v: v / reach)
    rows = keep(train.select(x.alias("x"), F.col("label").cast("int").alias("label")))
    n, d = rows.count(), len(rows.head()["x"])
    goals = [perturbation(n, d, e, norm, c, seed + i) for i, e in enumerate(epsilons)]
    weights = logistic.fit(rows, goals, own_model=False)
    return {e: w / reach for e, w in zip(epsilons, weights)}


def plain_fit(train: DataFrame, c: float = 1.0) -> np.ndarray:
    """The same learner without noise and without a penalty on the intercept."""
    rows = keep(train.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), F.col("label").cast("int").alias("label")))
    n, d = rows.count(), len(rows.head()["x"])
    goal = logistic.Objective(n, 1.0 / (c * n), np.zeros(d), np.append(np.ones(d - 1), 0.0))
    return logistic.fit(rows, [goal], own_model=False)[0]


def score_linear(df: DataFrame, weights: dict[str, np.ndarray], key: str = "email_id") -> DataFrame:
    """Predictions of several linear models in one pass: (key, model, label, prediction, probability)."""
    models = F.array(*[
        F.struct(F.lit(name).alias("model"),
                 F.array(*[F.lit(float(v)) for v in w[:-1]]).alias("w"), F.lit(float(w[-1])).alias("b"))
        for name, w in weights.items()
    ])
    rows = df.select(key, "label", "x", F.explode(models).alias("m"))
    z = F.aggregate(F.zip_with("x", "m.w", lambda a, b: a * b), F.col("m.b"), lambda s, v: s + v)
    return rows.select(
        key, F.col("m.model").alias("model"), F.col("label").cast("int").alias("label"),
        (z > 0).cast("int").alias("prediction"), (1 / (1 + F.exp(-z))).alias("probability"))


def epsilon_sweep(train: DataFrame, test: DataFrame, epsilons: list[float] | None = None,
                  norm: float = fixed.DATA_NORM, seed: int = fixed.SEED) -> DataFrame:
    """(epsilon, privacy, accuracy, precision, recall, f1, loss_pct), losses against the plain fit."""
    epsilons = epsilons or fixed.EPSILONS
    fits = {str(e): w for e, w in private_fits(train, epsilons, norm, seed=seed).items()}
    fits["baseline"] = plain_fit(train)
    table = metrics.weighted_metrics(score_linear(test, fits), ["model"])
    base = table.where("model = 'baseline'").select("accuracy").scalar()
    epsilon = F.col("model").cast("double")
    return table.withColumn("base", base).where("model <> 'baseline'").select(
        epsilon.alias("epsilon"), scores.privacy_band(epsilon).alias("privacy"),
        "accuracy", "precision", "recall", "f1", accuracy_loss(F.col("base"), F.col("accuracy")).alias("loss_pct"))


def accounted_sweep(train: DataFrame, test: DataFrame, epsilons: list[float] | None = None, scaling: float = 0.1,
                    norm: float = fixed.DATA_NORM, seed: int = fixed.SEED, budget: float | None = None) -> DataFrame:
    """The sweep on raw feature arrays ``x``, with all that it costs.

    Scaling is private as well and paid once. ``epsilon_total`` is the cost of publishing that level alone, scaling
    included; ``epsilon_published`` that of publishing all levels up to it. ``budget`` bounds the whole sweep. The losses
    are against the plain fit on the same scaling.
    """
    epsilons = sorted(epsilons or fixed.EPSILONS)
    books = accounting.Accountant(budget)
    d = len(train.select("x").head()["x"])
    scale = accounting.private_scaling(train, d, scaling, books, f"scaling-{seed}")
    published = {}
    for e in epsilons:
        books.charge(f"fit {e}", e)
        published[e] = books.total
    table = epsilon_sweep(scale.apply(train), scale.apply(test), epsilons, norm, seed)
    so_far = F.element_at(F.create_map(*[F.lit(v) for pair in published.items() for v in pair]), F.col("epsilon"))
    return table.select("epsilon", F.lit(scaling).alias("epsilon_scaling"), (F.col("epsilon") + scaling).alias("epsilon_total"),
                        so_far.alias("epsilon_published"), *[c for c in table.columns if c != "epsilon"])


def accuracy_loss(base: Column, accuracy: Column) -> Column:
    return (base - accuracy) * 100


def recommend(sweep: DataFrame, epsilon: float = 1.0) -> DataFrame:
    return sweep.where(F.col("epsilon") == epsilon).withColumn("verdict", scores.cost_verdict(F.col("loss_pct")))


# --- per-organisation fits, averaged -----------------------------------------------------

def organisation_fits(train: DataFrame, organisations: int = fixed.N_ORGANISATIONS, c: float = 1.0,
                      key: str = "email_id") -> tuple[DataFrame, np.ndarray]:
    """(rows with ``org_id``, weights per organisation); one pass per step serves all of them.

    Organisations are consecutive equal ranges of the key. Only weights leave an organisation.
    """
    placed = keep(prep.contiguous_parts(train.select(key, "x", "label"), organisations, key))
    sizes = {r["org_id"]: r["n"] for r in placed.groupBy("org_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    d = len(placed.head()["x"]) + 1
    free = np.append(np.ones(d - 1), 0.0)
    goals = []
    for o in range(organisations):
        n = max(sizes.get(o, 0), 1)
        goals.append(logistic.Objective(n, 1.0 / (c * n), np.zeros(d), free))
    rows = keep(placed.select(
        F.concat("x", F.array(F.lit(1.0))).alias("x"), F.col("label").cast("int").alias("label"),
        F.col("org_id").alias("model")))
    return placed, logistic.fit(rows, goals, own_model=True)


def averaged(train: DataFrame, test: DataFrame, organisations: int = fixed.N_ORGANISATIONS,
             key: str = "email_id") -> DataFrame:
    """(who, accuracy): each organisation on its own rows, then the averaged model on ``test``."""
    placed, weights = organisation_fits(train, organisations, key=key)
    local = score_linear(
        placed.withColumn("label", F.col("label").cast("int")).withColumn(key, F.struct(key, "org_id")),
        {f"org {o + 1}": w for o, w in enumerate(weights)}, key)
    mine = local.where(F.col("model") == F.concat(F.lit("org "), (F.col(f"{key}.org_id") + 1).cast("string")))
    everyone = score_linear(test, {"averaged": weights.mean(axis=0)}, key)
    return (
        metrics.weighted_metrics(mine, ["model"])
        .unionByName(metrics.weighted_metrics(everyone, ["model"]))
        .select(F.col("model").alias("who"), "accuracy")
    )


def averaging_rounds(train: DataFrame, organisations: int, c: float = 1.0, proximal: float = 0.01, tolerance: float = 1e-6,
                     max_rounds: int = 100) -> tuple[np.ndarray, DataFrame]:
    """(weights, round table) of averaging over rounds that start from the global weights.

    ``train`` has x, label and ``org_id`` (0 to ``organisations`` - 1, of any sizes). In a round every organisation
    starts from the global weights and answers the pooled gradient with a proximal step of its own fit: its curvature plus
    ``proximal`` holds it near the start. The steps are averaged by size, made conjugate to the round before, and taken
    as far as the curvatures along them say, one number an organisation. Averaging the organisations' own optima would
    settle beside the pooled one where they are uneven; these rounds stop only there. One pass over the rows serves all
    organisations; the driver holds (d+1)^2 numbers for each. A round that raises the loss is undone and taken half as far.
    The table has (round, loss, gradient, moved), one row a pass.
    """
    rows = keep(train.select(
        F.concat("x", F.array(F.lit(1.0))).alias("x"), F.col("label").cast("int").alias("label"),
        F.col("org_id").cast("int").alias("model")))
    sizes = np.zeros(organisations)
    for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["model"]] = r["n"]
    n, d = sizes.sum(), len(rows.head()["x"])
    l2 = np.append(np.full(d - 1, 1.0 / (c * n)), 0.0)
    present = [o for o in range(organisations) if sizes[o]]
    best, value, gradient, answer, way = np.zeros(d), math.inf, None, None, None
    trial, far, passes = best, 1.0, []
    for at in range(1, max_rounds + 1):
        sums = logistic.step_sums(rows, np.tile(trial, (organisations, 1)), own_model=True)
        total = sum(sums.values()) / n
        loss = total[0] + 0.5 * float(trial @ (l2 * trial))
        moved = float(np.abs(trial - best).max())
        if loss > value + 1e-12 * abs(value):
            far /= 2
        else:
            best, value = trial, loss
            last_gradient, last_answer, gradient = gradient, answer, total[1:1 + d] + l2 * trial
            curves = {o: sums[o][1 + d:].reshape(d, d) / sizes[o] + np.diag(l2) for o in present}
            answer = sum(sizes[o] / n * np.linalg.solve(curves[o] + proximal * np.eye(d), gradient) for o in present)
            bend = 0.0 if way is None else max(0.0, answer @ (gradient - last_gradient) / (last_answer @ last_gradient))
            way = -answer if way is None else bend * way - answer
            if way @ gradient >= 0:
                way = -answer
            along = sum(sizes[o] / n * float(way @ curves[o] @ way) for o in present)
            far = -float(gradient @ way) / max(along, 1e-300)
        largest = float(np.abs(gradient).max())
        passes.append((at, float(loss), largest, moved))
        if largest < tolerance:
            rows.unpersist()
            return best, train.sparkSession.createDataFrame(passes, "round int, loss double, gradient double, moved double")
        trial = best + far * way
    raise RuntimeError(f"the organisations did not settle in {max_rounds} rounds")


def compare_methods(sweep: DataFrame, baseline: float | Column, averaged_accuracy: float | Column) -> DataFrame:
    """(method, privacy, accuracy): plain, three privacy levels, averaged."""
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    private = sweep.where(F.col("epsilon").isin(0.5, 1.0, 2.0)).select(
        F.concat(F.lit("private epsilon "), F.col("epsilon").cast("string")).alias("method"), "privacy", "accuracy")
    one = sweep.sparkSession.range(1)
    plain = one.select(F.lit("baseline").alias("method"), F.lit("None").alias("privacy"), value(baseline).alias("accuracy"))
    avg = one.select(F.lit("averaged").alias("method"), F.lit("Strong").alias("privacy"),
                     value(averaged_accuracy).alias("accuracy"))
    return plain.unionByName(private).unionByName(avg)


def as_array(df: DataFrame, vector: str, key: str = "email_id") -> DataFrame:
    return df.select(key, "label", vector_to_array(vector).alias("x"))
