"""Splits, scaling, fits and privacy: parities and invariants."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailsift.operators import accounting, cluster_metrics, logistic, metrics, models, prep, privacy, profiling
from mailsift.functions import seeded


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.5, -2.0, 0.5] + rng.normal(size=n) > 0.9).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows()
    return spark.createDataFrame(
        [(i, int(y[i]), *map(float, x[i])) for i in range(len(y))], "email_id bigint, label int, a double, b double, c double"
    ).persist()


@pytest.fixture(scope="module")
def data(table):
    return models.Prepared(table, ["a", "b", "c"])


def test_split_is_exact(table):
    counts = {(r["label"], r["split"]): r["n"] for r in prep.stratified_split(
        table, {"train": 0.7, "val": 0.15, "test": 0.15}).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label in (0, 1):
        n = sum(v for (l, _), v in counts.items() if l == label)
        assert counts[(label, "train")] == math.floor(n * 0.7 + 0.5)


def test_one_huge_class_splits_without_its_own_task(spark):
    df = spark.range(5000).select(F.col("id").alias("email_id"), (F.col("id") < 7).cast("int").alias("label"))
    counts = {r["split"]: r["count"] for r in prep.stratified_split(df, {"train": 0.8, "test": 0.2}).groupBy("split").count().collect()}
    assert counts == {"train": 4000, "test": 1000} or abs(counts["train"] - 4000) <= 1


def test_scaled_train_has_zero_mean_unit_deviation(data):
    x = np.array([r[0].toArray() for r in data.part("train").select(models.FEATURES).collect()])
    assert np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 1, atol=1e-9)


def test_balanced(data):
    assert data.train.groupBy("label").count().select("count").distinct().count() == 1


def test_newton_equals_mllib(spark):
    x, y = rows()
    df = spark.createDataFrame([(Vectors.dense(a), [float(v) for v in a], int(b)) for a, b in zip(x, y)], ["features", "x", "label"])
    w = privacy.plain_fit(df)
    m = LogisticRegression(regParam=1 / len(y), standardization=False, maxIter=1000, tol=1e-12).fit(df)
    assert np.allclose(w, np.append(m.coefficients.toArray(), m.intercept), atol=1e-5)


def test_auc_equals_evaluator(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(round(p, 1)), int(l)) for p, l in zip(rng.random(500), rng.integers(0, 2, 500))], "probability double, label int")
    got = metrics.roc_auc(df).head()[0]
    e = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(got - e) < 1e-9


def test_squared_silhouette_equals_evaluator(table):
    points = table.select(F.array("a", "b", "c").alias("x"), "label").withColumn("cluster", F.col("label"))
    got = cluster_metrics.silhouette_squared(points).head()[0]
    e = ClusteringEvaluator(featuresCol="v", predictionCol="cluster").evaluate(points.withColumn("v", array_to_vector("x")))
    assert abs(got - e) < 1e-9


def test_classifiers_learn(data):
    names = ["Logistic Regression", "SVM", "Random Forest"]
    fitted, found = models.train_suite(data, names + ["no such model"])
    table = metrics.comparison(found, digits=None).toPandas().set_index("model")
    assert set(table.index) == set(names) and (table.f1 > 0.8).all() and (table.roc_auc > 0.9).all()
    tops = models.feature_importance(fitted["Random Forest"], data.columns, found.sparkSession)
    assert tops.head()["feature"] == "b"


def test_saved_pipeline_scores_raw_columns(data, tmp_path):
    from mailsift.sources import sinks
    model = data.pipeline(models.fit_classifier("SVM", data.train))
    sinks.save_model(model, str(tmp_path / "m"))
    again = models.predict(sinks.load_model(str(tmp_path / "m")), data.split, "SVM")
    first = models.predict(model, data.split, "SVM")
    assert again.exceptAll(first).count() == 0


def test_cosines_approach_the_kernel(spark):
    df = spark.createDataFrame([(Vectors.dense([0.1 * i, 1.0 - 0.05 * i]),) for i in range(20)], ["s"])
    t = models.RandomFourierFeatures(inputCol="s", outputCol="z", gamma=0.5, width=8000)
    z = np.array([r["z"].toArray() for r in t.transform(df).collect()])
    x = np.array([r["s"].toArray() for r in df.collect()])
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.06


def test_cross_validation(data):
    r = models.cross_validate(data, ["Logistic Regression"], 3).head()
    assert 0.8 < r["mean"] <= 1 and 0 <= r["spread"] < 0.2


def test_folds_leave_the_training_part_alone(table, monkeypatch):
    """Folds scale and balance their own rows, so the balanced training part is not made for them."""
    made, asked = [], prep.balance_by_synthesis
    monkeypatch.setattr(prep, "balance_by_synthesis", lambda *a, **k: made.append(1) or asked(*a, **k))
    data = models.Prepared(table, ["a", "b", "c"])
    assert not made
    assert models.cross_validate(data, ["Logistic Regression"], 2).count() == 1 and len(made) == 2
    assert data.train.count() and len(made) == 3 and data.train is data.train


def test_stages_after_a_fit_read_held_rows(data, monkeypatch):
    """The curve on the margins is fitted without going through cosines and machine again; scores are those of a pipeline."""
    held, keep = [], models.keep
    monkeypatch.setattr(models, "keep", lambda df: held.append(df.columns) or keep(df))
    stages = models.rbf_svm(data.train, data.train.count())
    whole = models.Pipeline(stages=stages).fit(data.train)
    ours = models.fit_classifier("SVM", data.train)
    assert held == [["label", "margin"]]
    got, want = ({r["email_id"]: r["probability"] for r in models.predict(m, data.part("val"), "SVM").collect()} for m in (ours, whole))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_noise_differs_within_an_order(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.lit(0.0).alias("v"))
    noisy = privacy.laplace_noise(lines, ["v"], 0.5, ["l_orderkey", "l_linenumber"])
    spreads = noisy.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"))
    assert spreads.where("n <> d").count() == 0


def test_laplace_draws(spark):
    df = spark.range(20000).withColumn("v", F.lit(0.0))
    r = privacy.laplace_noise(df, ["v"], 0.5, "id").agg(F.avg("v"), F.var_pop("v")).head()
    assert abs(r[0]) < 0.1 and abs(r[1] - 8.0) < 0.6


def test_rows_are_clipped(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.3, 0.4],)], "x array<double>")
    got = [r[0] for r in df.select(privacy.clipped(F.col("x"), 1.0)).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0.3, 0.4]])


def test_more_budget_costs_less(table):
    arrays = table.select("email_id", "label", F.array("a", "b", "c").alias("x"))
    split = prep.stratified_split(arrays, {"train": 0.8, "test": 0.2})
    train, test = split.where("split='train'").persist(), split.where("split='test'").persist()
    loss = {0.1: [], 1000.0: []}
    for seed in range(5):
        for r in privacy.epsilon_sweep(train, test, [0.1, 1000.0], norm=3.0, seed=seed).collect():
            loss[r["epsilon"]].append(r["loss_pct"])
    assert np.median(loss[1000.0]) <= np.median(loss[0.1]) and np.median(loss[1000.0]) < 5


def test_organisations_average(table):
    arrays = table.select("email_id", "label", F.array("a", "b", "c").alias("x"))
    got = {r["who"]: r["accuracy"] for r in privacy.averaged(arrays, arrays).collect()}
    assert len(got) == 6 and got["averaged"] > 0.85
    placed, w = privacy.organisation_fits(arrays)
    one = placed.where("org_id = 2")
    assert np.allclose(privacy.plain_fit(one), w[2], atol=1e-6)


def test_linear_noise_term_moves_the_optimum(spark):
    x, y = rows(200)
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, label int")
    goal = logistic.Objective(200, 0.1, np.array([0.2, 0.0, -0.1]), np.ones(3))
    w = logistic.fit(df, [goal], own_model=False)[0]
    s = np.where(y == 1, 1.0, -1.0)
    g = -(s / (1 + np.exp(s * (x @ w)))) @ x / 200 + 0.1 * w + goal.linear
    assert np.abs(g).max() < 1e-6


def test_uniform_is_open_and_even(spark):
    r = spark.range(20000).select(seeded.uniform("t", F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).head()
    assert 0 < r[0] < 0.001 and 0.999 < r[1] < 1 and abs(r[2] - 0.5) < 0.01


def test_constant_column_has_no_correlation(table):
    got = {(r["x"], r["y"]): r["r"] for r in profiling.correlations(table.withColumn("k", F.lit(1.0)), ["a", "k"]).collect()}
    assert got[("a", "k")] is None and abs(got[("a", "a")] - 1) < 1e-12


def test_sketches_of_days_merge_for_any_range(spark):
    rows = spark.range(40000).select((F.col("id") % 10).alias("day"), F.when(F.col("id") % 7 > 0, F.col("id") % 9001).alias("v"))
    daily = profiling.distinct_sketches(rows, ["v"], ["day"])
    assert daily.count() == 10
    for days in (range(10), (2, 3), (7,)):
        part = rows.where(F.col("day").isin(*days))
        exact = part.select("v").distinct().where("v IS NOT NULL").count()
        merged = profiling.merged_distinct(daily.where(F.col("day").isin(*days))).head()["n_distinct"]
        assert abs(merged - exact) <= 0.05 * exact
        assert merged == profiling.merged_distinct(profiling.distinct_sketches(part, ["v"], [])).head()["n_distinct"]


def test_budget_adds_up(spark):
    books = accounting.Accountant(1.0)
    books.charge("a", 0.3)
    books.charge_disjoint("parts", [0.1, 0.4])
    assert [tuple(r) for r in books.table(spark).collect()] == [("a", 0.3, 0.3), ("parts", 0.4, 0.7)]
    for wrong in (0.31, 0.0, float("nan")):
        with pytest.raises(ValueError):
            books.charge("b", wrong)
    assert abs(books.total - 0.7) < 1e-12


def test_private_scaling(spark):
    """Bounds fit the values, moments are near the true ones, and their noise has the stated scale."""
    df = spark.range(20000).select(F.array(
        seeded.uniform("a", F.col("id")) * 100, seeded.uniform("b", F.col("id")) - 0.5, F.lit(float("nan"))).alias("x"))
    books = accounting.Accountant()
    scaling = accounting.private_scaling(df, 3, 3.0, books)
    assert abs(books.total - 3.0) < 1e-12
    assert [p[0] for p in scaling.parts] == [128.0, 0.5, 2.0 ** accounting.LEAST_POWER]
    assert abs(scaling.parts[0][1] - 50) < 2 and abs(scaling.parts[0][2] - 28.9) < 2
    m = scaling.apply(df).agg(F.avg(F.get("x", F.lit(0))), F.stddev_pop(F.get("x", F.lit(1)))).head()
    assert abs(m[0]) < 0.1 and abs(m[1] - 1) < 0.1
    zero = spark.range(10).select(F.array(*[F.lit(0.0)] * 400).alias("x"))
    noise = [r["mean"] * 10 for r in accounting.private_moments(zero, [1e6] * 400, 1200.0).collect()]
    shares = np.array(noise) / 1e6
    assert abs(np.abs(shares).mean() - 1.0) < 0.2
    empty = accounting.private_moments(df.limit(0), [1.0, 1.0, 1.0], 1.0)
    assert empty.count() == 0 and accounting.Scaling([1.0], empty).parts == [(1.0, 0.0, 1.0)]


def test_sweep_with_its_whole_cost(table):
    raw = table.select("email_id", "label", F.array(F.col("a") * 7 + 3, "b", "c").alias("x"))
    split = prep.stratified_split(raw, {"train": 0.8, "test": 0.2}).persist()
    train, test = split.where("split='train'"), split.where("split='test'")
    got = privacy.accounted_sweep(train, test, [100.0, 200.0], scaling=50.0).orderBy("epsilon").collect()
    assert [(r.epsilon_total, r.epsilon_published) for r in got] == [(150.0, 150.0), (250.0, 350.0)]
    assert all(r.accuracy > 0.8 for r in got)
    with pytest.raises(ValueError):
        privacy.accounted_sweep(train, test, [100.0, 200.0], scaling=50.0, budget=349.0)


def test_rounds_reach_the_pooled_optimum(table):
    """Organisations of very different sizes and mixes: one holds four rows, one nearly one class only, one nothing."""
    rows = table.select("email_id", "label", F.array("a", "b", "c").alias("x"), F.expr(
        "CASE WHEN email_id < 4 THEN 0 WHEN label = 1 AND email_id % 10 > 0 THEN 1 WHEN a > 1 THEN 2 ELSE 3 END").alias("org_id"))
    weights, rounds = privacy.averaging_rounds(rows, 5, tolerance=1e-8)
    assert np.allclose(weights, privacy.plain_fit(rows), atol=1e-5)
    table_ = rounds.orderBy("round").collect()
    assert table_[-1]["gradient"] < 1e-8 and table_[-1]["loss"] <= table_[0]["loss"]
    with pytest.raises(RuntimeError):
        privacy.averaging_rounds(rows, 5, tolerance=1e-8, max_rounds=2)
