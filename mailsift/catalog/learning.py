"""Classifier training and evaluation on the engineered mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.inputs import app_features, app_points
from mailsift.catalog.registry import query, with_emails
from mailsift.operators import metrics, models, prep
from mailsift.session import scratch_path
from mailsift.sources import sinks


def prepared(spark, folder, columns=None) -> models.Prepared:
    return models.Prepared(app_features(spark, folder), columns or fixed.APP_FEATURES)


def _one(name: str):
    def run(spark, folder):
        data = prepared(spark, folder)
        _, found = models.train_suite(data, [name])
        return found
    return run


query("logistic_regression")(_one("Logistic Regression"))
query("rbf_svm")(_one("SVM"))
query("random_forest")(_one("Random Forest"))
query("boosted_trees")(_one("Boosted Trees"))


SMOTE_SQL = f"""
, sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top, min(count(*)) OVER () AS low FROM emails GROUP BY label)
SELECT label, false AS synthetic, n FROM sizes
UNION ALL SELECT label, true, top - n FROM sizes WHERE n < top AND low / top::DOUBLE < {fixed.IMBALANCE_GATE}"""


@query("smote", with_emails(SMOTE_SQL))
def _(spark, folder):
    points = app_points(spark, folder).withColumnRenamed("id", "email_id")
    return prep.balance_by_synthesis(points, "x").groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("train_suite")
def _(spark, folder):
    _, found = models.train_suite(prepared(spark, folder), ["Logistic Regression", "SVM", "Random Forest", "Boosted Trees"])
    return metrics.comparison(found)


@query("feature_importance")
def _(spark, folder):
    data = prepared(spark, folder)
    return models.feature_importance(models.fit_classifier("Random Forest", data.train), data.columns, spark)


@query("cross_validation")
def _(spark, folder):
    return models.cross_validate(prepared(spark, folder), list(models.REGISTRY))


@query("holdout_test")
def _(spark, folder):
    data = prepared(spark, folder)
    names = list(models.REGISTRY)
    fitted, found = models.train_suite(data, names)
    best = models.best_model(metrics.weighted_metrics(found, ["model"]), names)
    return metrics.comparison(models.predict(fitted[best], data.part("test"), best))


@query("model_roundtrip")
def _(spark, folder):
    """A saved pipeline gives the same scores after loading, from raw feature columns on."""
    data = prepared(spark, folder)
    model = data.pipeline(models.fit_classifier("Logistic Regression", data.train))
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    return models.predict(sinks.load_model(path), data.split, "Logistic Regression")
