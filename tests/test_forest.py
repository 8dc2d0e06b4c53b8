"""Forests whose lower levels are grown apart from the driver."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailsift.operators import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    """Noisy labels, so whole trees have a leaf for every few rows; a tenth of the rows are copies of one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4)).round(2)
    x[::10] = 0.25
    y = (x @ [1.5, -2.0, 0.5, 0.0] + rng.normal(size=3000) > 0).astype(float)
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["email_id", models.FEATURES, "label"]).repartition(4, "email_id").persist()


@pytest.fixture()
def large(monkeypatch):
    monkeypatch.setattr(forest, "WHOLE_ROWS", 1000)
    monkeypatch.setattr(forest, "LEAF_ROWS", 500)


def scores(model, rows):
    return {r["email_id"]: (r["p"], r["prediction"]) for r in model.transform(rows).select(
        "email_id", models.vector_to_array("probability")[1].alias("p"), "prediction").collect()}


def test_driver_holds_upper_levels_only(rows, large, tmp_path):
    fitted = models.fit_classifier("Random Forest", rows.where("email_id < 2500"))
    model = fitted.stages[-1]
    assert isinstance(model, forest.DeepForestModel)
    assert model.head.totalNumNodes <= forest.TREES * 2 ** (forest.upper_depth(2500) + 1)
    assert model.subtrees(rows.sparkSession).selectExpr("sum(length(feature))").head()[0] > 5 * model.head.totalNumNodes
    got = scores(fitted, rows)
    plain = scores(Pipeline(stages=[forest.whole_trees(models.FEATURES)]).fit(rows.where("email_id < 2500")), rows)
    labels = dict(rows.select("email_id", "label").collect())
    late = [i for i in labels if i >= 2500]
    right = [np.mean([s[i][1] == labels[i] for i in late]) for s in (got, plain)]
    assert len(got) == 3000 and abs(right[0] - right[1]) < 0.03
    assert np.mean([abs(got[i][0] - plain[i][0]) for i in late]) < 0.06
    assert len({got[i] for i in range(0, 3000, 10)}) == 1  # copies
    assert np.allclose(model.featureImportances.toArray().sum(), 1) and model.featureImportances.toArray().argmax() == 1
    fitted.write().save(str(tmp_path / "m"))
    assert scores(PipelineModel.load(str(tmp_path / "m")), rows) == got


def test_leaves_of_one_partition_are_dealt_out(rows, large):
    """Folds hold small tables in one partition; their leaves are grown by many tasks all the same."""
    fitted = models.fit_classifier("Random Forest", rows.coalesce(1).persist())
    assert len(fitted.stages[-1].subtrees(rows.sparkSession).inputFiles()) > 1


@pytest.mark.parametrize("width", [1, 7, 8, 13, 17])
def test_distinct_byte_rows(width):
    rng = np.random.default_rng(width)
    rows = rng.integers(0, 2, (300, width)).astype(np.uint8) * rng.choice([1, 128, 255], width).astype(np.uint8)
    got, want = forest.distinct_rows(rows), np.unique(rows, axis=0, return_counts=True)
    assert all((g == w).all() for g, w in zip(got, want)) and got[0].dtype == np.uint8


def test_repeated_and_null_keys_are_scored_as_rows(rows, large):
    fitted = models.fit_classifier("Random Forest", rows)
    twice = rows.limit(50).withColumn("email_id", F.lit(None).cast("bigint"))
    out = fitted.transform(twice.unionByName(twice))
    assert out.count() == 100 and out.where("prediction IS NULL").count() == 0


def test_small_tables_are_left_to_mllib(rows):
    assert forest.upper_depth(3000) == forest.DEPTH
    assert not isinstance(models.fit_classifier("Random Forest", rows.limit(200)).stages[-1], forest.DeepForestModel)


def test_a_grown_tree_knows_its_rows():
    """Without noise a full tree repeats its labels, and a label that needs two features is found."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (400, 4)).astype(np.uint8)
    ones = ((bins[:, 0] > 3) ^ (bins[:, 1] > 3)).astype(float)
    feature, cut, child, chance, gains = forest.grow(bins, ones, np.ones(400), 30, rng)
    assert (chance[forest.walk(bins, feature, cut, child)] == ones).all() and gains[:2].sum() > gains[2:].sum()
