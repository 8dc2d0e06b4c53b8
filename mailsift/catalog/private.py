"""Noise, private fits, averaged fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.inputs import app_features, app_points, predictions, predictions_ctes
from mailsift.catalog.registry import laplace, query, r, rounded
from mailsift.operators import accounting, metrics, prep, privacy
from mailsift.session import cut_lineage
from mailsift.sources import table


@query("laplace_noise", "WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, "
       "row_number() OVER (PARTITION BY doc_id, n_chars) - 1 AS copy FROM documents) SELECT doc_id, "
       + r(f"n_chars + {laplace('noise-n_chars', 1.0, 'doc_id', 'n_chars', 'copy')}") + " AS n_chars FROM d")
def _(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return rounded(privacy.laplace_noise(df, ["n_chars"], 1.0, "doc_id"))


@query("laplace_noise_lineitem", "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, "
       "row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_quantity) - 1 AS copy FROM lineitem) "
       "SELECT l_orderkey, l_linenumber, " + r(
           f"l_quantity + {laplace('noise-l_quantity', 2.0, 'l_orderkey', 'l_linenumber', 'l_quantity', 'copy')}") + " AS l_quantity FROM l")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(privacy.laplace_noise(df, ["l_quantity"], 0.5, ["l_orderkey", "l_linenumber"]))


def _parts(spark, folder):
    points = app_points(spark, folder).withColumnRenamed("id", "email_id")
    split = cut_lineage(prep.stratified_split(points, {"train": 0.8, "test": 0.2}))
    return split.where("split = 'train'"), split.where("split = 'test'")


@query("dp_logreg")
def _(spark, folder):
    train, test = _parts(spark, folder)
    fits = privacy.private_fits(train, [1.0])
    return privacy.score_linear(test, {str(e): w for e, w in fits.items()})


@query("epsilon_sweep")
def _(spark, folder):
    return privacy.epsilon_sweep(*_parts(spark, folder))


@query("epsilon_recommended")
def _(spark, folder):
    return privacy.recommend(privacy.epsilon_sweep(*_parts(spark, folder)))


@query("federated_avg")
def _(spark, folder):
    return privacy.averaged(*_parts(spark, folder))


@query("privacy_compare")
def _(spark, folder):
    train, test = _parts(spark, folder)
    plain = metrics.weighted_metrics(privacy.score_linear(test, {"baseline": privacy.plain_fit(train)}), ["model"])
    avg = privacy.averaged(train, test).where("who = 'averaged'")
    return privacy.compare_methods(
        privacy.epsilon_sweep(train, test), plain.select("accuracy").scalar(), avg.select("accuracy").scalar())


@query("accuracy_loss", f"""WITH {predictions_ctes()}, a AS (SELECT model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM predictions GROUP BY 1)
SELECT model, {r("((SELECT accuracy FROM a WHERE model = 'c') - accuracy) * 100")} AS loss_pct FROM a""")
def _(spark, folder):
    t = metrics.binary_metrics(predictions(spark, folder), ["model"]).select("model", "accuracy")
    base = t.where("model = 'c'").select("accuracy").scalar()
    return rounded(t.withColumn("base", base).select(
        "model", privacy.accuracy_loss(F.col("base"), F.col("accuracy")).alias("loss_pct")))


_SPENT = 1.0


def _moment_sql(i: int, column: str, bound: float) -> str:
    clip = f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {column}::DOUBLE / {bound}::DOUBLE))"
    return (f"SELECT {i} AS i, {bound}::DOUBLE AS bound, count(*) AS n, sum({clip}) + {laplace('moments-sum', 9.0 / _SPENT, str(i))} AS s, "
            f"sum({clip} * {clip}) + {laplace('moments-square', 9.0 / _SPENT, str(i))} AS q FROM lineitem")


_CLIPPED = {"l_quantity": 32.0, "l_extendedprice": 65536.0, "l_discount": 0.125}


@query("private_moments", "WITH s AS (" + " UNION ALL ".join(_moment_sql(i, c, b) for i, (c, b) in enumerate(_CLIPPED.items()))
       + "), m AS (SELECT i, bound, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s / n)) AS m, q / n AS v FROM s) SELECT CAST(i AS INT) AS i, "
       + r("m * bound", 4) + " AS mean, " + r("sqrt(greatest(1e-12::DOUBLE, v - m * m)) * bound", 4) + " AS spread FROM m")
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.array(*[F.col(c).cast("double") for c in _CLIPPED]).alias("x"))
    return rounded(accounting.private_moments(lines, list(_CLIPPED.values()), _SPENT), 4)


def _raw_parts(spark, folder):
    features = app_features(spark, folder).select(
        "email_id", "label", F.array(*[F.col(c).cast("double") for c in fixed.APP_FEATURES]).alias("x"))
    split = cut_lineage(prep.stratified_split(features, {"train": 0.8, "test": 0.2}))
    return split.where("split = 'train'"), split.where("split = 'test'")


@query("accounted_sweep")
def _(spark, folder):
    return privacy.accounted_sweep(*_raw_parts(spark, folder))


@query("averaging_rounds")
def _(spark, folder):
    train, _ = _parts(spark, folder)
    placed = prep.contiguous_parts(train, fixed.N_ORGANISATIONS, "email_id")
    return privacy.averaging_rounds(placed, fixed.N_ORGANISATIONS)[1]
