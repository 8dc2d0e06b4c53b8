"""What SQL can say about fitted things: which rows they score, and facts that hold on the whole result."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.clusters import PARTS
from mailsift.catalog.inputs import app_points, predictions, predictions_ctes
from mailsift.catalog.learning import prepared
from mailsift.catalog.measures import _order
from mailsift.catalog.private import _parts
from mailsift.catalog.registry import ORACLES, query, r, rounded
from mailsift.functions import scores
from mailsift.operators import cftree, clustering, metrics, models, prep, privacy
from mailsift.operators.cluster_metrics import centroids, squared
from mailsift.session import scratch_path
from mailsift.sources import sinks, table


def _names(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS m(model)"


def _valid():
    return F.col("probability").between(0, 1) & F.col("prediction").isin(0, 1)


@query("classifier_rows", f"SELECT model, email_id, label, true AS valid FROM ({ORACLES['stratified_split']}), "
                          f"{_names(list(models.REGISTRY))} WHERE split = 'val'")
def _(spark, folder):
    """Every classifier scores every row of the validation part once, with a probability."""
    _, found = models.train_suite(prepared(spark, folder), list(models.REGISTRY))
    return found.select("model", "email_id", "label", _valid().alias("valid"))


@query("cross_validation_rows", f"""WITH t AS (SELECT email_id, label FROM ({ORACLES['stratified_split']}) WHERE split = 'train'),
o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {_order('folds')}) AS i, count(*) OVER (PARTITION BY label) AS n FROM t),
f AS (SELECT label, CAST(CASE WHEN i <= n * 1 // 5 THEN 0 WHEN i <= n * 2 // 5 THEN 1 WHEN i <= n * 3 // 5 THEN 2
  WHEN i <= n * 4 // 5 THEN 3 ELSE 4 END AS INT) AS fold FROM o)
SELECT model, fold, label, count(*) AS n, true AS valid FROM f, {_names(list(models.REGISTRY))} GROUP BY ALL""")
def _(spark, folder):
    """Cross-validation scores every training row once a model, in its own fold, with a probability."""
    found = models.fold_predictions(prepared(spark, folder), list(models.REGISTRY))
    return found.groupBy("model", "fold", "label").agg(F.count_distinct("email_id").alias("n"), F.bool_and(_valid()).alias("valid"))


@query("roundtrip_rows", f"SELECT email_id, label, true AS same FROM ({ORACLES['stratified_split']})")
def _(spark, folder):
    """A saved pipeline scores every row as the fitted one does."""
    data = prepared(spark, folder)
    model = data.pipeline(models.fit_classifier("Logistic Regression", data.train))
    path = scratch_path(spark, "model")
    sinks.save_model(model, path)
    back = models.predict(sinks.load_model(path), data.split, "m").select("email_id", F.col("probability").alias("p"))
    return models.predict(model, data.split, "m").join(back, "email_id").select(
        "email_id", "label", (F.col("probability") == F.col("p")).alias("same"))


LEVELS = [str(e) for e in fixed.EPSILONS]


@query("private_rows", f"SELECT model, email_id, label, true AS valid FROM ({ORACLES['split_80_20']}), "
                       f"{_names(LEVELS + ['baseline'])} WHERE split = 'test'")
def _(spark, folder):
    """The plain fit and one for each privacy level score every test row."""
    train, test = _parts(spark, folder)
    fits = {str(e): w for e, w in privacy.private_fits(train, fixed.EPSILONS).items()}
    found = privacy.score_linear(test, {**fits, "baseline": privacy.plain_fit(train)})
    return found.select("model", "email_id", "label", _valid().alias("valid"))


@query("kmeans_facts", """SELECT count(*) AS n, CAST(5 AS BIGINT) AS clusters, true AS nearest, true AS centred FROM documents""")
def _(spark, folder):
    """Each point lies at its nearest centre, and centres are the means of their points."""
    points = app_points(spark, folder).select("id", "x")
    vectors = clustering.with_vector(points).persist()
    model = clustering.fit_kmeans(vectors, 5)
    found = model.transform(vectors).select("id", "x", "cluster")
    centres = F.array(*[F.lit([float(v) for v in c]) for c in model.clusterCenters()])
    apart = F.transform(centres, lambda c: squared(F.col("x"), c))
    rows = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"),
                     F.bool_and(F.get(apart, F.col("cluster")) <= F.array_min(apart) + 1e-9).alias("nearest"))
    means = centroids(found).agg(F.bool_and(F.sqrt(squared(F.col("centre"), F.get(centres, F.col("cluster")))) < 0.05).alias("centred"))
    return rows.withColumn("centred", means.scalar())


@query("pca_facts", "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS falling, true AS enough FROM documents")
def _(spark, folder):
    """Leading components have mean 0, no correlation, falling variance, and together 95 % of it."""
    points = app_points(spark, folder)
    scaled = points.select(F.col("id").alias("email_id"), "label", prep.array_to_vector("x").alias("scaled"))
    out, shares, kept = prep.pca(scaled)
    two = out.select(prep.vector_to_array("pca").alias("p")).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return two.agg(
        F.count(F.lit(1)).alias("n"), ((F.abs(F.avg("a")) < 1e-6) & (F.abs(F.avg("b")) < 1e-6)).alias("centred"),
        (F.abs(F.corr("a", "b")) < 1e-6).alias("uncorrelated"), (F.var_pop("a") >= F.var_pop("b")).alias("falling"),
    ).withColumn("enough", F.lit(sum(shares[:kept]) >= 0.95 - 1e-9 and sum(shares[:kept - 1]) < 0.95))


@query("cluster_facts", "SELECT algorithm, n, true AS within_k FROM (SELECT count(*) AS n FROM documents), "
                        "(VALUES ('agglomerative'), ('bisecting'), ('birch'), ('spectral'), ('kmeans')) AS a(algorithm)")
def _(spark, folder):
    """Every clustering places every point in one of at most k clusters."""
    points = app_points(spark, folder).select("id", "x")
    out = None
    for name in ("agglomerative", "bisecting", "birch", "spectral", "kmeans"):
        row = clustering.run(points, name, 5).agg(
            F.lit(name).alias("algorithm"), F.count_distinct("id").alias("n"),
            F.count_distinct("cluster").between(2, 5).alias("within_k"))
        out = row if out is None else out.unionByName(row)
    return out


@query("birch_entries", f"""WITH {PARTS}, c AS (SELECT u, v, floor(u / (0.2 / sqrt(2))) AS a, floor(v / (0.2 / sqrt(2))) AS b FROM pts)
SELECT count(*) AS n, {r('avg(u)', 5)} AS u, {r('avg(v)', 5)} AS v, {r('sqrt(greatest(var_pop(u) + var_pop(v), 0))', 4)} AS radius FROM c GROUP BY a, b""")
def _(spark, folder):
    """Clustering features of all parts by size and price under a radius threshold."""
    z = prep.standardise(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    rows = clustering.cf_rows(z.select(F.col("p_partkey").alias("id"), F.array("p_size", "p_retailprice").alias("x")), 0.1)[1]
    return rows.select(F.col("n").cast("bigint").alias("n"), (F.round(F.col("centre")[0], 5) + 0.0).alias("u"),
                       (F.round(F.col("centre")[1], 5) + 0.0).alias("v"), F.round("radius", 4).alias("radius"))


@query("birch_leaves", f"""WITH {PARTS} SELECT count(*) AS n, {r('avg(u * u + v * v)', 5)} AS squares, true AS bounded, true AS few,
  true AS centred FROM pts""")
def _(spark, folder):
    """Leaves of a feature tree add up to all parts, none is wider than the threshold the tree came to."""
    z = prep.standardise(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    rows = cftree.cf_leaves(z.select(F.col("p_partkey").alias("id"), F.array("p_size", "p_retailprice").alias("x")), 0.05, 200)
    c, n = F.col("centre"), F.col("n")
    return rounded(rows.agg(
        F.sum("n").alias("total"), F.sum(n * (F.col("radius") * F.col("radius") + c[0] * c[0] + c[1] * c[1])).alias("s"),
        F.bool_and(F.col("radius") <= F.col("threshold") + 1e-9).alias("bounded"), (F.count(F.lit(1)) <= 200).alias("few"),
        ((F.abs(F.sum(n * c[0])) < 1e-6) & (F.abs(F.sum(n * c[1])) < 1e-6)).alias("centred"),
    ).select(F.col("total").alias("n"), (F.col("s") / F.col("total")).alias("squares"), "bounded", "few", "centred"), 5)


@query("spectral_facts", "SELECT CAST(i AS INT) AS vector, true AS settled, true AS falling FROM range(1, 6) AS t(i)")
def _(spark, folder):
    """The five vectors that embed the mails solve their equation, values at most 1 and falling."""
    merged, edges = clustering.affinity_edges(app_points(spark, folder).select("id", "x"))
    _, values, residuals = clustering.eigenvectors(edges, 5, points=merged.select(F.col("pid").alias("id"), "x"))
    rows = [(i + 1, bool(e < 0.02), bool(v <= 1 + 1e-6 and (i == 0 or v <= values[i - 1] + 1e-9))) for i, (v, e) in enumerate(zip(values, residuals))]
    return spark.createDataFrame(rows, "vector int, settled boolean, falling boolean")


#: Given rows of a sweep: the accuracies of the stand-in models under three privacy levels.
GIVEN = {"a": 0.5, "b": 1.0, "c": 2.0}
GIVEN_SQL = (
    f"{predictions_ctes()}, acc AS (SELECT model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM predictions GROUP BY 1), "
    "sweep AS (SELECT CASE model " + " ".join(f"WHEN '{m}' THEN {e}::DOUBLE" for m, e in GIVEN.items()) + " END AS epsilon, accuracy FROM acc)"
)


def _given(spark, folder):
    found = metrics.weighted_metrics(predictions(spark, folder), ["model"])
    epsilon = F.element_at(F.create_map(*[F.lit(v) for pair in GIVEN.items() for v in pair]), F.col("model"))
    return found.select(epsilon.alias("epsilon"), scores.privacy_band(epsilon).alias("privacy"), "accuracy")


@query("compare_given", f"""WITH {GIVEN_SQL}
SELECT 'baseline' AS method, {r('0.9::DOUBLE')} AS accuracy UNION ALL SELECT 'averaged', {r('0.8::DOUBLE')}
UNION ALL SELECT 'private epsilon ' || CAST(epsilon AS VARCHAR), {r('accuracy')} FROM sweep""")
def _(spark, folder):
    return rounded(privacy.compare_methods(_given(spark, folder), 0.9, 0.8).select("method", "accuracy"))


@query("recommend_given", f"WITH {GIVEN_SQL} SELECT epsilon, {r('(0.95::DOUBLE - accuracy) * 100')} AS loss_pct FROM sweep WHERE epsilon = 1.0")
def _(spark, folder):
    sweep = _given(spark, folder).withColumn("loss_pct", privacy.accuracy_loss(F.lit(0.95), F.col("accuracy")))
    return rounded(privacy.recommend(sweep).select("epsilon", "loss_pct"))
