"""Distance joins and clusterings over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.catalog.inputs import VECTORS, app_points, vectors
from mailsift.catalog.registry import query, r, rounded
from mailsift.operators import cluster_metrics, clustering, neighbours, prep, profiling
from mailsift.sources import table

EPS, MIN_SAMPLES = 1.1, 3


@query("k_distance", f"""WITH {VECTORS}, d AS (SELECT a.id, list_distance(a.x, b.x) AS d FROM vectors a, vectors b),
k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM d) SELECT id, {r('d', 5)} AS kdist FROM k WHERE i = 10""")
def _(spark, folder):
    return rounded(neighbours.k_distances(vectors(spark, folder).select("id", "x"), 10), 5)


@query("hashed_neighbours", "SELECT count(*) AS n, true AS enough FROM embeddings")
def _(spark, folder):
    """Approximate ten nearest of every vector: at least nine in ten of the exact ones."""
    points = vectors(spark, folder).select("id", "x")
    found = neighbours.recall(neighbours.nearest(points, 10), neighbours.hashed_nearest(points, 10))
    return found.select("n", (F.col("recall") >= 0.9).alias("enough"))


@query("eps_from_k_distance", f"""WITH {VECTORS}, d AS (SELECT a.id, list_distance(a.x, b.x) AS d FROM vectors a, vectors b),
k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS i FROM d) SELECT {r('quantile_cont(d, 0.9)', 5)} AS eps FROM k WHERE i = 10""")
def _(spark, folder):
    from mailsift.operators.ranking import exact_quantiles
    kd = neighbours.k_distances(vectors(spark, folder).select("id", "x"), 10)
    return rounded(exact_quantiles(kd, "kdist", {"eps": 0.9}).select("eps"), 5)


@query("eps_neighbours", f"""WITH {VECTORS} SELECT a.id, count(*) AS n_neighbours, count(*) >= {MIN_SAMPLES} AS is_core
FROM vectors a JOIN vectors b ON list_distance(a.x, b.x) <= {EPS} GROUP BY 1""")
def _(spark, folder):
    return clustering.neighbour_table(vectors(spark, folder).select("id", "x"), EPS, MIN_SAMPLES)


@query("dbscan", f"""WITH RECURSIVE {VECTORS}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON list_distance(a.x, b.x) <= {EPS}),
core AS MATERIALIZED (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}),
ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT reach.a, ce.b FROM reach JOIN ce ON ce.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
num AS (SELECT component, dense_rank() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT DISTINCT component FROM comp)),
got AS (SELECT id, cluster FROM comp JOIN num USING (component)),
border AS (SELECT e.a AS id, min(got.cluster) AS cluster FROM e JOIN got ON got.id = e.b WHERE e.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT v.id, CAST(coalesce(got.cluster, border.cluster, -1) AS INT) AS cluster FROM vectors v LEFT JOIN got USING (id) LEFT JOIN border USING (id)""")
def _(spark, folder):
    return clustering.dbscan(vectors(spark, folder).select("id", "x"), EPS, MIN_SAMPLES)


PARTS = """pts AS (SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS u,
  (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS v FROM part)"""


@query("eps_neighbours_part", f"""WITH {PARTS} SELECT a.id, count(*) AS n_neighbours, count(*) >= 8 AS is_core
FROM pts a JOIN pts b ON sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) <= 0.15 GROUP BY 1""")
def _(spark, folder):
    z = prep.standardise(table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return clustering.neighbour_table(
        z.select(F.col("p_partkey").alias("id"), F.array("p_size", "p_retailprice").alias("x")), 0.15, 8)


@query("dbscan_emails")
def _(spark, folder):
    points = app_points(spark, folder)
    return clustering.dbscan(points.select("id", "x"), 0.5, 5)


@query("kmeans")
def _(spark, folder):
    return clustering.kmeans(app_points(spark, folder).select("id", "x"), 5)


@query("k_search")
def _(spark, folder):
    return clustering.k_search(app_points(spark, folder).select("id", "x"))


@query("bisecting")
def _(spark, folder):
    return clustering.bisecting(app_points(spark, folder).select("id", "x"), 5)


@query("agglomerative")
def _(spark, folder):
    return clustering.ward(app_points(spark, folder).select("id", "x"), 5)


@query("birch_cf")
def _(spark, folder):
    return clustering.cf_rows(app_points(spark, folder).select("id", "x"), 0.5)[1]


@query("birch")
def _(spark, folder):
    return clustering.birch(app_points(spark, folder).select("id", "x"), 5)


@query("spectral")
def _(spark, folder):
    return clustering.spectral(app_points(spark, folder).select("id", "x"), 5)


def _scaled(spark, folder):
    points = app_points(spark, folder)
    return points.select(F.col("id").alias("email_id"), "label", prep.array_to_vector("x").alias("scaled"))


@query("pca_95")
def _(spark, folder):
    out, _, _ = prep.pca(_scaled(spark, folder))
    return out.select("email_id", prep.vector_to_array("pca").alias("pca"))


@query("pca_variance")
def _(spark, folder):
    _, shares, kept = prep.pca(_scaled(spark, folder))
    rows = spark.createDataFrame([(i + 1, s, i < kept) for i, s in enumerate(shares)], "k int, share double, kept boolean")
    return profiling.cumulative_variance(rows)


@query("pca_2d")
def _(spark, folder):
    return prep.pca_2d(_scaled(spark, folder)).select("email_id", "pc1", "pc2")


@query("cluster_view")
def _(spark, folder):
    """Two leading components of each mail with its cluster and class."""
    scaled = _scaled(spark, folder)
    found = clustering.run(scaled.select(F.col("email_id").alias("id"), prep.vector_to_array("scaled").alias("x")), "kmeans", 5)
    return prep.pca_2d(scaled).join(found.withColumnRenamed("id", "email_id"), "email_id").select(
        "email_id", "pc1", "pc2", "cluster", "label")


@query("cluster_evaluation")
def _(spark, folder):
    points = app_points(spark, folder).persist()
    out = None
    for name in ("kmeans", "dbscan", "agglomerative", "spectral"):
        found = clustering.run(points.select("id", "x"), name, 5).persist()
        row = cluster_metrics.evaluate(points.join(found, "id"), name)
        if row is not None:
            out = row if out is None else out.unionByName(row)
    return out
