"""Classifier and cluster quality, splits, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.catalog.inputs import VECTORS, labelled, labelled_cte, predictions, predictions_ctes, vectors
from mailsift.catalog.registry import query, r, rounded, u
from mailsift.operators import cluster_metrics, metrics, prep
from mailsift.sources import table

P = predictions_ctes()


@query("confusion_matrix", f"""WITH {P}, cells AS (SELECT m.model, a.v AS label, p.v AS prediction FROM (SELECT DISTINCT model FROM predictions) m,
  (VALUES (0), (1)) a(v), (VALUES (0), (1)) p(v))
SELECT c.model, c.label, c.prediction, count(q.email_id) AS n FROM cells c LEFT JOIN predictions q USING (model, label, prediction) GROUP BY 1, 2, 3""")
def _(spark, folder):
    return metrics.confusion_matrix(predictions(spark, folder), ["model"])


BINARY = f"""{P}, c AS (SELECT model, count_if(label = 1 AND prediction = 1)::DOUBLE AS tp, count_if(label = 0 AND prediction = 1)::DOUBLE AS fp,
  count_if(label = 1 AND prediction = 0)::DOUBLE AS fn, count_if(label = 0 AND prediction = 0)::DOUBLE AS tn FROM predictions GROUP BY 1),
binary_metrics AS (SELECT model, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)"""


@query("binary_metrics", f"""WITH {BINARY} SELECT model, {r('accuracy')} AS accuracy, {r('precision')} AS precision, {r('recall')} AS recall,
  {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1 FROM binary_metrics""")
def _(spark, folder):
    return rounded(metrics.binary_metrics(predictions(spark, folder), ["model"]))


CLASSES = f"""{P}, classes AS (SELECT model, class, CAST(count_if(label = class) AS BIGINT) AS support, count_if(prediction = class) AS predicted,
  count_if(label = class AND prediction = class) AS tp FROM predictions, (VALUES (0), (1)) k(class) GROUP BY 1, 2),
rates AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM classes),
scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates),
weighted AS (SELECT model, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, CAST(sum(support) AS BIGINT) AS support FROM scored GROUP BY 1)"""


@query("weighted_metrics", f"WITH {CLASSES} SELECT model, {r('accuracy')} AS accuracy, {r('precision')} AS precision, "
       f"{r('recall')} AS recall, {r('f1')} AS f1 FROM weighted")
def _(spark, folder):
    return rounded(metrics.weighted_metrics(predictions(spark, folder), ["model"]))


@query("class_report", f"""WITH {CLASSES}, rows AS (
  SELECT model, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scored UNION ALL
  SELECT model, 'accuracy', NULL, NULL, accuracy, support FROM weighted UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored GROUP BY model UNION ALL
  SELECT model, 'weighted avg', precision, recall, f1, support FROM weighted)
SELECT model, class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support FROM rows""")
def _(spark, folder):
    return rounded(metrics.class_report(predictions(spark, folder), ["model"]))


AUC = f"""s AS (SELECT model, probability, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM predictions GROUP BY 1, 2),
w AS (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY probability) AS upto FROM s),
auc AS (SELECT model, sum(pos * (upto - neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS roc_auc FROM w GROUP BY 1)"""


@query("roc_auc", f"WITH {P}, {AUC} SELECT model, {r('roc_auc')} AS roc_auc FROM auc")
def _(spark, folder):
    return rounded(metrics.roc_auc(predictions(spark, folder), ["model"]))


@query("roc_curve", f"""WITH {P}, s AS (SELECT model, probability, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM predictions GROUP BY 1, 2)
SELECT model, probability AS threshold, {r('sum(neg) OVER d / (sum(neg) OVER (PARTITION BY model))::DOUBLE')} AS fpr,
  {r('sum(pos) OVER d / (sum(pos) OVER (PARTITION BY model))::DOUBLE')} AS tpr FROM s WINDOW d AS (PARTITION BY model ORDER BY probability DESC)
UNION ALL SELECT DISTINCT model, 1e308::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM predictions""")
def _(spark, folder):
    curve = metrics.roc_curve(predictions(spark, folder), ["model"])
    shown = F.when(F.col("threshold") == float("inf"), 1e308).otherwise(F.col("threshold"))
    return curve.select("model", shown.alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("model_comparison", f"""WITH {CLASSES}, {AUC}
SELECT model, {r('accuracy', 4)} AS accuracy, {r('precision', 4)} AS precision, {r('recall', 4)} AS recall, {r('f1', 4)} AS f1, {r('roc_auc', 4)} AS roc_auc
FROM weighted JOIN auc USING (model)""")
def _(spark, folder):
    return metrics.comparison(predictions(spark, folder))


# --- splits and scaling ------------------------------------------------------------------

def _order(seed: str) -> str:
    return f"sha256('{seed}|' || CAST(email_id AS VARCHAR))"


@query("stratified_split", f"""WITH {labelled_cte()}, o AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order('split')}) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT email_id, label, CASE WHEN i <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM o""")
def _(spark, folder):
    return prep.stratified_split(labelled(spark, folder), {"train": 0.7, "val": 0.15, "test": 0.15})


@query("split_80_20", f"""WITH {labelled_cte()}, o AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order('split')}) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT email_id, label, CASE WHEN i <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' ELSE 'test' END AS split FROM o""")
def _(spark, folder):
    return prep.stratified_split(labelled(spark, folder), {"train": 0.8, "test": 0.2})


@query("split_sizes", f"""WITH {labelled_cte()}, o AS (SELECT row_number() OVER (PARTITION BY label ORDER BY {_order('split')}) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM labelled),
s AS (SELECT CASE WHEN i <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM o)
SELECT split, count(*) AS n, {r('count(*) / (sum(count(*)) OVER ())::DOUBLE')} AS share FROM s GROUP BY 1""")
def _(spark, folder):
    split = prep.stratified_split(labelled(spark, folder), {"train": 0.7, "val": 0.15, "test": 0.15})
    return rounded(prep.group_sizes(split, "split"))


@query("stratified_folds", f"""WITH {labelled_cte()}, o AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_order('folds')}) AS i,
  count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT email_id, label, CAST(CASE WHEN i <= n * 1 // 5 THEN 0 WHEN i <= n * 2 // 5 THEN 1 WHEN i <= n * 3 // 5 THEN 2 WHEN i <= n * 4 // 5 THEN 3 ELSE 4 END AS INT) AS fold FROM o""")
def _(spark, folder):
    return prep.stratified_folds(labelled(spark, folder))


@query("org_split", f"""WITH {labelled_cte()}, o AS (SELECT email_id, row_number() OVER (ORDER BY email_id) AS i, count(*) OVER () AS n FROM labelled)
SELECT email_id, CAST((i > n * 1 // 5)::INT + (i > n * 2 // 5)::INT + (i > n * 3 // 5)::INT + (i > n * 4 // 5)::INT AS INT) AS org_id FROM o""")
def _(spark, folder):
    return prep.contiguous_parts(labelled(spark, folder).select("email_id"), 5)


Z = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 5) + f" AS {c}" for c in Z) + " FROM lineitem")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *Z)
    return rounded(prep.standardise(df, Z), 5)


@query("label_encode", "SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS label_index FROM events")
def _(spark, folder):
    return prep.label_encode(table(spark, folder, "events").select("event_id", "event_type"), "event_type")


# --- cluster quality ---------------------------------------------------------------------

PAIRS = f"""{VECTORS}, size AS (SELECT cluster, count(*) AS n FROM vectors GROUP BY 1),
d AS (SELECT a.id, a.cluster, b.cluster AS other, sum({{dist}}) AS total FROM vectors a, vectors b GROUP BY 1, 2, 3),
m AS (SELECT d.id, d.cluster, max(CASE WHEN other = d.cluster THEN n END) AS n, max(CASE WHEN other = d.cluster THEN total / nullif(n - 1, 0) END) AS a,
  min(CASE WHEN other <> d.cluster THEN total / n END) AS b FROM d JOIN size s ON s.cluster = other GROUP BY 1, 2)
SELECT {r('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM m"""


@query("silhouette", "WITH " + PAIRS.format(dist="list_distance(a.x, b.x)"))
def _(spark, folder):
    return rounded(cluster_metrics.silhouette(vectors(spark, folder)))


@query("silhouette_sampled", f"""WITH {VECTORS}, sizes AS (SELECT cluster, count(*) AS n_c FROM vectors GROUP BY 1), tot AS (SELECT count(*) AS n FROM vectors),
drawn AS (SELECT v.id, v.x, v.cluster, n_c FROM vectors v JOIN sizes USING (cluster), tot
  WHERE {u('silhouette', 'v.id')} < greatest(200.0::DOUBLE / n, 10.0::DOUBLE / n_c)),
p AS (SELECT d.id, d.cluster, d.n_c, b.cluster AS other, sum(list_distance(d.x, b.x)) AS t, count(*) AS n FROM drawn d, vectors b GROUP BY ALL),
m AS (SELECT id, cluster, n_c, max(CASE WHEN other = cluster THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> cluster THEN t / n END) AS b
  FROM p GROUP BY ALL),
s AS (SELECT cluster, n_c, CASE WHEN n_c = 1 THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END AS s FROM m),
c AS (SELECT cluster, n_c, count(*) AS m, avg(s) AS mean, coalesce(var_samp(s), 0) AS v FROM s GROUP BY ALL)
SELECT {r('sum(n_c * mean) / sum(n_c)')} AS silhouette, {r('sqrt(sum(n_c * n_c * v / m * (1 - m / n_c::DOUBLE))) / sum(n_c)')} AS error,
  CAST(sum(m) AS BIGINT) AS n FROM c""")
def _(spark, folder):
    return rounded(cluster_metrics.silhouette_sampled(vectors(spark, folder), 200, 10))


@query("silhouette_squared", "WITH " + PAIRS.format(dist="list_distance(a.x, b.x) ** 2"))
def _(spark, folder):
    return rounded(cluster_metrics.silhouette_squared(vectors(spark, folder)))


CENTRES = f"""{VECTORS}, long AS (SELECT id, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vectors),
cv AS (SELECT cluster, i, avg(v) AS m, count(*) AS n FROM long GROUP BY 1, 2),
centre AS (SELECT cluster, list(m ORDER BY i) AS c, max(n) AS n FROM cv GROUP BY 1)"""


@query("davies_bouldin", f"""WITH {CENTRES}, s AS (SELECT v.cluster, avg(list_distance(v.x, c.c)) AS s FROM vectors v JOIN centre c USING (cluster) GROUP BY 1),
j AS (SELECT a.cluster, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM centre a JOIN centre b ON a.cluster <> b.cluster
  JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY 1)
SELECT {r('avg(r)')} AS davies_bouldin FROM j""")
def _(spark, folder):
    return rounded(cluster_metrics.davies_bouldin(vectors(spark, folder)))


@query("calinski_harabasz", f"""WITH {CENTRES}, g AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v) AS m FROM long GROUP BY 1)),
b AS (SELECT sum(n * list_distance(centre.c, g.c) ** 2) AS between_, count(*) AS k, sum(n) AS n FROM centre, g),
w AS (SELECT sum(list_distance(v.x, c.c) ** 2) AS within_ FROM vectors v JOIN centre c USING (cluster))
SELECT {r('between_ * (n - k) / (within_ * (k - 1))')} AS calinski_harabasz FROM b, w""")
def _(spark, folder):
    return rounded(cluster_metrics.calinski_harabasz(vectors(spark, folder)))


GIVEN = "g AS (SELECT user_id % 5 AS cluster, event_type AS label FROM events)"


def _given(spark, folder):
    return table(spark, folder, "events").select((F.col("user_id") % 5).alias("cluster"), F.col("event_type").alias("label"))


@query("ari", f"""WITH {GIVEN}, c AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS both_, (SELECT sum(a * (a - 1) / 2) FROM (SELECT sum(n) AS a FROM c GROUP BY cluster)) AS rows_,
  (SELECT sum(b * (b - 1) / 2) FROM (SELECT sum(n) AS b FROM c GROUP BY label)) AS cols_, (SELECT sum(n) FROM c) AS n)
SELECT {r('(both_ - rows_ * cols_ / (n * (n - 1) / 2)) / ((rows_ + cols_) / 2 - rows_ * cols_ / (n * (n - 1) / 2))', 8)} AS ari FROM s""")
def _(spark, folder):
    return rounded(cluster_metrics.ari(_given(spark, folder)), 8)


@query("nmi", f"""WITH {GIVEN}, c AS (SELECT cluster, label, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b, sum(n) OVER () AS t FROM c)
SELECT {r('sum(n / t * ln(n * t / (a * b))) / ((sum(-n / t * ln(a / t)) + sum(-n / t * ln(b / t))) / 2)', 8)} AS nmi FROM w""")
def _(spark, folder):
    return rounded(cluster_metrics.nmi(_given(spark, folder)), 8)
