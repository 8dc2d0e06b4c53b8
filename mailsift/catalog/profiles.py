"""Profiles by class, correlations, histograms, top-k, cluster profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import fixed
from mailsift.catalog.inputs import featured, labelled, labelled_cte, predictions, predictions_ctes, prepared, vectors
from mailsift.catalog.registry import query, r, rounded, with_emails, with_features
from mailsift.functions import dates
from mailsift.operators import cleaning, metrics, profiling
from mailsift.session import cut_lineage, written
from mailsift.sources import emails, table

MEANS = ["subject_length", "body_length", "num_urls", "urgency_score", "financial_score"]
PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("means_by_label", with_features(
    "SELECT label, " + ", ".join(f"{r(f'avg({c})')} AS avg_{c}" for c in MEANS) + " FROM featured GROUP BY label"))
def _(spark, folder):
    return rounded(profiling.means_by(featured(spark, folder), "label", MEANS))


@query("sums_by_label", with_features(
    "SELECT label, CAST(sum(has_suspicious_url) AS BIGINT) AS sum_has_suspicious_url FROM featured GROUP BY label"))
def _(spark, folder):
    return profiling.sums_by(featured(spark, folder), "label", ["has_suspicious_url"])


@query("label_counts", f"WITH {labelled_cte()} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def _(spark, folder):
    return profiling.label_counts(labelled(spark, folder))


@query("label_pct", f"WITH {labelled_cte()} SELECT label, count(*) AS n, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()')} AS pct FROM labelled GROUP BY label")
def _(spark, folder):
    return rounded(profiling.label_pct(labelled(spark, folder)))


@query("class_balance", f"WITH {labelled_cte()}, c AS (SELECT count(*) AS n FROM labelled GROUP BY label) "
       f"SELECT min(n) AS smallest, max(n) AS largest, {r('min(n) / max(n)::DOUBLE')} AS ratio FROM c")
def _(spark, folder):
    return rounded(profiling.class_balance(labelled(spark, folder)))


@query("distinct_labels", f"WITH {labelled_cte()} SELECT DISTINCT label FROM labelled")
def _(spark, folder):
    return labelled(spark, folder).select("label").distinct()


@query("distinct_domains", with_features(
    "SELECT 'sender_domain' AS column_name, count(DISTINCT sender_domain) AS n_distinct FROM featured UNION ALL "
    "SELECT 'receiver_domain', count(DISTINCT receiver_domain) FROM featured"))
def _(spark, folder):
    return profiling.distinct_counts(featured(spark, folder), "sender_domain", "receiver_domain")


@query("domain_sketches", with_features(
    "SELECT 'sender_domain' AS column_name, count(DISTINCT sender_domain) AS n_distinct, true AS close, true AS same FROM featured UNION ALL "
    "SELECT 'receiver_domain', count(DISTINCT receiver_domain), true, true FROM featured"))
def _(spark, folder):
    """Daily sketches of each class, stored and merged: within 5 % of the exact count, equal to one sketch of all rows."""
    columns = ["sender_domain", "receiver_domain"]
    mails = cut_lineage(featured(spark, folder).select(F.substring(F.col("date").cast("string"), 1, 10).alias("day"), "label", *columns))
    merged = profiling.merged_distinct(written(profiling.distinct_sketches(mails, columns, ["day", "label"]), "sketches"))
    direct = profiling.merged_distinct(profiling.distinct_sketches(mails, columns, [])).withColumnRenamed("n_distinct", "direct")
    exact = profiling.distinct_counts(mails, *columns).withColumnRenamed("n_distinct", "exact")
    return merged.join(direct, "column_name").join(exact, "column_name").select(
        "column_name", F.col("exact").alias("n_distinct"), (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"),
        (F.col("n_distinct") == F.col("direct")).alias("same"))


@query("feature_overview", with_features(f"""
SELECT {r('avg(subject_length)')} AS avg_subject_length, CAST(sum(subject_has_re_fwd) AS BIGINT) AS n_re_fwd,
  {r('avg(CAST(subject_has_re_fwd > 0 AS DOUBLE))')} AS share_re_fwd, {r('avg(body_length)')} AS avg_body_length,
  {r('avg(body_num_exclaim)')} AS avg_exclaim, CAST(sum(contains_html) AS BIGINT) AS n_html,
  {r('avg(CAST(contains_html > 0 AS DOUBLE))')} AS share_html, {r('avg(num_urls)')} AS avg_urls,
  CAST(sum(has_suspicious_url) AS BIGINT) AS n_suspicious, {r('avg(CAST(has_suspicious_url > 0 AS DOUBLE))')} AS share_suspicious,
  CAST(sum(is_weekend) AS BIGINT) AS n_weekend, {r('avg(CAST(is_weekend > 0 AS DOUBLE))')} AS share_weekend,
  CAST(count_if(urgency_score > 0) AS BIGINT) AS n_urgent, CAST(count_if(financial_score > 0) AS BIGINT) AS n_financial FROM featured"""))
def _(spark, folder):
    return rounded(profiling.feature_overview(featured(spark, folder)))


def _summary_sql(source: str, by: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c}::DOUBLE)')} AS std, "
        f"{r(f'min({c})::DOUBLE')} AS min, {r(f'max({c})::DOUBLE')} AS max FROM {source} GROUP BY {by}" for c in columns)


@query("feature_summary", with_features(_summary_sql("featured", "label", fixed.CORRELATED_FEATURES)))
def _(spark, folder):
    return rounded(profiling.feature_summary(featured(spark, folder), fixed.CORRELATED_FEATURES))


@query("lineitem_summary", _summary_sql("lineitem", "l_returnflag", PRICES))
def _(spark, folder):
    return rounded(profiling.feature_summary(table(spark, folder, "lineitem"), PRICES, "l_returnflag"))


def _corr_sql(source: str, columns: list[str]) -> str:
    one = lambda a, b: (
        f"SELECT '{a}' AS x, '{b}' AS y, covar_samp({a}::DOUBLE, {b}::DOUBLE) / "
        f"nullif(stddev_samp({a}::DOUBLE) * stddev_samp({b}::DOUBLE), 0) AS r FROM {source}")
    rows = " UNION ALL ".join(one(a, b) for a in columns for b in columns)
    return f"SELECT x, y, {r('r')} AS r FROM ({rows})"


@query("corr_matrix", with_features(
    f", wanted AS MATERIALIZED (SELECT {', '.join(fixed.CORRELATED_FEATURES)} FROM featured) " + _corr_sql("wanted", fixed.CORRELATED_FEATURES)))
def _(spark, folder):
    return rounded(profiling.correlations(featured(spark, folder), fixed.CORRELATED_FEATURES))


@query("corr_lineitem", _corr_sql("lineitem", PRICES))
def _(spark, folder):
    return rounded(profiling.correlations(table(spark, folder, "lineitem"), PRICES))


DATED = """
, best AS (SELECT date FROM emails WHERE date IS NOT NULL GROUP BY date ORDER BY count(*) DESC, date LIMIT 1)
, dated AS (SELECT * REPLACE (coalesce(date, (SELECT date FROM best), TIMESTAMP '2000-01-01') AS date) FROM emails)
"""


def _dated(spark, folder):
    """Every mail with a date, the missing ones filled first, as in the cleaned table."""
    return cleaning.add_date_parts(cleaning.fill_date_with_mode(emails(spark, folder)))


@query("hour_histogram", with_emails(f"{DATED} SELECT label, CAST(hour(date) AS INT) AS hour, count(*) AS n FROM dated GROUP BY 1, 2"))
def _(spark, folder):
    return profiling.hour_histogram(_dated(spark, folder))


@query("weekend_crosstab", with_emails(f"""{DATED}
SELECT CAST(isodow(date) IN (6, 7) AS INT) AS is_weekend, label, count(*) AS n,
  {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY label)')} AS pct FROM dated GROUP BY 1, 2"""))
def _(spark, folder):
    rows = _dated(spark, folder).withColumn("is_weekend", dates.is_weekend(F.col("weekday")))
    return rounded(profiling.weekend_crosstab(rows))


@query("cluster_alignment", with_emails(
    "SELECT coalesce(CAST(num_attachments AS VARCHAR), 'All') AS cluster, coalesce(CAST(label AS VARCHAR), 'All') AS label, "
    "count(*) AS n FROM emails GROUP BY CUBE (num_attachments, label)"))
def _(spark, folder):
    df = emails(spark, folder).select(F.col("num_attachments").alias("cluster"), "label")
    both = profiling.crosstab_with_margins(df, "cluster", "label")
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("All")).alias(c) for c in ("cluster", "label")], "n")


@query("top_domains", with_features(
    "SELECT sender_domain, count(*) AS n FROM featured GROUP BY 1 ORDER BY n DESC, sender_domain LIMIT 15"))
def _(spark, folder):
    return profiling.top_values(featured(spark, folder), "sender_domain", 15)


@query("time_of_day_counts", with_features("SELECT time_of_day, count(*) AS n FROM featured GROUP BY 1"))
def _(spark, folder):
    return profiling.value_counts(featured(spark, folder), "time_of_day")


BOX = """
, q AS (SELECT {by}, count(*) AS n, quantile_cont({v}::DOUBLE, 0.25) AS q1, quantile_cont({v}::DOUBLE, 0.5) AS median,
  quantile_cont({v}::DOUBLE, 0.75) AS q3 FROM {t} GROUP BY {by}),
j AS (SELECT f.{by}, f.{v} AS v, n, q1, median, q3, f.{v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {t} f JOIN q USING ({by}))
SELECT {by}, n, {q1} AS q1, {median} AS median, {q3} AS q3, min(CASE WHEN inside THEN v END)::DOUBLE AS low_whisker,
  max(CASE WHEN inside THEN v END)::DOUBLE AS high_whisker, CAST(count_if(NOT inside) AS BIGINT) AS n_outliers
FROM j GROUP BY {by}, n, j.q1, j.median, j.q3"""


def _box(t: str, by: str, v: str) -> str:
    return BOX.format(t=t, by=by, v=v, q1=r("j.q1"), median=r("j.median"), q3=r("j.q3"))


@query("boxplot_stats", with_features(_box("featured", "label", "body_length")))
def _(spark, folder):
    return rounded(profiling.boxplot(featured(spark, folder).select("label", "body_length"), "body_length"))


@query("boxplot_lineitem", "WITH t AS (SELECT * FROM lineitem) " + _box("t", "l_returnflag", "l_extendedprice"))
def _(spark, folder):
    return rounded(profiling.boxplot(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("boxplot_outliers", with_features("""
, q AS (SELECT label, quantile_cont(body_length::DOUBLE, 0.25) AS q1, quantile_cont(body_length::DOUBLE, 0.75) AS q3 FROM featured GROUP BY label)
SELECT email_id, label, body_length FROM featured JOIN q USING (label)
WHERE body_length < q1 - 1.5 * (q3 - q1) OR body_length > q3 + 1.5 * (q3 - q1)"""))
def _(spark, folder):
    return profiling.outliers(featured(spark, folder).select("email_id", "label", "body_length"), "body_length")


@query("feature_histogram", with_features("""
, e AS (SELECT min(subject_length)::DOUBLE AS lo, max(subject_length)::DOUBLE AS hi FROM featured)
SELECT label, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((subject_length - lo) * 30 / nullif(hi - lo, 0)) + 1, 30) END AS INT) AS bin,
  count(*) AS n FROM featured, e GROUP BY 1, 2"""))
def _(spark, folder):
    return profiling.feature_histogram(featured(spark, folder).select("label", "subject_length"), "subject_length", "label", 30)


@query("score_histogram", f"""WITH {predictions_ctes()}
SELECT model, CAST(least(floor((probability - 0.0::DOUBLE) / (1.0::DOUBLE / 20)) + 1, 20) AS INT) AS bin, count(*) AS n FROM predictions GROUP BY 1, 2""")
def _(spark, folder):
    return profiling.histogram(predictions(spark, folder), "probability", 0.0, 1.0, 20, ["model"])


@query("scatter_points", with_features("SELECT subject_length, body_length, label, count(*) AS n FROM featured GROUP BY 1, 2, 3"))
def _(spark, folder):
    return profiling.scatter(featured(spark, folder), "subject_length", "body_length")


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, folder):
    return profiling.value_counts(vectors(spark, folder), "cluster")


@query("noise_share", with_emails(f"""
SELECT CAST(count_if(num_attachments = 0) AS BIGINT) AS n_noise, {r('count_if(num_attachments = 0) * 100.0::DOUBLE / count(*)')} AS pct_noise,
  count(DISTINCT CASE WHEN num_attachments > 0 THEN num_attachments END) AS n_clusters FROM emails"""))
def _(spark, folder):
    return rounded(profiling.noise_share(emails(spark, folder).select((F.col("num_attachments") - 1).alias("cluster"))))


PROFILE = ["subject_length", "body_length", "num_urls", "body_num_digits", "body_percent_caps", "urgency_score"]


@query("cluster_profile", with_features(
    "SELECT num_attachments AS cluster, count(*) AS size, " + ", ".join(f"{r(f'avg({c})')} AS avg_{c}" for c in PROFILE)
    + " FROM featured GROUP BY 1"))
def _(spark, folder):
    df = featured(spark, folder).withColumn("cluster", F.col("num_attachments"))
    return rounded(profiling.cluster_profile(df, PROFILE))


_Z = " UNION ALL ".join(
    f"SELECT num_attachments AS cluster, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM featured)) / "
    f"(SELECT CASE WHEN stddev_samp({c}::DOUBLE) = 0 THEN 1e-6 ELSE stddev_samp({c}::DOUBLE) END FROM featured) AS z "
    "FROM featured GROUP BY 1" for c in PROFILE)


@query("cluster_top_features", with_features(f"""
, z AS (SELECT * FROM ({_Z}) WHERE abs(z) > 0.05),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, feature) AS rank FROM z)
SELECT cluster, CAST(rank AS INT) AS rank, feature, {r('z')} AS z, CASE WHEN z > 0 THEN 'Higher' ELSE 'Lower' END AS direction
FROM k WHERE rank <= 5"""))
def _(spark, folder):
    df = featured(spark, folder).withColumn("cluster", F.col("num_attachments"))
    return rounded(profiling.cluster_top_features(df, PROFILE, least=0.05))


@query("cum_variance", f"""
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
s AS (SELECT k, var_samp(v) AS var FROM e GROUP BY k), t AS (SELECT CAST(k AS INT) AS k, var / sum(var) OVER () AS share FROM s)
SELECT k, {r('share')} AS share, {r('sum(share) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)')} AS cumulative FROM t""")
def _(spark, folder):
    dims = vectors(spark, folder).select(F.posexplode("x").alias("k", "v")).groupBy((F.col("k") + 1).alias("k")).agg(
        F.var_samp("v").alias("share"))
    total = dims.agg(F.sum("share").alias("t"))
    shares = dims.select("k", "share", total.scalar().alias("t")).select("k", (F.col("share") / F.col("t")).alias("share"))
    return rounded(profiling.cumulative_variance(shares))


@query("rank_models", f"""WITH {predictions_ctes()}, a AS (SELECT model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM predictions GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS INT) AS rank, model, {r('accuracy')} AS accuracy FROM a""")
def _(spark, folder):
    table_ = metrics.binary_metrics(predictions(spark, folder), ["model"]).select("model", "accuracy")
    return rounded(profiling.rank_by(table_, "accuracy", "model"))


@query("optimal_k", f"SELECT CAST(user_id % 9 + 2 AS INT) AS k, {r('avg(value)')} AS silhouette FROM events GROUP BY 1 ORDER BY avg(value) DESC, k LIMIT 1")
def _(spark, folder):
    per_k = table(spark, folder, "events").groupBy((F.col("user_id") % 9 + 2).cast("int").alias("k")).agg(
        F.avg("value").alias("silhouette"))
    return rounded(profiling.best_by(per_k, "silhouette", "k"))
