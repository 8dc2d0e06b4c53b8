"""Inputs the queries share, all derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift import fixed
from mailsift.functions import addresses, seeded
from mailsift.operators import cleaning, features
from mailsift.operators.prep import standardise
from mailsift.session import cut_lineage, use_utc
from mailsift.sources import emails, table, tasks_for

MODELS = {"a": 0.2, "b": 0.35, "c": 0.45}  # how much of the score comes from the label

LABEL = "CAST(coalesce(1 - l.quality, CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END) AS INT)"


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.add_date_parts(cleaning.fill_links(emails(spark, folder)))


def featured(spark: SparkSession, folder: str) -> DataFrame:
    df = features.batch_features(prepared(spark, folder))
    return df.withColumns({
        "sender_domain": addresses.domain(F.col("sender")), "receiver_domain": addresses.domain(F.col("receiver"))})


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """(email_id, label) without the mail itself."""
    use_utc(spark)
    d, l = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels")
    return spark.sql(
        f"SELECT d.doc_id AS email_id, {LABEL} AS label FROM {{d}} d LEFT JOIN {{l}} l ON l.doc_id = d.doc_id", d=d, l=l)


def labelled_cte() -> str:
    return f"labelled AS (SELECT d.doc_id AS email_id, {LABEL} AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of three stand-in models: part label, part key noise, with ties."""
    rows = labelled(spark, folder)
    entries = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.round(
            F.lit(w) * F.col("label") + F.lit(1 - w) * seeded.uniform(f"model-{m}", F.col("email_id")), 3).alias("p"))
        for m, w in MODELS.items()
    ])).alias("e")
    return rows.select("email_id", "label", entries).select(
        "email_id", "e.model", "label", (F.col("e.p") >= 0.5).cast("int").alias("prediction"),
        F.col("e.p").alias("probability"))


def predictions_ctes() -> str:
    from mailsift.catalog.registry import u
    one = " UNION ALL ".join(
        f"SELECT email_id, '{m}' AS model, label, round({w}::DOUBLE * label + {1 - w}::DOUBLE * {u(f'model-{m}', 'email_id')}, 3) AS probability FROM labelled"
        for m, w in MODELS.items())
    return f"{labelled_cte()}, predictions AS (SELECT *, CAST(probability >= 0.5 AS INT) AS prediction FROM ({one}))"


def scans(spark: SparkSession, folder: str, threshold: float = 0.5) -> DataFrame:
    """A scan log: every mail with a key-based score."""
    p = F.round(seeded.uniform("scan", F.col("email_id")), 4)
    return emails(spark, folder).select(
        "email_id", F.col("date").alias("timestamp"), "subject", "sender", p.alias("probability"),
        (p >= threshold).alias("is_phishing"), F.lit("Logistic Regression").alias("model"))


def scans_ctes() -> str:
    from mailsift.catalog.registry import u
    from mailsift.sources.emails import emails_cte
    return (
        f"{emails_cte()}, scans AS (SELECT email_id, date AS timestamp, subject, sender, "
        f"round({u('scan', 'email_id')}, 4) AS probability, round({u('scan', 'email_id')}, 4) >= 0.5 AS is_phishing, "
        f"'Logistic Regression' AS model FROM emails)"
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, x, cluster, label) of ``embeddings``; ``cluster`` is the given class, ``label`` a coarser one."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").alias("cluster"), (F.col("label") % 4).alias("label"))


VECTORS = (
    "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label AS cluster, label % 4 AS label FROM embeddings)"
)


def app_features(spark: SparkSession, folder: str) -> DataFrame:
    """Upload features without the texts, stored once: fits read them many times."""
    df = features.app_features(emails(spark, folder, tasks_for(spark, folder)))
    return cut_lineage(df.select("email_id", "label", *fixed.APP_FEATURES))


def app_points(spark: SparkSession, folder: str) -> DataFrame:
    """(id, x, label): standardised upload features as an array."""
    df = app_features(spark, folder)
    z = standardise(df, fixed.APP_FEATURES)
    return cut_lineage(z.select(F.col("email_id").alias("id"), F.array(*fixed.APP_FEATURES).alias("x"), "label"))
