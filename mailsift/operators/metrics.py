"""Classifier metrics as aggregations over (label, prediction, probability) rows.

Every function takes ``by`` columns (for example the model), so all models are measured in one
pass. The positive class is 1; a division by zero gives 0, as the usual reports do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.operators.ranking import running_totals


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion_matrix(df: DataFrame, by: list[str] | None = None, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """All cells, empty ones included, from one aggregate row per group."""
    by = by or []
    cells = F.array(*[
        F.struct(
            F.lit(a).alias("label"), F.lit(p).alias("prediction"),
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).alias("n"))
        for a in classes for p in classes
    ])
    return df.groupBy(*by).agg(cells.alias("c")).select(*by, F.explode("c").alias("c")).select(*by, "c.*")


def binary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    y, p = F.col("label") == 1, F.col("prediction") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.select(
        *by, ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def per_class(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    by = by or []
    pairs = df.groupBy(*by, F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )).alias("s")
    sums = pairs.select(*by, sides).groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    out = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def weighted_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1."""
    return per_class(df, by).groupBy(*(by or [])).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
          for m in ("precision", "recall", "f1")])


def class_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages."""
    by = by or []
    classes = per_class(df, by)
    names = ("precision", "recall", "f1")
    rows = classes.select(*by, F.col("class").cast("string").alias("class"), *names, "support")
    support = F.sum("support").alias("support")
    none = F.lit(None).cast("double")
    accuracy = classes.groupBy(*by).agg(
        F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
        ratio(F.sum("tp"), F.sum("support")).alias("f1"), support)
    macro = classes.groupBy(*by).agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in names], support)
    weighted = classes.groupBy(*by).agg(
        F.lit("weighted avg").alias("class"),
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names], support)
    return rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def _per_score(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "probability").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class only."""
    by = by or []
    cum = running_totals(_per_score(df, by), "probability", ["neg"], by)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return cum.groupBy(*by).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def roc_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One point per distinct score, from the origin (infinite threshold) on."""
    by = by or []
    cum = running_totals(_per_score(df, by), "probability", ["pos", "neg"], by, descending=True)
    points = cum.select(
        *by, F.col("probability").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    origin = df.groupBy(*by).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def comparison(df: DataFrame, by: str = "model", digits: int | None = 4) -> DataFrame:
    """One row per model: weighted metrics and AUC."""
    table = weighted_metrics(df, [by]).join(roc_auc(df, [by]), by)
    if digits is None:
        return table
    return table.select(by, *[
        F.round(m, digits).alias(m) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")])
