"""Splits, folds, scaling, label encoding and minority oversampling."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift import fixed
from mailsift.functions import seeded
from mailsift.operators.neighbours import nearest
from mailsift.operators.ranking import random_cuts, random_rank, order_statistics, with_value_bucket
from mailsift.operators.skew import join_facts
from mailsift.session import written


def _cut_column(df: DataFrame, key: str, seed: str, by: list[str], steps: dict[str, Column],
                names: list[str]) -> Column:
    """Name of the range a row's digest falls in. The cuts are one row per class: a scalar map."""
    cuts = random_cuts(df, key, seed, steps, by)
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct(
        F.coalesce(F.col(by[0]).cast("string"), F.lit("")), F.struct(*steps)))).alias("m"))
    own = F.try_element_at(table.scalar(), F.coalesce(F.col(by[0]).cast("string"), F.lit("")))
    d = seeded.digest(seed, F.col(key))
    out = None
    for name, step in zip(names, steps):
        hit = d <= own[step]
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(names[-1])


def stratified_split(df: DataFrame, shares: dict[str, float], label: str = "label", key: str = "email_id",
                     seed: str = "split") -> DataFrame:
    """Column ``split``: exact shares of every class, in a seeded random order of the keys.

    Rows are compared with one cut per class and border, so the table itself is not shuffled and
    a class that holds most rows needs no task of its own.
    """
    names, total, steps = list(shares), 0.0, {}
    for name in names[:-1]:
        total += shares[name]
        steps[f"c_{name}"] = F.floor(F.col("n") * F.lit(round(total, 9)) + F.lit(0.5))
    return df.withColumn("split", _cut_column(df, key, seed, [label], steps, names))


def stratified_folds(df: DataFrame, folds: int = 5, label: str = "label", key: str = "email_id",
                     seed: str = "folds") -> DataFrame:
    """Column ``fold`` 0..folds-1: equal shares of every class."""
    steps = {f"c{i}": F.floor(F.col("n") * F.lit(i + 1) / F.lit(folds)) for i in range(folds - 1)}
    names = [str(i) for i in range(folds)]
    return df.withColumn("fold", _cut_column(df, key, seed, [label], steps, names).cast("int"))


def contiguous_parts(df: DataFrame, parts: int, key: str = "email_id", name: str = "org_id") -> DataFrame:
    """Column 0..parts-1: consecutive ranges of the key with equal row counts."""
    rows = with_value_bucket(df.select(key).withColumn("_w", F.lit(1)), key)
    ranks = {f"c{i}": F.floor(F.col("n") * F.lit(i) / F.lit(parts)) for i in range(1, parts)}
    cuts = order_statistics(rows, key, "_w", ranks).select(F.array(*ranks).alias("c"))
    out = df.withColumn("_cuts", cuts.scalar())
    place = sum(((F.col(key) > F.coalesce(F.get("_cuts", F.lit(i)), F.col(key) - 1)).cast("int")
                 for i in range(parts - 1)), F.lit(0))
    return out.withColumn(name, place).drop("_cuts")


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation, from the rows of ``fit_on``; constants become 0."""
    source = df if fit_on is None else fit_on
    stats = source.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c)
        for c in columns
    ]).alias("z"))
    out = df.withColumn("_z", stats.scalar())
    return out.withColumns({
        c: F.when(F.col("_z")[c]["s"] == 0, 0.0).otherwise(
            (F.col(c) - F.col("_z")[c]["m"]) / F.nullif(F.col("_z")[c]["s"], F.lit(0.0)))
        for c in columns
    }).drop("_z")


def label_encode(df: DataFrame, column: str, out: str = "label_index") -> DataFrame:
    """0, 1, ... in alphabetical order of the distinct labels; null stays null.

    The labels are sorted by ranges and numbered within each range; rows meet them by a join in which
    common labels are broadcast.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    names = written(counts.repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "labels")
    sizes = names.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) + F.col("_before") - 1
    index = names.join(F.broadcast(before), "_range").select(column, place.cast("int").alias(out))
    return join_facts(df, index, column)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=columns, outputCol=out).transform(cast)


def pca(df: DataFrame, features: str = "scaled", out: str = "pca", share: float = 0.95,
        max_components: int | None = None):
    """Projection on the leading components that keep ``share`` of the variance, and their shares."""
    d = len(df.select(features).head()[0])
    model = PCA(k=d, inputCol=features, outputCol="_all").fit(df)
    shares = [float(v) for v in model.explainedVariance.toArray()]
    total, kept = 0.0, 0
    for v in shares:
        if total >= share - 1e-12:
            break
        total, kept = total + v, kept + 1
    kept = min(kept, max_components or kept) or 1
    sliced = VectorSlicer(inputCol="_all", outputCol=out, indices=list(range(kept)))
    return sliced.transform(model.transform(df)).drop("_all"), shares, kept


def pca_2d(df: DataFrame, features: str = "scaled") -> DataFrame:
    model = PCA(k=2, inputCol=features, outputCol="_p2").fit(df)
    xy = vector_to_array(F.col("_p2"))
    return model.transform(df).withColumns({"pc1": xy[0], "pc2": xy[1]}).drop("_p2")


COPIES_PER_TASK_ROW = 256


def balance_by_synthesis(df: DataFrame, features: str, label: str = "label", key: str = "email_id",
                         k: int = 5, gate: float = fixed.IMBALANCE_GATE, seed: str = "synthetic") -> DataFrame:
    """Below the gate, raise every smaller class to the size of the largest with synthetic rows.

    A synthetic row lies between a row and one of its ``k`` nearest rows of the same class; all
    choices come from the key. ``features`` is an array of doubles; ``synthetic`` marks new rows.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    out = df.select(key, label, features).withColumn("synthetic", F.lit(False))
    if len(counts) < 2 or min(counts.values()) / max(counts.values()) >= gate:
        return out
    largest = max(counts.values())
    for value, n in counts.items():
        missing = largest - n
        if missing == 0 or n < 2:
            continue
        part = df.where(F.col(label) == F.lit(value)).select(key, label, features)
        out = out.unionByName(_synthesise(part, features, label, key, min(k, n - 1), n, missing, seed))
    return out


def _synthesise(part: DataFrame, features: str, label: str, key: str, k: int, n: int, missing: int,
                seed: str) -> DataFrame:
    near = nearest(part.select(F.col(key).alias("id"), F.col(features).alias("x")), k, with_self=False, coordinates=True)
    ranked = random_rank(part, key, seed)
    base, extra = divmod(missing, n)
    copies = F.lit(base) + (F.col("rank") <= extra).cast("int")
    rows = (
        ranked.withColumn("_copies", copies).where("_copies > 0")
        .join(near.select(F.col("id").alias(key), "near"), key)
    )
    if base > COPIES_PER_TASK_ROW:
        chunks = math.ceil((base + 1) / COPIES_PER_TASK_ROW)
        rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(key, "_chunk")
        first = F.col("_chunk") * COPIES_PER_TASK_ROW
        last = F.least(F.col("_copies"), first + COPIES_PER_TASK_ROW) - 1
        rows = rows.where(first < F.col("_copies")).withColumn("_copy", F.explode(F.sequence(first, last)))
    else:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    pick = seeded.choice(f"{seed}-pick", F.size("near"), F.col(key), F.col("_copy"))
    gap = seeded.uniform(f"{seed}-gap", F.col(key), F.col("_copy"))
    return rows.withColumns({"_other": F.get("near", pick)["x"], "_gap": gap}).select(
        key, label,
        F.transform(F.arrays_zip(F.col(features).alias("a"), F.col("_other").alias("b")),
                    lambda p: p["a"] + F.col("_gap") * (p["b"] - p["a"])).alias(features),
        F.lit(True).alias("synthetic"),
    )


__all__ = [
    "stratified_split", "stratified_folds", "contiguous_parts", "group_sizes", "standardise",
    "label_encode", "assemble", "pca", "pca_2d", "balance_by_synthesis",
    "array_to_vector", "vector_to_array",
]
