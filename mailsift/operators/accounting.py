"""What a private analysis costs, and private statistics for scaling.

Neighbouring tables differ in one row that is replaced, so the number of rows is public. Epsilons of releases from the same
rows add up; releases from disjoint rows cost the largest of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.functions import seeded

#: Exponents of two between which the size of a column's values is looked for.
LEAST_POWER, LARGEST_POWER = -10, 60


class Accountant:
    """Adds up what has been released; refuses what would exceed the budget."""

    def __init__(self, budget: float | None = None):
        self.budget, self.spent = budget, []

    @property
    def total(self) -> float:
        return sum(e for _, e in self.spent)

    def charge(self, step: str, epsilon: float) -> float:
        """A release from all rows."""
        if not epsilon > 0:
            raise ValueError(f"{step}: epsilon has to be positive, not {epsilon}")
        if self.budget is not None and self.total + epsilon > self.budget * (1 + 1e-12):
            raise ValueError(f"{step}: {epsilon} exceeds the {self.budget - self.total} that are left of {self.budget}")
        self.spent.append((step, float(epsilon)))
        return epsilon

    def charge_disjoint(self, step: str, epsilons: Sequence[float]) -> float:
        """Releases from parts that share no row."""
        return self.charge(step, max(epsilons))

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, epsilon, total): the releases in order and what they come to."""
        rows, total = [], 0.0
        for step, epsilon in self.spent:
            total += epsilon
            rows.append((step, epsilon, total))
        return spark.createDataFrame(rows, "step string, epsilon double, total double")


def private_bounds(rows: DataFrame, d: int, epsilon: float, seed: str = "bounds", x: str = "x") -> list[float]:
    """A bound on the size of each of the ``d`` entries of the arrays ``x``: a power of two.

    A histogram over powers of two, each count with noise of scale 2 d / epsilon, as a replaced row changes two counts of
    every column. The bound is the largest power whose noisy count rises above what noise alone reaches in
    one of 100 histograms; the rare larger values are clipped to it. Without such a power the bound is the least one.
    """
    scale = 2.0 * d / epsilon
    powers = range(LEAST_POWER, LARGEST_POWER + 1)
    at_least = -(F.log(F.lit(1 - 0.99 ** (1.0 / len(powers)))) + F.log(F.lit(2.0))) * scale
    size = F.abs(F.coalesce(F.when(~F.isnan("v"), F.col("v")), F.lit(0.0)))
    power = F.greatest(F.lit(LEAST_POWER), F.least(F.lit(LARGEST_POWER), F.ceil(F.log2(F.greatest(size, F.lit(2.0 ** LEAST_POWER))))))
    counts = rows.select(F.posexplode(x).alias("i", "v")).groupBy("i", power.cast("int").alias("power")).agg(
        F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(d).select(
        F.col("id").cast("int").alias("i"), F.explode(F.lit(list(powers))).alias("power"))
    noisy = every.join(counts, ["i", "power"], "left").withColumn(
        "noisy", F.coalesce("n", F.lit(0)) + seeded.laplace(seed, scale, F.col("i"), F.col("power")))
    found = noisy.where(F.col("noisy") > at_least).groupBy("i").agg(F.max("power").alias("power"))
    known = {r.i: r.power for r in found.collect()}
    return [2.0 ** known.get(i, LEAST_POWER) for i in range(d)]


def private_moments(rows: DataFrame, bounds: Sequence[float], epsilon: float, seed: str = "moments", x: str = "x") -> DataFrame:
    """(i, mean, spread) of each entry of the arrays ``x``, clipped to its bound: noisy sums over the public count.

    Values are taken as shares of the bound, between -1 and 1. A replaced row moves each sum by 2 and each sum of
    squares by 1, so all of them together by 3 d, and each has noise of scale 3 d / epsilon. Nulls and NaN count as 0. A spread
    is at least a millionth of its bound.
    """
    d = len(bounds)
    scale = 3.0 * d / epsilon
    share = lambda i: _clean(F.get(x, F.lit(i))) / F.lit(float(bounds[i]))
    clip = lambda i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share(i)))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(bounds[i])).alias("bound"),
                 F.sum(clip(i)).alias("s"), F.sum(clip(i) * clip(i)).alias("q")) for i in range(d)]).alias("all"))
    each = sums.select("n", F.explode("all").alias("e")).select("n", "e.*").where("n > 0")
    mean = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("s") + seeded.laplace(f"{seed}-sum", scale, F.col("i"))) / F.col("n")))
    square = (F.col("q") + seeded.laplace(f"{seed}-square", scale, F.col("i"))) / F.col("n")
    noisy = each.select("i", "bound", mean.alias("m"), square.alias("v"))
    return noisy.select("i", (F.col("m") * F.col("bound")).alias("mean"),
                        (F.sqrt(F.greatest(F.lit(1e-12), F.col("v") - F.col("m") * F.col("m"))) * F.col("bound")).alias("spread"))


def _clean(v: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))


class Scaling:
    """Public numbers that scale rows: nothing more of the data is needed."""

    def __init__(self, bounds: Sequence[float], moments: DataFrame):
        found = {r.i: (r["mean"], r.spread) for r in moments.collect()}
        self.parts = [(float(b), *found.get(i, (0.0, float(b)))) for i, b in enumerate(bounds)]

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """``x`` clipped to the bounds, less the mean, in units of the spread."""
        parts = F.lit([list(p) for p in self.parts])
        scaled = F.zip_with(x, parts, lambda v, p: (
            F.greatest(-p[0], F.least(p[0], _clean(v))) - p[1]) / p[2])
        return df.withColumn(x, scaled)


def private_scaling(rows: DataFrame, d: int, epsilon: float, accountant: Accountant, seed: str = "scaling",
                    bounds: Sequence[float] | None = None, x: str = "x") -> Scaling:
    """Scaling that costs ``epsilon`` in all: a third for the bounds, unless the caller knows them, the rest for the moments."""
    if bounds is None:
        first = accountant.charge("bounds", epsilon / 3)
        bounds = private_bounds(rows, d, first, f"{seed}-bounds", x)
        rest = accountant.charge("moments", epsilon - first)
    else:
        rest = accountant.charge("moments", epsilon)
    return Scaling(bounds, private_moments(rows, bounds, rest, f"{seed}-moments", x))
