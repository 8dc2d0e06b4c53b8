"""Buckets of ranks when rows arrive in another order each time, as they do from several executors."""

import numpy as np

from mailsift.operators import ranking


def unsteady(spark, n):
    """0..n-1, dealt to other partitions whenever it is evaluated."""
    def dealt(batches):
        for pdf in batches:
            yield pdf.assign(part=np.random.default_rng().integers(0, 1000, len(pdf)))
    return spark.range(0, n, 1, 4).withColumnRenamed("id", "v").mapInPandas(dealt, "v bigint, part bigint").repartition(4, "part")


def test_buckets_are_the_same_in_every_evaluation(spark):
    rows = ranking.with_value_bucket(unsteady(spark, 60_000), "v", 4)
    first, second = (sorted(map(tuple, rows.groupBy("_bucket").count().collect())) for _ in range(2))
    assert len(first) > 8 and first == second
