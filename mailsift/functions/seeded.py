"""Randomness that depends on the row key and a seed only, never on partitioning.

A task that is run again after a lost executor draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DENOMINATOR = 4503599627370496.0  # 2 ** 52


def digest(seed: str, *keys: Column) -> Column:
    """Hex digest of the seed and the keys, used to order rows at random."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def uniform(seed: str, *keys: Column) -> Column:
    """A number strictly inside (0, 1) from the first 52 bits of the digest."""
    head = F.conv(F.substring(digest(seed, *keys), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(DENOMINATOR)


def laplace(seed: str, scale: float, *keys: Column) -> Column:
    centred = uniform(seed, *keys) - F.lit(0.5)
    return -F.lit(scale) * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def choice(seed: str, n: Column, *keys: Column) -> Column:
    """An index 0..n-1."""
    return F.floor(uniform(seed, *keys) * n).cast("int")
