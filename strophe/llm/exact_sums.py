"""Exact sums of 64-bit integers and of their products, of any size, by Spark's own aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A whole number is the sum of its limbs times 2 ** (32 i); the last limb has the sign.
LIMBS = 6
NAMES = tuple(f"_limb{i}" for i in range(LIMBS))
_FIELDS = ", ".join(f"{n} long" for n in NAMES)


def schema(keys: str) -> str:
    return f"{keys}, {_FIELDS}"


def split(numbers: list[int]) -> list[list[int]]:
    """The limbs of whole numbers, limb by limb."""
    low = [[(x >> (32 * i)) & 0xFFFFFFFF for x in numbers] for i in range(LIMBS - 1)]
    return [*low, [x >> (32 * (LIMBS - 1)) for x in numbers]]


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """The sums of limbs by keys: 2 ** 31 parts of a key can be added before a limb is full."""
    return parts.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in NAMES))


def joined(row) -> int:
    return sum(row[n] << (32 * i) for i, n in enumerate(NAMES))


def small(x: np.ndarray, limit: int) -> np.ndarray:
    """x as it is where no value is beyond limit, else as whole numbers of any size."""
    return x if not x.size or (int(x.max()) <= limit and int(x.min()) >= -limit) else x.astype(object)
