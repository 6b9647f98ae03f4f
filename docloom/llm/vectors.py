"""Shared helpers for tables of vectors: which take part, Arrow batches as matrices, exact integer products."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers below this are exact as doubles, and so are sums and products that stay below it.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def sound(vectors: DataFrame) -> DataFrame:
    """The rows whose ``embedding`` is there and holds finite numbers only, as array<double>."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).filter(F.col("embedding").isNotNull() & finite)


def on_lattice(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double; from 2^53 on every double is an integer already. Beyond the largest double it is that."""
    scaled, most = x * F.lit(float(scale)), F.lit(sys.float_info.max)
    return F.when(F.abs(scaled) < F.lit(EXACT), F.floor(scaled).cast("double")).otherwise(F.greatest(F.least(scaled, most), -most))


def matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors of an Arrow column."""
    values, lengths = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for d in np.unique(lengths):
        places = np.flatnonzero(lengths == d)
        yield places, values[begins[places][:, None] + np.arange(d)]


def products(vectors: np.ndarray, query: np.ndarray, largest: float | None = None) -> np.ndarray:
    """Exact inner products of integer-valued doubles as longs; one that does not fit counts as the nearest long.

    ``largest``: the largest absolute component of ``vectors``, if known.
    """
    if not len(vectors) or not len(query):
        return np.zeros(len(vectors), np.int64)
    most = np.abs(vectors).max() if largest is None else largest
    if most * np.abs(query).max() * len(query) < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    return np.array([max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(row, whole)))) for row in vectors], np.int64)
