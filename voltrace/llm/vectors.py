"""Shared by the vector operators: usable vectors, distinct vectors, and training samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def main_width(rows: DataFrame, vector: str) -> int:
    """The most frequent length of vectors, the smaller on ties; 0 for no rows. Vectors of other lengths take no part."""
    best = rows.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    return best[0].width if best else 0


def sample(rows: DataFrame, key: str, vector: str, size: int, total: int) -> np.ndarray:
    """About ``size`` vectors, chosen by a hash of the key, in the order of the key: the same on every run."""
    share = min(1.0, 1.1 * size / max(1, total))
    draw = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30))
    found = rows.filter(draw < F.lit(int(share * (1 << 30)))).orderBy(draw, key).limit(size).select(vector).toArrow()
    return matrix(found.column(0).combine_chunks()) if found.num_rows else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component is taken out first, so that no square over- or underflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
