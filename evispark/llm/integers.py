"""Vectors as integers: the one rule by which operators that need exact arithmetic read ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components are held between -MOST and MOST, so that sums of products of 4,096 components stay 64-bit.
MOST = 1 << 22
#: Doubles hold every integer up to here.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def scaled(embeddings: DataFrame, scale: int, *more: Column) -> DataFrame:
    """vec_id, ``more`` and q, the components as floor(scale * x) held to [-MOST, MOST], of the rows
    whose vector is ``finite``."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.transform(vector, lambda v: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), v * F.lit(float(scale))))).cast("int"))
    return embeddings.where(finite(vector)).select(F.col("vec_id").cast("long").alias("vec_id"), *more, whole.alias("q"))


def padded(rows: DataFrame, width: int) -> Column:
    """q with zeros behind it up to ``width`` components."""
    return F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer rows, exactly: in doubles while every sum fits into one."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
