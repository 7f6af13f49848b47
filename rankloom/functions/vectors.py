"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, kept in the JVM."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def cosine(a: Column, b: Column, unit_length: bool = False) -> Column:
    """Cosine of two vectors; a zero vector gives 0, a missing one null."""
    if unit_length:
        return dot(a, b)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


@F.pandas_udf(DoubleType())
def _batch_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        left = np.stack(a[known].to_numpy()).astype("float64")
        right = np.stack(b[known].to_numpy()).astype("float64")
        dots = np.einsum("ij,ij->i", left, right)
        lengths = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        out[known] = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
    return pd.Series(out).where(known)


def cosine_batched(a: Column, b: Column) -> Column:
    """Cosine with one NumPy call per Arrow batch; for long vectors."""
    return _batch_cosine(a, b)
