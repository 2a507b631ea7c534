"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

METRICS = ("cosine", "dot", "l2")


def literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def score(vector: Column, query: Sequence[float], metric: str) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "cosine":  # the query's length is a constant
        length = float(np.sqrt(sum(float(x) * float(x) for x in query)))
        lengths = norm(vector) * F.lit(length)
        return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(vector, literal(query)) / lengths)
    return {"dot": dot, "l2": l2}[metric](vector, literal(query))


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised transform of each row; the length is a power of two."""
    n = x.shape[-1]
    if n & (n - 1) or not n:
        raise ValueError("the length has to be a power of two")
    out = x.astype(np.float64)
    size = 1
    while size < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * size), 2, size)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        size *= 2
    return out / np.sqrt(n)


@F.arrow_udf(ArrayType(DoubleType()))
def hadamard(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else walsh_hadamard(np.array(v)).tolist() for v in vectors.to_pylist()], pa.list_(pa.float64()))
