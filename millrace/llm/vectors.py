"""Integer vectors of an embedding table, and the bounded exchange of per-task sums that Lloyd rounds need."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integers(df: DataFrame, scale: int, id_col: str, vec_col: str, more: dict[str, str] | None = None) -> DataFrame:
    """(vec_id, v, ...) of the rows whose vector is neither null nor holds a null or non-finite component: v is floor(scale * x) of each component taken as double.

    more: further columns, by their new names. Nothing else is read, so other columns cannot clash."""
    x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), *(F.col(c).alias(k) for k, c in (more or {}).items()))
    whole = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.where(F.col("v").isNotNull() & whole).withColumn("v", F.transform("v", lambda c: F.floor(c * float(scale))))


def matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows. A component so large that a squared distance might not fit a long is an error, not a wrong number."""
    v = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    if v.size and max(int(v.max()), -int(v.min())) >= (most := math.isqrt((1 << 60) // v.shape[1])):  # 2^27 for 64 components
        raise ValueError(f"a scaled component reaches {most}: squared distances would not fit a long")
    return v


def summed(sums: DataFrame, keys: list[str], width: int) -> dict[tuple, tuple[int, list[int]]]:
    """(keys, n, s) rows of all tasks added up: key -> (count, component sums). The keys are those of a codebook, so few rows reach the driver."""
    total = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)))
    return {tuple(r[k] for k in keys): (r.n, [r[f"s{i}"] for i in range(width)]) for r in total.collect()}


def digest(components) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in components).encode()).hexdigest()
