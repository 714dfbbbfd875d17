"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def maxsim(q: Column, d: Column) -> Column:
    """Late interaction: for each query token its best document token, summed."""
    return F.aggregate(F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y)))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two term -> weight maps, over their shared keys."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)


def mrl(v: Column, dim: int) -> Column:
    """The first dim components, rescaled to length one."""
    head = F.slice(v, 1, dim)
    n = norm(head)
    return F.when(n == 0, F.transform(head, lambda x: x.cast("double"))).otherwise(F.transform(head, lambda x: x.cast("double") / n))


def encode(v: Column, kind: str) -> Column:
    """A vector as a little-endian blob: ``f4`` single, ``f2`` half precision."""

    def run(vecs: pd.Series) -> pd.Series:
        return vecs.map(lambda x: None if x is None else np.asarray(x).astype(f"<{kind}").tobytes())

    run.__annotations__ = {"vecs": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(v)


def decode(blob: Column, kind: str) -> Column:
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda x: None if x is None else np.frombuffer(x, f"<{kind}").astype(np.float32))

    run.__annotations__ = {"blobs": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(blob)
