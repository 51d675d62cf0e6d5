"""Column expressions on ``array<double>`` vectors, and the registry of premetrics."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Premetric = Callable[[Column, Column], Column]


def total(values: Column) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def diagonal_gaussian(a: Column, b: Column) -> Column:
    """Distance of diagonal Gaussians given as d means followed by d deviations.

    Square root of twice the sum of squared mean differences over the pooled variance plus the log
    of that variance over the product of deviations; small floors keep it finite.
    """
    d = (F.size(a) / 2).cast("int")
    mu = F.zip_with(F.slice(a, 1, d), F.slice(b, 1, d), lambda x, y: (x - y) * (x - y))
    s = lambda v: F.transform(F.slice(v, d + 1, d), lambda x: x + F.lit(1e-8))
    var = F.zip_with(s(a), s(b), lambda x, y: (x * x + y * y) / 2 + F.lit(1e-8))
    prod = F.zip_with(s(a), s(b), lambda x, y: x * y)
    ratio = F.zip_with(F.zip_with(mu, var, lambda m, v: m / v), F.zip_with(var, prod, lambda v, p: F.ln(F.greatest(v, F.lit(1e-16)) / p)), lambda x, y: x + y)
    return F.sqrt(F.greatest(F.lit(1e-30), 2 * total(ratio)))


_REGISTRY: dict[str, Premetric] = {"euclidean": euclidean, "manhattan": manhattan, "diagonal_gaussian": diagonal_gaussian}


def register_premetric(name: str, fn: Premetric) -> None:
    """Make a premetric known by name."""
    _REGISTRY[name] = fn


def premetric(which: str | Premetric) -> Premetric:
    """A registered premetric, a callable as it is, or one imported from ``module:function``."""
    if callable(which):
        return which
    if which in _REGISTRY:
        return _REGISTRY[which]
    module, sep, name = which.partition(":")
    if not sep:
        raise ValueError(f"unknown premetric {which!r}")
    return getattr(importlib.import_module(module), name)


def scalar_premetric(fn: Callable) -> Premetric:
    """A premetric from a Python function of two NumPy vectors, applied in Arrow batches."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(fn(np.asarray(x), np.asarray(y))) for x, y in zip(a, b)])

    return run


def vector_premetric(fn: Callable) -> Premetric:
    """A premetric from a Python function of two NumPy matrices, a distance a row."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(np.stack(a.to_numpy()), np.stack(b.to_numpy()))) if len(a) else pd.Series([], dtype=float)

    return run


def feature_columns(df: DataFrame, id_col: str, columns: list[str] | None = None) -> list[str]:
    """The given columns, or all numeric ones but the id."""
    if columns is not None:
        return columns
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != id_col]


def with_features(df: DataFrame, id_col: str, columns: list[str] | None = None, into: str = "features") -> DataFrame:
    """``(id, features)``: numeric columns as one ``array<double>``."""
    cols = feature_columns(df, id_col, columns)
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias(into))


def logspace_embedding(mu: Column, sigma: Column) -> Column:
    """Interleaves mu / sigma and sqrt(2) * ln(sigma)."""
    pairs = F.zip_with(mu, sigma, lambda m, s: F.array(m / s, F.lit(math.sqrt(2.0)) * F.ln(s)))
    return F.flatten(pairs)


def gaussian_similarity(d: Column, scale: Column | float) -> Column:
    """exp(-(d / scale)^2 / 2)."""
    return F.exp(-F.pow(d / scale, 2) / 2)


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson power transform."""
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, lam) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)
