"""Validation, one aggregate a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .faults import availability_faults, faults, integral_rules, label_faults, refuse, trusted_faults, vector_rules, weight_rules


def check_vectors(df: DataFrame, columns: list[str], widths: dict[str, int] | None = None) -> dict[str, int]:
    """Widths of array columns; raises if one is null, holds nulls or values that aren't finite, or varies or differs
    from the width asked for. Empty tables have the widths asked for, or 0."""
    rules = {n: bad for c in columns for n, bad in vector_rules(c).items()}
    sizes = [f(F.size(c)).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]
    r = df.agg(*(F.count_if(bad).alias(n) for n, bad in rules.items()), *sizes).collect()[0]
    out = {}
    for c in columns:
        want = (widths or {}).get(c)
        if bad := [f"{n} ({r[n]} rows)" for n in vector_rules(c) if r[n]]:
            raise ValueError("; ".join(bad))
        if r[f"{c}_lo"] != r[f"{c}_hi"]:
            raise ValueError(f"{c} has vectors of {r[f'{c}_lo']} to {r[f'{c}_hi']} values")
        if want is not None and r[f"{c}_hi"] not in (None, want):
            raise ValueError(f"{c} must have {want} values; it has {r[f'{c}_hi']}")
        out[c] = r[f"{c}_hi"] if r[f"{c}_hi"] is not None else want or 0
    return out


def _numeric(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"{column} must hold integers")


def check_integral(df: DataFrame, column: str) -> None:
    """Integers, or floating values that are whole; booleans, strings, nulls and fractions are refused."""
    _numeric(df, column)
    refuse(faults(df, integral_rules(column), column))


def check_trusted(trusted: DataFrame, examples: DataFrame, n_classes: int) -> None:
    """Trusted rows (id, label): some, ids unique and among the examples, labels in [0, n_classes)."""
    _numeric(trusted, "id")
    _numeric(trusted, "label")
    refuse(trusted_faults(trusted, examples, n_classes))


def check_weights(df: DataFrame, column: str) -> None:
    refuse(faults(df, weight_rules(column), column))


def check_available(labels: DataFrame, per_class: int, n_classes: int) -> None:
    """Every class, also one that is absent, has per_class rows."""
    if per_class <= 0:
        raise ValueError("per_class must be positive")
    refuse(availability_faults(labels, per_class, n_classes))


def check_statistics(stats: list) -> None:
    """Client statistics of one shape, finite and symmetric (relative 1e-10, absolute 1e-8)."""
    if not stats:
        raise ValueError("at least one client is needed")
    shape = stats[0].a.shape, stats[0].b.shape
    for s in stats:
        if (s.a.shape, s.b.shape) != shape or s.a.shape[0] != s.a.shape[1] or s.b.shape[0] != s.a.shape[0]:
            raise ValueError("clients differ in their dimensions")
        if not (np.isfinite(s.a).all() and np.isfinite(s.b).all()):
            raise ValueError("a client's statistics hold NaN or infinite values")
        if not np.allclose(s.a, s.a.T, rtol=1e-10, atol=1e-8):
            raise ValueError("a client's matrix is not symmetric")


def check_same_labels(a: DataFrame, b: DataFrame, trusted: DataFrame) -> None:
    """Both label tables (id, label as text) agree on the trusted ids."""
    refuse(label_faults(a, b, trusted))
