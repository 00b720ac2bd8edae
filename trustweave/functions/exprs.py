"""Functions of array columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """body of a value that is computed once, not again for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, which counts as eps at least."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, 1.0).otherwise(0.0))


def softmax(v: Column, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    e = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp((x - m) / temperature)))
    return let(e, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(v: Column) -> Column:
    """Place of the largest value, of equal ones the first."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def standardize(v: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), scale, lambda x, s: x / s)


def joint(a: Column, b: Column) -> Column:
    return F.transform(F.concat(a, b), lambda x: x / F.sqrt(F.lit(2.0)))


def blend(a: Column, b: Column, w: float) -> Column:
    return F.zip_with(a, b, lambda x, y: w * x + (1 - w) * y)


def square_root(v: Column) -> Column:
    return F.transform(v, lambda x: F.sqrt(x))


def patch_normalize(v: Column, eps: float = 10.0) -> Column:
    centred = let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda s: F.transform(c, lambda x: x / s)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    return F.exp(-gamma * squared_distance(a, b))


def normalized_entropy(v: Column, classes: int) -> Column:
    """-sum v ln v over positive values, over ln(classes). v is not made to sum to one."""
    return F.aggregate(F.filter(v, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.ln(x)) / F.ln(F.lit(float(classes)))


def row_weight(trusted: Column, weight: float) -> Column:
    return F.when(trusted, F.lit(float(weight))).otherwise(F.lit(1.0))


def flipped(label: Column, classes: int, bad: Column) -> Column:
    return F.when(bad, classes - 1 - label).otherwise(label)


def sentinel(label: Column, trusted: Column, text: str = "NOT-FOR-TRAINING") -> Column:
    return F.when(trusted, label.cast("string")).otherwise(F.lit(text))


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


def payload_bytes(width: int, classes: int, bytes_each: int = 4) -> int:
    """Bytes of a packed symmetric matrix and a right-hand side."""
    if min(width, classes, bytes_each) <= 0:
        raise ValueError("all sizes must be positive")
    return (width * (width + 1) // 2 + width * classes) * bytes_each
