"""A synthetic problem of two views and four classes, always the same for a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import Config


def problem(spark: SparkSession, seed: int = 1, rows: int = 320, classes: int = 4, widths: tuple[int, int] = (12, 6), per_class: int = 12) -> tuple[DataFrame, DataFrame, DataFrame, Config]:
    """(features, labels, trusted, config). Widths, scales (1.5, 1.2), noise 0.7, rows, classes and trusted rows a class are
    fixed values, so that results compare with published ones."""
    draw = np.random.default_rng(seed)
    y = draw.permutation(np.arange(rows) % classes)
    views = []
    for width, scale in zip(widths, (1.5, 1.2), strict=True):
        v = scale * draw.normal(size=(classes, width))[y] + 0.7 * draw.normal(size=(rows, width))
        views.append(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
    a, b = views
    z = np.concatenate(views, 1) / np.sqrt(2)
    features = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), z[i].tolist()) for i in range(rows)], "id long, view_a array<double>, view_b array<double>, joint array<double>")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, label int")
    first = sorted(int(i) for c in range(classes) for i in np.flatnonzero(y == c)[:per_class])
    trusted = spark.createDataFrame([(i, int(y[i])) for i in first], "id long, label int")
    config = Config(classes, gamma_a=1.0, gamma_b=1.0, gamma_joint=1.0, landmarks=32)
    return features, labels, trusted, config
