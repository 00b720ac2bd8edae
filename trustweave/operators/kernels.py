"""Distances and kernels between rows and a few anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from .arrays import with_array


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances through one matrix product; rounding below zero is cut off."""
    if a.ndim != 2 or b.ndim != 2 or a.shape[1] != b.shape[1]:
        raise ValueError("both sides need vectors of one width")
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T), 0.0)


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    return np.exp(-gamma * squared_distances(a, b))


def anchor_similarities(df: DataFrame, anchors: DataFrame, gamma: float, vector: str = "v") -> DataFrame:
    """(id, anchor, d2, k) as columns: rows by a fixed number of anchors (id, v), which are broadcast."""
    a = anchors.select(F.col("id").alias("anchor"), F.col("v").alias("_a"))
    d2 = exprs.squared_distance(F.col(vector), F.col("_a"))
    return df.crossJoin(F.broadcast(a)).select("id", "anchor", d2.alias("d2")).withColumn("k", F.exp(-gamma * F.col("d2")))


def nearest(df: DataFrame, centroids: DataFrame, vector: str = "v") -> DataFrame:
    """(id, centroid, d2): of equally near ones the first."""
    return anchor_similarities(df, centroids, 1.0, vector).groupBy("id").agg(F.min(F.struct("d2", "anchor")).alias("m")).select("id", F.col("m.anchor").alias("centroid"), F.col("m.d2").alias("d2"))


def landmark_map(df: DataFrame, landmarks: np.ndarray, gamma: float, joint: str = "joint", out: str = "phi", chunk: int = 2000) -> DataFrame:
    """df and [z, rbf(z, landmarks)] / sqrt(2)."""
    shared = df.sparkSession.sparkContext.broadcast(landmarks)
    return with_array(df, out, [joint], lambda z: np.concatenate([z, rbf(z, shared.value, gamma)], 1) / np.sqrt(2.0), chunk)
