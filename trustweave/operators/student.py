"""Students: ridge regression of the targets on all rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs
from .arrays import collected, with_array
from .kernels import landmark_map, rbf
from .sampling import landmarks, only_trusted
from .tiles import Tiles, tiled_ridge_solve, tiled_statistics


@dataclass(frozen=True)
class Student:
    weights: np.ndarray
    landmark_ids: np.ndarray | None = None
    landmarks: np.ndarray | None = None
    gamma: float = 0.5

    @property
    def width(self) -> int:
        return self.landmarks.shape[1] if self.landmarks is not None else len(self.weights)

    def _scores(self, z: np.ndarray) -> np.ndarray:
        if len(z) and z.shape[1] != self.width:
            raise ValueError(f"the student was fitted on {self.width} values; it got {z.shape[1]}")
        phi = z if self.landmarks is None else np.concatenate([z, rbf(z, self.landmarks, self.gamma)], 1) / np.sqrt(2.0)
        return phi @ self.weights

    def scores(self, df: DataFrame, joint: str = "joint", out: str = "scores") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)
        return with_array(df, out, [joint], lambda z: shared.value._scores(z))

    def predict(self, df: DataFrame, joint: str = "joint", out: str = "prediction") -> DataFrame:
        """df and the class of the largest score, of equal ones the first."""
        return self.scores(df, joint, "_scores").withColumn(out, exprs.argmax(F.col("_scores"))).drop("_scores")

    def digest(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.weights, "<f8").tobytes()).hexdigest()

    def state(self) -> dict[str, np.ndarray]:
        more = {} if self.landmarks is None else {"student_landmark_indices": self.landmark_ids, "student_landmarks": self.landmarks}
        return {"student_weights": self.weights} | more


def build_targets(probabilities: DataFrame, trusted: DataFrame, n_classes: int, p: str = "p", out: str = "q") -> DataFrame:
    """Rows with q: the label's vector where it is trusted, else the teacher's probabilities; and is_trusted.

    A vector of probabilities of any other length than the classes is refused by the first row that has one."""
    t = trusted.select("id", F.col("label").alias("_label"))
    fits = F.when(F.size(p) == n_classes, F.col(p)).otherwise(F.raise_error(F.concat(F.lit(f"a teacher must give {n_classes} values; it gave "), F.size(p))).cast(probabilities.schema[p].dataType))
    q = F.coalesce(F.when(F.col("_label").isNotNull(), exprs.one_hot(F.col("_label").cast("int"), n_classes)), fits)
    return probabilities.join(t, "id", "left").withColumn(out, q).withColumn("is_trusted", F.col("_label").isNotNull()).drop("_label")


def target_digest(targets: DataFrame, q: str = "q") -> str:
    """Digest of the targets by id that does not depend on how rows are dealt out: a sum of row digests."""
    h = F.xxhash64("id", q)
    r = targets.agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(q, "id")).alias("x"), F.count(F.lit(1)).alias("n")).collect()[0]
    return hashlib.sha256(f"{r['s']}|{r['x']}|{r['n']}".encode()).hexdigest()


def fit_linear(targets: DataFrame, config: Config | None = None, joint: str = "joint", q: str = "q", trusted: DataFrame | None = None, shared: Tiles | None = None) -> Student:
    """Ridge weights with trusted rows counted trusted_weight times: the sums over all rows, which `shared` may bring along
    from another fit on the same rows and targets, and a correction from the trusted rows. Sums stay tiles on the
    executors; see tiled_ridge_solve for what comes to the driver."""
    config = config or Config()
    total = shared or tiled_statistics(targets, joint, q)
    if trusted is not None and config.trusted_weight != 1.0:
        extra = tiled_statistics(only_trusted(targets, trusted), joint, q).scaled(config.trusted_weight - 1.0, 1)
        total = total.plus(extra).combined()
    return Student(tiled_ridge_solve(total, config.linear_ridge))


def fit_landmark(targets: DataFrame, config: Config | None = None, joint: str = "joint", q: str = "q", landmark_ids: list[int] | None = None) -> Student:
    config = config or Config(student="landmark")
    if landmark_ids is None:
        chosen = landmarks(targets.withColumn("joint", F.col(joint)), config.landmarks, config.landmark_seed)
    else:
        if len(landmark_ids) != config.landmarks or len(set(landmark_ids)) != len(landmark_ids):
            raise ValueError("landmark ids must be unique and as many as the settings say")
        chosen = targets.filter(F.col("id").isin([int(x) for x in landmark_ids])).select("id", F.col(joint).alias("joint")).orderBy("id")
    ids, marks = collected(chosen, "id", "joint")
    if len(ids) != config.landmarks:
        raise ValueError("a landmark id is not among the rows")
    total = tiled_statistics(landmark_map(targets.select("id", joint, q), marks, config.landmark_gamma, joint), "phi", q)
    return Student(tiled_ridge_solve(total, config.landmark_ridge), ids, marks, config.landmark_gamma)
