"""Fit and use of teacher and student together."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, Features
from ..functions import exprs
from ..functions.checks import check_trusted, check_vectors
from .features import PIXELS, ColorModel, PatchModel, fit_color, fit_patches
from .student import Student, build_targets, fit_landmark, fit_linear, target_digest
from .teacher import Teacher, fit_teacher


@dataclass(frozen=True)
class Model:
    """What a fit gives. No step of it takes the untrusted labels."""

    config: Config
    teacher: Teacher
    student: Student
    target_digest: str
    trusted_ids: np.ndarray | None = None
    trusted_labels: np.ndarray | None = None
    color: ColorModel | None = None
    patches: PatchModel | None = None

    def predict(self, features: DataFrame) -> DataFrame:
        check_vectors(features, ["joint"], {"joint": self.student.width})
        return self.student.predict(features)

    def scores(self, features: DataFrame) -> DataFrame:
        return self.student.scores(features)

    def teacher_probabilities(self, features: DataFrame) -> DataFrame:
        missing = [v for v in self.teacher.views if v not in features.columns]
        if missing:
            raise ValueError(f"the teacher also needs {', '.join(missing)}")
        return self.teacher.probabilities(features)

    def image_joint(self, images: DataFrame) -> DataFrame:
        """Only what the student reads; other views are not computed."""
        if self.color is None:
            raise RuntimeError("the model was not fitted on images")
        check_vectors(images, ["pixels"], {"pixels": PIXELS})
        return self.patches.transform(images) if self.patches else self.color.transform(images).select("id", "joint")

    def predict_images(self, images: DataFrame) -> DataFrame:
        return self.student.predict(self.image_joint(images))

    def score_images(self, images: DataFrame, labels: DataFrame) -> float:
        return self.predict_images(images).join(labels, "id").agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a")).collect()[0]["a"]


def fit(features: DataFrame, trusted: DataFrame, config: Config | None = None, landmark_ids: list[int] | None = None) -> Model:
    """features: (id, view_a, view_b, joint); trusted: (id, label)."""
    config = config or Config()
    f = features.select("id", *(F.col(v).cast("array<double>").alias(v) for v in ("view_a", "view_b", "joint")))
    t = trusted.select("id", "label")
    check_vectors(f, ["view_a", "view_b", "joint"])
    check_trusted(t, f, config.classes)
    teacher = fit_teacher(f, t, config)
    targets = build_targets(teacher.probabilities(f), t, config.classes).select("id", "joint", "q").persist()
    try:
        student = fit_linear(targets, config, trusted=t) if config.student == "linear" else fit_landmark(targets, config, landmark_ids=landmark_ids)
        digest = target_digest(targets)
    finally:
        targets.unpersist()
    rows = t.orderBy("id").collect()
    return Model(config, teacher, student, digest, np.array([r["id"] for r in rows]), np.array([int(r["label"]) for r in rows]))


def image_views(images: DataFrame, config: Config, how: Features | None = None, color: ColorModel | None = None, patches: PatchModel | None = None):
    """(features, color, patches); what isn't given is fitted on the images."""
    color = color or fit_color(images, how)
    views = color.transform(images)
    if not config.joint_teacher:
        return views, color, None
    patches = patches or fit_patches(images, how)
    return views.drop("joint").join(patches.transform(images), "id"), color, patches


def fit_images(images: DataFrame, trusted: DataFrame, config: Config | None = None, how: Features | None = None) -> Model:
    """images: (id, pixels of 3 * 32 * 32 in channel, row, column order, from 0 to 1)."""
    config = config or Config()
    features, color, patches = image_views(images, config, how)
    features = features.persist()
    try:
        m = fit(features, trusted, config)
    finally:
        features.unpersist()
    return replace(m, color=color, patches=patches)
