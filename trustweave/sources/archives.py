"""Models as a compressed archive of arrays and a JSON text with their digests: a layout of other programs, read and written."""

from __future__ import annotations

import hashlib
import io
import json
import warnings
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config, Features
from ..operators.pipeline import Model
from .model_store import array_digest, model_of, state_of

#: Bytes of an archive, and of its arrays when opened, that the driver takes.
MAX_BYTES, MAX_OPEN = 1 << 30, 8 << 30

# Fixed values of the layout: file names, versions, and names of arrays and settings with ours beside them.
TEXT, ARRAYS, VERSIONS = "metadata.json", "model.npz", (1, 2, 3)
NAMES = {
    "teacher_view_a_anchor": "anchor_view_a", "teacher_view_b_anchor": "anchor_view_b", "teacher_joint_anchor": "anchor_joint",
    "teacher_alpha_a": "alpha_view_a", "teacher_alpha_b": "alpha_view_b", "teacher_alpha_joint": "alpha_joint",
    "student_weights": "student_weights", "student_landmark_indices": "student_landmark_indices", "student_landmarks": "student_landmarks",
    "feature_color_mean": "image_mean", "feature_color_scale": "image_scale", "kmeans_patch_mean": "image_patch_mean", "kmeans_whitening": "image_whitening",
    "kmeans_centroids": "image_centroids", "kmeans_feature_mean": "image_feature_mean", "kmeans_feature_scale": "image_feature_scale",
    "trusted_indices": "trusted_ids", "trusted_labels": "trusted_labels",
}
STUDENTS = {"kmeans": "linear", "landmark": "landmark"}
SETTINGS = {
    "teacher": {"gamma_view_a": "gamma_a", "gamma_view_b": "gamma_b", "view_a_weight": "share_a", "ridge": "teacher_ridge", "temperature": "temperature"},
    "student": {"landmark_count": "landmarks", "landmark_seed": "landmark_seed", "landmark_gamma": "landmark_gamma", "ridge": "landmark_ridge"},
    "kmeans_teacher": {"gamma": "gamma_joint", "ridge": "joint_ridge", "weight": "share_joint", "temperature": "joint_temperature"},
    "linear_student": {"ridge": "linear_ridge", "trusted_weight": "trusted_weight"},
}
IMAGE_SETTINGS = {
    "feature": {"color_floor": "color_floor", "normalization_eps": "unit_floor"},
    "kmeans": {"centroids": "centroids", "patch_size": "patch_side", "patch_samples": "patches", "iterations": "rounds", "seed": "seed", "patch_norm_eps": "patch_floor", "zca_eps": "whitening_floor", "standardize_floor": "scale_floor"},
}
#: Settings of how a program runs, which change no result and have no place here.
IGNORED = {"chunk_size", "workers"}
FORMAT, KIND = "untrusted-label-only", "validated_threat_model"


def _settings(given: dict, names: dict[str, dict[str, str]]) -> dict:
    out = {}
    for part, own in names.items():
        for k, v in given.get(part, {}).items():
            if k in own:
                out[own[k]] = v
            elif k not in IGNORED:
                raise ValueError(f"there is no setting {part}.{k}")
    return out


def settings_of(given: dict) -> tuple[Config, Features]:
    """Settings out of the text's; what is missing has its default, a name that isn't known is refused. Texts without an
    architecture are of the landmark kind."""
    if unknown := given.keys() - SETTINGS.keys() - IMAGE_SETTINGS.keys() - {"n_classes", "architecture"}:
        raise ValueError(f"there is no setting {min(unknown)}")
    kind = given.get("architecture", "landmark")
    if kind not in STUDENTS:
        raise ValueError(f"there is no architecture {kind}")
    return Config(int(given["n_classes"]), STUDENTS[kind], **_settings(given, SETTINGS)), Features(**_settings(given, IMAGE_SETTINGS))


def _bytes(spark: SparkSession, at: str, most: int) -> bytes:
    """A file through the cluster's file system, if it isn't larger than `most`."""
    file = spark.read.format("binaryFile").load(at)
    if file.agg(F.sum("length").alias("n")).collect()[0]["n"] > most:
        raise ValueError(f"{at} has over {most} bytes")
    return bytes(file.select("content").collect()[0]["content"])


def _put(spark: SparkSession, at: str, body: bytes) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(body))
    out.close()


def fingerprint(spark: SparkSession, folder: str) -> str:
    """SHA-256 of the text, which has every array's digest from version 2 on."""
    return hashlib.sha256(_bytes(spark, f"{folder}/{TEXT}", MAX_BYTES)).hexdigest()


def _opened(body: bytes) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        if sum(x.file_size for x in z.infolist()) > MAX_OPEN:
            raise ValueError(f"the arrays have over {MAX_OPEN} bytes")
    with np.load(io.BytesIO(body), allow_pickle=False) as z:
        return {n: z[n] for n in z.files}


def load(spark: SparkSession, folder: str, expected: str | None = None) -> Model:
    """The model of a folder, of version 1 to 3. Refuses another fingerprint than the expected one, other versions, arrays that
    are not exactly those that the text names with their digests (version 1 has none, which is warned of), weights of another
    digest than the text's, and arrays or settings of unknown names."""
    sealed = _bytes(spark, f"{folder}/{TEXT}", MAX_BYTES)
    if expected not in (None, hashlib.sha256(sealed).hexdigest()):
        raise ValueError("the model's fingerprint is another one")
    text = json.loads(sealed)
    version = int(text["format_version"])
    if version not in VERSIONS:
        raise ValueError(f"models of version {version} can't be read")
    config, how = settings_of(text["config"])
    found = _opened(_bytes(spark, f"{folder}/{ARRAYS}", MAX_BYTES))
    if version > 1:
        digests, named = {k: array_digest(v) for k, v in found.items()}, text["array_sha256"]
        if wrong := sorted(k for k in digests.keys() | named.keys() if digests.get(k) != named.get(k)):
            raise ValueError(f"array {wrong[0]} is not the one that was saved")
    else:
        warnings.warn("of a model of version 1 the student's weights alone are checked", stacklevel=2)
    if unknown := found.keys() - NAMES.keys():
        raise ValueError(f"array {min(unknown)} is not known")
    model = model_of({NAMES[k]: v for k, v in found.items()}, config, how, text.get("target_hash"))
    if text.get("student_weight_hash") not in (None, "", model.student.digest()):
        raise ValueError("the student's weights are not those that were saved")
    return model


def save(spark: SparkSession, model: Model, folder: str, include_trusted: bool = True) -> str:
    """Writes a model of version 3 and returns its fingerprint. Digests of targets are ours: they compare with ours alone."""
    ours = {v: k for k, v in NAMES.items()}
    state = {ours[k]: v for k, v in state_of(model, include_trusted).items()}
    body = io.BytesIO()
    np.savez_compressed(body, **state)
    config, how = model.config, model.patches.config if model.patches else Features()
    kind = next(k for k, v in STUDENTS.items() if v == config.student)
    parts = {p: {k: getattr(s, own) for k, own in names.items()} for s, group in ((config, SETTINGS), (how, IMAGE_SETTINGS)) for p, names in group.items()}
    text = {
        "format_version": VERSIONS[-1], "architecture": kind, "config": {"n_classes": config.classes, "architecture": kind} | parts, "target_hash": model.target_digest,
        "student_weight_hash": model.student.digest(), "array_sha256": {k: array_digest(v) for k, v in sorted(state.items())}, KIND: FORMAT,
    }
    sealed = json.dumps(text, indent=2).encode()
    _put(spark, f"{folder}/{ARRAYS}", body.getvalue())
    _put(spark, f"{folder}/{TEXT}", sealed)
    return hashlib.sha256(sealed).hexdigest()
