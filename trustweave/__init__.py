"""Learning from tables in which only some labels can be trusted, on Spark."""

__version__ = "0.2.0"

from .config import Config, Features
from .functions.exprs import argmax, one_hot, payload_bytes, row_normalize, row_weight, softmax
from .operators.audit import AuditReport, federated_audit, mutation_audit
from .operators.features import ColorModel, PatchModel, block_means, fit_color, fit_patches, gradient_histogram
from .operators.kernels import landmark_map, rbf, squared_distances
from .operators.pipeline import Model, fit, fit_images
from .operators.sampling import balanced_sample, landmarks, owners
from .operators.stats import RidgeStatistics, client_statistics, combine
from .operators.student import Student, build_targets, fit_landmark, fit_linear
from .operators.teacher import Teacher, fit_teacher
from .operators.tiles import Tiles, central_ridge, combine_tiles, tiled_ridge_solve, tiled_statistics
from .sources.images import read_folder, read_labels, read_records
from .sources.model_store import fingerprint, load, save

__all__ = [
    "AuditReport", "ColorModel", "Config", "Features", "Model", "PatchModel", "RidgeStatistics", "Student", "Teacher", "Tiles", "__version__", "argmax", "balanced_sample", "block_means",
    "build_targets", "central_ridge", "client_statistics", "combine", "combine_tiles", "federated_audit", "fingerprint", "fit", "fit_color", "fit_images", "fit_landmark", "fit_linear", "fit_patches",
    "fit_teacher", "gradient_histogram", "landmark_map", "landmarks", "load", "mutation_audit", "one_hot", "owners", "payload_bytes", "rbf", "read_folder", "read_labels",
    "read_records", "row_normalize", "row_weight", "save", "softmax", "squared_distances", "tiled_ridge_solve", "tiled_statistics",
]
