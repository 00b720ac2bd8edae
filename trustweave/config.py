"""Settings: one object for features, one for a fit."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

#: What a student is fitted on: the joint view as it is, or that and its similarities to landmarks.
STUDENTS = ("linear", "landmark")


def _checked(settings, free: set[str], shares: set[str] = frozenset()) -> None:
    """Shares lie in [0, 1], all other numbers but the free ones are positive."""
    for f in fields(settings):
        x = getattr(settings, f.name)
        if f.name in shares and not 0 <= x <= 1:
            raise ValueError(f"{f.name} must lie in [0, 1]")
        if f.name not in free | shares and not x > 0:
            raise ValueError(f"{f.name} must be positive")


@dataclass(frozen=True)
class Features:
    """Features of images. The numbers are fixed values: published defaults that results depend on."""

    unit_floor: float = 1e-12
    color_floor: float = 0.01
    patch_side: int = 6
    patches: int = 400_000
    centroids: int = 1600
    rounds: int = 15
    seed: int = 0
    patch_floor: float = 10.0
    whitening_floor: float = 0.1
    scale_floor: float = 1e-3

    def __post_init__(self):
        _checked(self, {"seed"})
        if self.patch_side > 32:
            raise ValueError("patch_side must be at most 32")
        if self.centroids > self.patches:
            raise ValueError("there must be at least as many patches as centroids")


@dataclass(frozen=True)
class Config:
    """A fit. student linear: a teacher on three views and a student on the joint one; landmark: a teacher on two views and
    a student that also has similarities to landmarks. The numbers are fixed values: published defaults that results
    depend on."""

    classes: int = 10
    student: str = "linear"
    gamma_a: float = 4.0
    gamma_b: float = 0.25
    share_a: float = 0.75
    temperature: float = 0.1
    gamma_joint: float = 0.5
    share_joint: float = 0.5
    joint_temperature: float = 0.05
    teacher_ridge: float = 0.1
    joint_ridge: float = 0.1
    linear_ridge: float = 0.03
    trusted_weight: float = 10.0
    landmarks: int = 256
    landmark_seed: int = 29002
    landmark_gamma: float = 0.5
    landmark_ridge: float = 1.0

    def __post_init__(self):
        _checked(self, {"student", "landmark_seed"}, {"share_a", "share_joint"})
        if self.classes < 2:
            raise ValueError("there must be at least 2 classes")
        if self.student not in STUDENTS:
            raise ValueError(f"student must be one of {', '.join(STUDENTS)}")

    @property
    def joint_teacher(self) -> bool:
        return self.student == "linear"

    @property
    def student_ridge(self) -> float:
        return self.linear_ridge if self.student == "linear" else self.landmark_ridge


def as_dict(settings: Features | Config) -> dict:
    return asdict(settings)


def from_dict(kind: type, given: dict) -> Features | Config:
    """Settings out of a dictionary; a name that there isn't is refused, one that is missing has its default."""
    return kind(**given)
