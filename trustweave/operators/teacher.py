"""Teachers: kernel ridge regression on the trusted rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.shared import Store
from .arrays import collected, with_array
from .gradient import kernel_solve
from .kernels import rbf
from .solve import ridge_solve

#: Trusted rows whose kernel matrix is solved on the driver, bytes of anchors there, and bytes of anchors that a task holds.
DIRECT, MAX_BYTES, ANCHOR_BYTES = 20_000, 4 << 30, 256 << 20
VIEWS = ("view_a", "view_b", "joint")


def _dual(v: np.ndarray, y: np.ndarray, gamma: float, ridge: float) -> np.ndarray:
    return ridge_solve(rbf(v, v, gamma), y, ridge)


def _softmax(raw: np.ndarray, temperature: float) -> np.ndarray:
    z = raw / temperature
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Teacher:
    """Fitted teacher. anchors and alphas by view: view_a, view_b and, if it blends, joint."""

    config: Config
    anchors: dict[str, np.ndarray]
    alphas: dict[str, np.ndarray]

    @property
    def views(self) -> list[str]:
        return list(self.anchors)

    def _raw(self, *views: np.ndarray) -> np.ndarray:
        """Scores of rows, or of what some of the anchors add to them: scores are sums over anchors."""
        c = self.config
        one = [rbf(v, self.anchors[n], _settings(c)[n][0]) @ self.alphas[n] for v, n in zip(views, self.anchors, strict=True)]
        if len(one) == 1:
            return one[0]
        raw = c.share_a * one[0] + (1 - c.share_a) * one[1]
        return c.share_joint * one[2] + (1 - c.share_joint) * raw if "joint" in self.anchors else raw

    def _blocks(self, rows: int | None) -> list[Teacher]:
        """Teachers of `rows` anchors each (as many as have ANCHOR_BYTES), whose scores add up to this one's."""
        n = len(next(iter(self.anchors.values())))
        rows = rows or max(1, ANCHOR_BYTES // (8 * sum(a.shape[1] for a in self.anchors.values())))
        part = lambda m, at: {k: v[at : at + rows] for k, v in m.items()}
        return [self] if n <= rows else [Teacher(self.config, part(self.anchors, at), part(self.alphas, at)) for at in range(0, n, rows)]

    def _with(self, df: DataFrame, out: str, make, block: int | None) -> DataFrame:
        parts = self._blocks(block)
        send = df.sparkSession.sparkContext.broadcast
        if len(parts) == 1:
            shared = send(self)
            return with_array(df, out, self.views, lambda *v: make(shared.value._raw(*v)))
        each = None
        for at, part in enumerate(parts):
            shared = send(part)
            some = with_array(df.select("id", *self.views), "part", self.views, lambda *v, shared=shared: shared.value._raw(*v)).select("id", F.struct(F.lit(at).alias("at"), "part").alias("s"))
            each = some if each is None else each.unionByName(some)
        added = each.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("s"))  # a vector of scores for each block
        raw = F.aggregate("s", F.array(*[F.lit(0.0)] * self.config.classes), lambda t, x: F.zip_with(t, x["part"], lambda a, b: a + b))
        summed = with_array(added.select("id", raw.alias("raw")), out, ["raw"], make).select("id", out)
        return df.drop(out).join(summed, "id")

    def scores(self, df: DataFrame, out: str = "raw", block: int | None = None) -> DataFrame:
        """df and the raw score of each class. Anchors of over ANCHOR_BYTES (block: of over so many rows) go to tasks in blocks:
        rows are read once for each, and what the blocks add to a row's scores is summed by its id, which must be unique."""
        return self._with(df, out, lambda raw: raw, block)

    def probabilities(self, df: DataFrame, out: str = "p", block: int | None = None) -> DataFrame:
        t = self.config.joint_temperature if "joint" in self.anchors else self.config.temperature
        return self._with(df, out, lambda raw: _softmax(raw, t), block)

    def only(self, view: str) -> Teacher:
        """The teacher that scores by the kernel of one view alone."""
        return Teacher(self.config, {view: self.anchors[view]}, {view: self.alphas[view]})

    @property
    def bytes(self) -> int:
        return sum(a.nbytes for a in self.anchors.values())

    def state(self) -> dict[str, np.ndarray]:
        return {f"anchor_{k}": v for k, v in self.anchors.items()} | {f"alpha_{k}": v for k, v in self.alphas.items()}

    @classmethod
    def from_state(cls, state: dict[str, np.ndarray], config: Config) -> Teacher:
        views = [v for v in VIEWS if f"anchor_{v}" in state]
        return cls(config, {v: state[f"anchor_{v}"] for v in views}, {v: state[f"alpha_{v}"] for v in views})


def _settings(c: Config) -> dict[str, tuple[float, float]]:
    """Gamma and ridge of each view."""
    return {"view_a": (c.gamma_a, c.teacher_ridge), "view_b": (c.gamma_b, c.teacher_ridge), "joint": (c.gamma_joint, c.joint_ridge)}


def scores_of(df: DataFrame, teachers: list[Teacher], out: str = "raw") -> DataFrame:
    """df and the raw scores of several teachers one after the other in one array. Rows pass Python once for as many teachers
    as have ANCHOR_BYTES together; a teacher of more takes its own way, in blocks (Teacher.scores)."""
    groups: list[list[Teacher]] = []
    for t in teachers:
        if groups and sum(x.bytes for x in groups[-1]) + t.bytes <= ANCHOR_BYTES:
            groups[-1].append(t)
        else:
            groups.append([t])
    names, columns = [f"_raw{k}" for k in range(len(groups))], df.columns
    for name, group in zip(names, groups, strict=True):
        if len(group) == 1:
            df = group[0].scores(df, name)
            continue
        used = [v for v in VIEWS if any(v in t.anchors for t in group)]
        shared = df.sparkSession.sparkContext.broadcast(group)

        def make(*views: np.ndarray, used=used, shared=shared) -> np.ndarray:
            by = dict(zip(used, views, strict=True))
            return np.concatenate([t._raw(*(by[v] for v in t.views)) for t in shared.value], 1)

        df = with_array(df, name, used, make)
    return df.select(*(c for c in columns if c != out), F.concat(*names).alias(out))


def fit_teacher(features: DataFrame, trusted: DataFrame, config: Config | None = None, direct: int = DIRECT) -> Teacher:
    """From the trusted rows only, which come to the driver in the order of their ids, with MAX_BYTES of views at most. Up to
    `direct` rows the kernel matrix is solved on the driver; beyond, by steps over blocks of it in tasks (kernel_solve)."""
    config = config or Config()
    views = VIEWS if config.joint_teacher else VIEWS[:2]
    rows = features.select("id", *views).join(trusted.select("id", "label"), "id")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.size(v).cast("long") for v in views)).alias("cells")).collect()[0]
    if not size["n"]:
        raise ValueError("there must be a trusted row")
    if 8 * size["cells"] > MAX_BYTES:
        raise ValueError(f"the trusted rows' views have over {MAX_BYTES} bytes")
    ids, *vectors, label = collected(rows.orderBy("id"), "id", *views, "label")
    y = np.eye(config.classes)[label.astype(int)]
    if size["n"] > direct:
        rows = Store(features.sparkSession, "trusted").put(rows, "rows")
        alphas = {n: kernel_solve(rows, n, ids, y, *_settings(config)[n]).alpha for n in views}
    else:
        alphas = {n: _dual(v, y, *_settings(config)[n]) for n, v in zip(views, vectors, strict=True)}
    return Teacher(config, dict(zip(views, vectors, strict=True)), alphas)
