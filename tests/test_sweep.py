"""Grids in one pass against one condition at a time, and the kernel-only teacher against plain numbers."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.operators import teacher, tiles
from trustweave.operators.arrays import collected
from trustweave.operators.kernels import rbf
from trustweave.operators.sampling import balanced_sample
from trustweave.plans import experiments, sweep
from trustweave.sources import synthetic

SAME = ("teacher_accuracy", "student_accuracy", "trusted_only_accuracy", "all_label_accuracy", "flipped_accuracy", "trusted")


@pytest.fixture(scope="module")
def split(spark):
    f, labels, _, c = synthetic.problem(spark, rows=200)
    noise = F.transform("joint", lambda x, i: x + F.sin(F.col("id") * 7 + i * 3) * 0.4)  # so that scorers err
    f = f.withColumn("joint", noise).persist()
    return f.filter("id < 140"), labels.filter("id < 140"), f.filter("id >= 140"), labels.filter("id >= 140"), replace(c, landmarks=9)


@pytest.mark.parametrize("student", ["linear", "landmark"])
def test_same_as_one_condition_at_a_time(spark, split, student, monkeypatch):
    *rows, c = split
    c = replace(c, student=student)
    if student == "landmark":  # every teacher on its own, in blocks
        monkeypatch.setattr(teacher, "ANCHOR_BYTES", 12_000)
    got = {(r["per_class"], r["seed"]): r.asDict() for r in experiments.grid(*rows, c, [21, 1], [1, 2]).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (21, 1), (21, 2)]
    for k in ((1, 2), (21, 1)):
        one = experiments.condition(*rows, c, *k)
        assert all(abs(one[n] - got[k][n]) < 1e-12 for n in SAME), k
    assert all((r["kernel_accuracy"] is None) == (student == "landmark") for r in got.values())
    if student == "linear":
        train, labels, test, test_labels, _ = split
        a, y = collected(train.join(balanced_sample(labels, 21, 1), "id").orderBy("id"), "joint", "label")
        z, truth = collected(test.join(test_labels, "id").orderBy("id"), "joint", "label")
        alpha = np.linalg.solve(rbf(a, a, c.gamma_joint) + c.joint_ridge * np.eye(len(a)), np.eye(4)[y.astype(int)])
        assert abs(((rbf(z, a, c.gamma_joint) @ alpha).argmax(1) == truth).mean() - got[21, 1]["kernel_accuracy"]) < 1e-12
    assert len({r["flipped_accuracy"] for r in got.values()}) > 1


def test_samples_are_the_balanced_ones(spark, split):
    labels = split[1]
    sets = sweep.trusted_sets(labels, 4, [1, 4], [5, 6]).persist()
    for k, (b, s) in enumerate([(1, 5), (1, 6), (4, 5), (4, 6)]):
        assert sets.filter(F.col("k") == k).select("id", "label").exceptAll(balanced_sample(labels, b, s)).count() == 0
        assert sets.filter(F.col("k") == k).count() == 4 * b
    with pytest.raises(ValueError):
        sweep.trusted_sets(labels, 4, [1000], [1])


def test_mapped_sums(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i), 1.0, 2.0], [1.0, float(i % 3)]) for i in range(10)], "id long, client long, phi array<double>, q array<double>")
    t = tiles.tiled_statistics(rows, "phi", "q", None, "client", tile=2)
    m = {0: np.array([[1.0, 0, 2], [0, 1, 0]]), 1: np.array([[0.0, 1, 0], [3, 0, 0]])}
    got = {(r["client"], r["i"], r["j"]): r["v"] for r in t.mapped(m).entries(True).collect()}
    old = {(r["client"], r["i"], r["j"]): r["v"] for r in t.entries(True).collect()}
    assert all(abs(v - sum(old[k, i, a] * m[k][a, j] for a in range(2))) < 1e-12 for (k, i, j), v in got.items()) and len(got) == 18
    assert t.mapped(m).entries().count() == t.entries().count() and t.mapped(m, matrix=False).entries().count() == 0
    with pytest.raises(ValueError):
        t.mapped({0: np.ones((3, 1))})
