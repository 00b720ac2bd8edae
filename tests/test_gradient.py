"""The kernel solve by steps against the solve of the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.config import Config
from trustweave.operators import gradient, kernels, solve
from trustweave.operators.teacher import fit_teacher


@pytest.mark.parametrize("rows,marks", [(64, 60), (1000, 512)])
def test_steps_give_the_whole_matrix_solution(spark, rows, marks, monkeypatch):
    monkeypatch.setattr(gradient, "ROWS", rows)
    draw = np.random.default_rng(0)
    n = 160
    x, y = draw.normal(size=(n, 5)), draw.normal(size=(n, 3))
    y[:, 2] = 0
    ids = np.arange(n) * 3 - 50
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(5)
    got = gradient.kernel_solve(df, "v", ids, y, 0.3, 0.1, marks=marks)
    want = solve.ridge_solve(kernels.rbf(x, x, 0.3), y, 0.1)
    assert np.abs(got.alpha - want).max() < 1e-8 and got.residual < 1e-10 and (got.alpha[:, 2] == 0).all()
    with pytest.raises(ValueError, match="residual"):
        gradient.kernel_solve(df, "v", ids, y, 0.3, 1e-9, most=1, marks=1)
    with pytest.raises(ValueError):
        gradient.kernel_solve(df, "v", ids, y, 0.3, 0.0)


def test_teacher_by_steps_and_in_blocks(spark):
    draw = np.random.default_rng(1)
    rows = [(i, *(draw.normal(size=w).tolist() for w in (4, 3, 7)), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, view_a array<double>, view_b array<double>, joint array<double>, label int")
    t = df.filter("id < 90").select("id", "label")
    one, two = fit_teacher(df, t, Config(3)), fit_teacher(df, t, Config(3), direct=10)
    assert all(np.abs(one.alphas[k] - two.alphas[k]).max() < 1e-8 for k in one.alphas)
    whole = {r["id"]: r["p"] for r in one.probabilities(df).collect()}
    for block in (7, 89, 90):
        got = one.probabilities(df.withColumn("p", F.lit("old")), block=block)
        assert sorted(got.columns) == sorted([*df.columns, "p"])
        rows = got.collect()
        assert len(rows) == 200 and all(np.allclose(r["p"], whole[r["id"]], atol=1e-12) for r in rows)
