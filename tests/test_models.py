import json
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave import __main__ as cli
from trustweave.config import Config, Features, as_dict, from_dict
from trustweave.functions import checks, exprs
from trustweave.operators import audit, features, kernels, pipeline, sampling, solve, stats
from trustweave.operators.arrays import collected
from trustweave.operators.student import build_targets, fit_linear
from trustweave.plans import experiments
from trustweave.sources import images, model_store, synthetic


@pytest.fixture(scope="module")
def given(spark):
    f, labels, t, c = synthetic.problem(spark)
    return f.persist(), labels.persist(), t.persist(), c


@pytest.mark.parametrize("student", ["linear", "landmark"])
def test_fit_predict_save_load(spark, given, tmp_path, student):
    f, labels, t, c = given
    c = replace(c, student=student)
    m = pipeline.fit(f, t, c)
    rate = m.predict(f).join(labels, "id").agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a")).collect()[0]["a"]
    assert rate > 0.9
    at = f"file://{tmp_path}/model"
    mark = model_store.save(spark, m, at)
    assert mark == model_store.fingerprint(spark, at)
    again = model_store.load(spark, at, mark)
    same = m.predict(f).select("id", "prediction").exceptAll(again.predict(f).select("id", "prediction"))
    assert same.count() == 0
    with pytest.raises(ValueError):
        model_store.load(spark, at, "0" * 64)
    meta = json.loads((tmp_path / "model/model.json").read_text())
    arrays = spark.read.parquet(f"{at}/arrays.parquet").collect()

    def refused(match, rows=arrays, **changes):
        spark.createDataFrame(rows, model_store.SCHEMA).write.mode("overwrite").parquet(f"{at}/arrays.parquet")
        model_store._seal(spark, at, json.dumps(meta | changes))
        with pytest.raises(ValueError, match=match):
            model_store.load(spark, at)

    refused("student_weights", arrays=meta["arrays"] | {"student_weights": "0" * 64})
    refused("added", [*arrays, ("added", "<f8", [1], bytearray(8))])
    refused("twice", [*arrays, arrays[0]])
    refused("layout", layout="another")
    # Changed arrays with digests to match are seen by the fingerprint only.
    spark.createDataFrame([(r["name"], r["dtype"], r["shape"], bytearray(len(r["data"])) if r["name"] == "student_weights" else r["data"]) for r in arrays], model_store.SCHEMA).write.mode("overwrite").parquet(f"{at}/arrays.parquet")
    forged = meta["arrays"] | {"student_weights": model_store.array_digest(np.zeros_like(m.student.weights))}
    model_store._seal(spark, at, json.dumps(meta | {"arrays": forged}))
    assert model_store.load(spark, at).student.weights.any() == np.False_
    with pytest.raises(ValueError, match="fingerprint"):
        model_store.load(spark, at, mark)
    small = model_store.state_of(m, include_trusted=False)
    assert "trusted_labels" not in small
    with pytest.raises(ValueError):
        m.predict(f.withColumn("joint", F.slice("joint", 1, 3))).count()


def test_weighted_student_is_the_closed_form(spark, given):
    f, labels, t, _ = given
    rows = f.join(labels, "id").withColumn("q", exprs.one_hot(F.col("label"), 4))
    w = fit_linear(rows, Config(), trusted=t).weights
    z, q, i = collected(rows.orderBy("id"), "joint", "q", "id")
    k = np.where(np.isin(i, [r["id"] for r in t.collect()]), 10.0, 1.0)[:, None]
    assert np.allclose(w, np.linalg.solve((z * k).T @ z + 0.03 * np.eye(z.shape[1]), (z * k).T @ q), atol=1e-10)


def test_sums_do_not_depend_on_partitions(spark, given):
    f, labels, _, _ = given
    rows = f.join(labels, "id").withColumn("q", exprs.one_hot(F.col("label"), 4)).select("id", "joint", "q")
    for size in (None, 100, 3):  # one bucket, some, and a tree of two levels
        a, b = stats.statistics(rows, "joint", "q", rows=size), stats.statistics(rows.repartition(13), "joint", "q", rows=size)
        assert (a.a == b.a).all() and (a.b == b.b).all() and a.n == 320
    whole = stats.statistics(rows, "joint", "q")
    assert np.allclose(a.a, whole.a, atol=1e-12) and np.allclose(a.b, whole.b, atol=1e-12)
    parts = stats.client_statistics(rows.withColumn("c", F.when(F.col("id") < 7, 1).otherwise(2)), "joint", "q", None, "c", rows=3)
    assert parts[1].n == 7 and parts[2].n == 313 and np.allclose(parts[1].a + parts[2].a, whole.a, atol=1e-12)
    tasks = stats.partial_statistics(rows, "joint", "q", rows=3)
    assert tasks.count() <= 16 and tasks.agg(F.sum("n")).collect()[0][0] == 320


def test_commands(spark, capsys):
    assert cli.main(["info"]) == 0
    assert cli.main(["federated-audit"]) == 0
    assert cli.main(["audit"]) == 0
    assert '"passed": true' in capsys.readouterr().out


def test_refused(spark, given):
    f, _, t, c = given
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    for rows, schema in (([], "id long, label int"), ([(1, 0), (1, 1)], "id long, label int"), ([(999, 0)], "id long, label int"), ([(1, 9)], "id long, label int"), ([(1, 0.5)], "id long, label double"), ([(1, True)], "id long, label boolean"), ([(1, "0")], "id long, label string"), ([(1, None)], "id long, label int")):
        with pytest.raises(ValueError):
            pipeline.fit(f, frame(rows, schema), c)
    checks.check_trusted(frame([(1, 0.0)], "id long, label double"), f, 4)
    for bad in ([None], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            checks.check_vectors(frame([(1, bad)], "id long, v array<double>"), ["v"])
    with pytest.raises(ValueError):
        checks.check_vectors(frame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), ["v"])
    with pytest.raises(ValueError):
        checks.check_statistics([stats.RidgeStatistics(np.array([[1.0, 2], [0, 1]]), np.ones((2, 1)), 1)])
    with pytest.raises(ValueError):
        checks.check_available(t.select("label"), 13, 4)
    with pytest.raises(ValueError):
        Config(teacher_ridge=0)
    for bad in ({"share_a": 1.5}, {"classes": 1}, {"student": "other"}, {"landmarks": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    for bad in ({"patch_side": 33}, {"patches": 5}, {"scale_floor": 0}):
        with pytest.raises(ValueError):
            Features(**bad)
    for s in (Config(3, "landmark", landmark_seed=-1), Features(centroids=9)):
        assert from_dict(type(s), json.loads(json.dumps(as_dict(s)))) == s
    with pytest.raises(TypeError):
        from_dict(Config, {"chunk": 1})
    three = frame([(9999, [0.2, 0.3, 0.5])], "id long, p array<double>")
    with pytest.raises(Exception, match="must give 4 values"):
        build_targets(three, t, 4).collect()
    with pytest.raises(ValueError):
        stats.client_statistics(frame([(1, [1.0], [1.0], 0.0)], "id long, phi array<double>, q array<double>, w double"), "phi", "q", "w")
    assert pipeline.fit(f, t, c).predict(f.limit(0)).count() == 0


def test_audit_sees_a_difference(spark, given):
    f, labels, t, c = given
    text = labels.select("id", F.col("label").cast("string").alias("label"))
    with pytest.raises(ValueError):
        audit.mutation_audit(f, t, text, text.withColumn("label", F.lit("0")), c)


def test_images(spark, tmp_path):
    draw = np.random.default_rng(3)
    base = draw.random((3, 3072))
    y = np.arange(30) % 3
    x = np.clip(base[y] + 0.15 * draw.normal(size=(30, 3072)), 0, 1).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, pixels array<float>").persist()
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, label int")
    t = labels.filter("id < 15")
    h = features.gradient_histogram(x)
    assert h.shape == (30, 576) and np.allclose(np.linalg.norm(h, axis=1), 1, atol=1e-5)
    assert features.block_means(x).shape == (30, 48)
    for c in (Config(3), Config(3, "landmark", landmarks=10)):
        m = pipeline.fit_images(rows, t, c, Features(centroids=8, patches=800, rounds=3))
        assert m.score_images(rows, labels) > 0.9
        at = f"file://{tmp_path}/{c.student}"
        model_store.save(spark, m, at)
        assert model_store.load(spark, at).predict_images(rows).exceptAll(m.predict_images(rows)).count() == 0
        for bad in (rows.withColumn("pixels", F.slice("pixels", 1, 10)), rows.withColumn("pixels", F.transform("pixels", lambda x: F.lit(float("nan")).cast("float")))):
            with pytest.raises(ValueError):
                m.predict_images(bad)
    with pytest.raises(ValueError):
        features.fit_color(rows.withColumn("pixels", F.slice("pixels", 1, 10)))
    scaled = features.from_rows(features.from_bytes(spark.createDataFrame([(0, [p % 256 for p in range(3072)])], "id long, pixels array<int>"))).collect()[0]["pixels"]
    assert np.allclose(scaled, (np.arange(3072) % 256 / 255).reshape(1024, 3).T.ravel())


def test_records(spark, tmp_path):
    draw = np.random.default_rng(0)
    for n in [*images.TRAIN, *images.TEST]:
        draw.integers(0, 256, 2 * images.RECORD, dtype=np.uint8).tofile(tmp_path / n)
    rows = images.read_folder(spark, str(tmp_path), raw=True).orderBy("id").collect()
    raw = np.fromfile(tmp_path / images.TRAIN[1], np.uint8).reshape(2, -1)
    assert len(rows) == 12 and rows[3]["label"] == raw[1, 0] and len({r["id"] for r in rows}) == 12 and rows[3]["pixels"] == raw[1, 1:].tolist()
    labels = images.read_labels(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["label"], r["split"]) for r in labels] == [(r["id"], r["label"], r["split"]) for r in rows]
    (tmp_path / "short.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        images.read_records(spark, str(tmp_path / "short.bin"))
    made = images.cached(spark, f"file://{tmp_path}/cache", lambda: spark.range(3))
    assert made.count() == images.cached(spark, f"file://{tmp_path}/cache", lambda: 1 / 0).count() == 3
    images.write_csv(spark.range(3), f"file://{tmp_path}/csv")
    assert images.read_csv(spark, f"file://{tmp_path}/csv", "id long").count() == 3


def test_sampling_and_solvers(spark, given):
    _, labels, _, _ = given
    shares = sampling.dirichlet_shares(spark, 4, 5, 0.5, 1)
    for exact in (True, False):
        owned = sampling.owners(labels, shares, 1, exact)
        assert owned.count() == 320 and owned.select("id").distinct().count() == 320
    assert sampling.equal_split(labels, 7, 1).groupBy("client").count().agg(F.max("count") - F.min("count")).collect()[0][0] <= 1
    assert sampling.largest_clients(owned, 2).count() == 2
    assert sampling.active_clients(spark.range(10).withColumnRenamed("id", "client"), 0.5, 1, 1).count() == 5
    with pytest.raises(ValueError):
        sampling.sample(labels, 1000, 1)
    a = np.random.default_rng(0).normal(size=(40, 6))
    cov = np.cov(a, rowvar=False)
    assert np.allclose(np.cov((a @ solve.zca(cov, 1e-12)), rowvar=False), np.eye(6), atol=1e-6)
    assert np.allclose(kernels.rbf(a, a, 0.5), np.exp(-0.5 * ((a[:, None] - a) ** 2).sum(2)))


def test_experiments(spark, given):
    f, labels, t, c = given
    r = experiments.grid(f, labels, f, labels, c, [5], [1, 2]).persist()
    assert r.agg(F.min("student_accuracy")).collect()[0][0] > 0.8 and r.agg(F.max("flipped_accuracy")).collect()[0][0] < 0.8
    assert experiments.summary(r, "student_accuracy", "flipped_accuracy").count() == 1
    assert experiments.mismatches(r, r, ["per_class", "seed"], "student_accuracy").count() == 0
    fed = experiments.federated_grid(f, labels, t, f, labels, c, [0.1, 1.0], [1], 5)
    assert all(x["weight_diff"] < 1e-10 and x["accuracy"] > 0.8 and x["smallest_client"] <= 64 <= x["largest_client"] and len(x["participation"]) == 3 for x in fed)
    one = experiments.condition(f, labels, f, labels, c, 5, 1, mutated=True)
    assert one["target_max_diff"] == one["weight_max_diff"] == 0.0
    same = experiments.summary(spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, 0.4)], "per_class int, a double, b double"), "a", "b").collect()
    assert [(r["p_value"], r["signed_rank_p"], r["ties"]) for r in same] == [(None, None, 2), (None, 1.0, 0)]
    assert abs(experiments.t_quantile(0.95, 4) - 2.7764451) < 1e-6
    assert abs(experiments.t_two_sided(2.0, 10) - 0.07338803) < 1e-6
    assert experiments.placeholder_check(audit.federated_problem(spark), 5, 0.03) < 1e-10
    m = pipeline.fit(f, t, c)
    seen = experiments.monitoring(f, m, t, labels, spark.createDataFrame([(1, True), (2, False)], "client int, active boolean"))
    assert seen["class_coverage"] == 1.0 and seen["participation"] == 0.5 and 0 <= seen["worst_class"] < 4


def test_stream(spark, tmp_path):
    from trustweave.streaming import accumulate

    rows = audit.federated_problem(spark)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    accumulate.start(s, f"{tmp_path}/sums", f"{tmp_path}/ck").awaitTermination()
    a, b = accumulate.current(spark, f"{tmp_path}/sums"), stats.statistics(rows, "phi", "q")
    assert a.n == 300 and np.allclose(a.a, b.a, atol=1e-9)


def test_examples(spark):
    import runpy

    runs = {n: runpy.run_path(str(Path(__file__).parent.parent / "examples" / f"{n}.py"))["run"] for n in ("invariance", "federated")}
    assert runs["invariance"](spark)["passed"] and runs["federated"](spark) < 1e-10
