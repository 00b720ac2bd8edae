"""Models as archives: round trips, version gates and refusals of changed ones."""

import hashlib
import io
import json
from dataclasses import replace

import numpy as np
import pytest

from trustweave.operators import pipeline
from trustweave.sources import archives, synthetic


@pytest.fixture(scope="module")
def given(spark):
    f, labels, t, c = synthetic.problem(spark, rows=120, per_class=4)
    return f.persist(), t.persist(), replace(c, landmarks=8)


@pytest.mark.parametrize("student", ["linear", "landmark"])
def test_round_trip_and_refusals(spark, given, tmp_path, student):
    f, t, c = given
    m = pipeline.fit(f, t, replace(c, student=student))
    at = f"file://{tmp_path}"
    mark = archives.save(spark, m, at)
    assert mark == archives.fingerprint(spark, at) == hashlib.sha256((tmp_path / "metadata.json").read_bytes()).hexdigest()
    again = archives.load(spark, at, mark)
    assert again.config == m.config and again.student.digest() == m.student.digest() and again.target_digest == m.target_digest
    assert again.scores(f).select("id", "scores").exceptAll(m.scores(f).select("id", "scores")).count() == 0
    text, arrays = json.loads((tmp_path / "metadata.json").read_text()), dict(np.load(tmp_path / "model.npz"))
    assert "teacher_view_a_anchor" in arrays and ("student_landmarks" in arrays) == (student == "landmark")

    def other(arrays=arrays, **changes):
        body = io.BytesIO()
        np.savez_compressed(body, **arrays)
        archives._put(spark, f"{at}/model.npz", body.getvalue())
        archives._put(spark, f"{at}/metadata.json", json.dumps(text | changes).encode())
        return archives.load(spark, at)

    with pytest.raises(ValueError, match="fingerprint"):
        archives.load(spark, at, "0" * 64)
    for bad in (0, 4):
        with pytest.raises(ValueError, match="version"):
            other(format_version=bad)
    with pytest.raises(ValueError, match="student_weights is not"):
        other(arrays | {"student_weights": arrays["student_weights"] + 1})
    with pytest.raises(ValueError, match="more is not"):
        other(arrays | {"more": np.ones(1)})
    with pytest.raises(ValueError, match="trusted_labels is not"):
        other({k: v for k, v in arrays.items() if k != "trusted_labels"})
    with pytest.raises(ValueError, match="no setting"):
        other(config=text["config"] | {"teacher": {"width": 1}})
    with pytest.raises(ValueError, match="no architecture"):
        other(config=text["config"] | {"architecture": "forest"})
    with pytest.raises(ValueError):  # pickled objects are not opened
        other(arrays | {"student_weights": np.array([{}], object)})
    old = {k: v for k, v in text["config"].items() if student == "linear" or k != "architecture"}
    old["teacher"] = old["teacher"] | {"chunk_size": 100}
    with pytest.warns(UserWarning, match="version 1"):
        assert other(format_version=1, array_sha256={}, config=old).config == m.config
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="weights"):
        other(arrays | {"student_weights": arrays["student_weights"] + 1}, format_version=1)


def test_no_trusted_rows_and_limits(spark, given, tmp_path, monkeypatch):
    f, t, c = given
    at = f"file://{tmp_path}"
    archives.save(spark, pipeline.fit(f, t, c), at, include_trusted=False)
    assert archives.load(spark, at).trusted_ids is None
    monkeypatch.setattr(archives, "MAX_OPEN", 10)
    with pytest.raises(ValueError, match="over 10 bytes"):
        archives.load(spark, at)
