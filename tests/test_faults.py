"""Faults as rows: nulls, empty tables, rows without a key, and the refusals that read them."""

import pytest
from pyspark.sql import functions as F

from trustweave.functions import checks, faults


def rows(found):
    return {r["rule"]: (r["offenders"], r["first"]) for r in found.collect()}


def test_each_fault_counts_under_its_own_rule(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(5, [1.0, 2.0], 1.0), (4, None, None), (3, [None, nan], nan), (2, [inf, 1.0], -inf), (None, [1.0], 0.0), (1, [], -2.0)], "id long, v array<double>, w double")
    assert rows(faults.faults(df, faults.vector_rules("v", 2))) == {"v is null": (1, 4), "v holds nulls": (1, 3), "v holds NaN": (1, 3), "v holds infinite values": (1, 2), "v has not 2 values": (2, 1)}
    assert rows(faults.faults(df, faults.weight_rules("w"))) == {"w is null": (1, 4), "w is not finite": (2, 2), "w is not positive": (2, 1)}
    lone = df.filter("id IS NULL")
    assert rows(faults.faults(lone, faults.weight_rules("w")))["w is not positive"] == (1, None)
    assert set(rows(faults.faults(df.limit(0), faults.vector_rules("v", 2))).values()) == {(0, None)}


def test_trusted_rows(spark):
    examples = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 4)] + [(None,)], "id long")
    t = spark.createDataFrame([(1, 0.0), (1, 0.5), (9, 3.0), (None, -1.0), (4, None), (3, float("nan"))], "id long, label double")
    assert {k: v for k, v in rows(faults.trusted_faults(t, examples, 3)).items() if v[0]} == {
        "id is null": (1, None), "label is null": (1, 4), "label is not finite": (1, 3), "label has a fraction": (1, 1),
        "label is below 0": (1, None), "label is 3 or more": (1, 9), "id is trusted twice": (1, 1), "id is not among the examples": (1, 9),
    }
    assert rows(faults.trusted_faults(t.limit(0), examples, 3))["no trusted row"] == (1, None)
    checks.check_trusted(t.filter("id = 1 AND label = 0"), examples, 3)
    with pytest.raises(ValueError, match="id is trusted twice \\(1, first 1\\)"):
        checks.check_trusted(t, examples, 3)


def test_classes_and_labels(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 2)], "id long, label int")
    assert rows(faults.availability_faults(labels, 2, 4)) == {"class has not 2 rows": (3, 1)}
    text = labels.withColumn("label", F.col("label").cast("string"))
    other = text.withColumn("label", F.when(F.col("id") == 2, F.lit(None)).otherwise(F.col("label")))
    assert rows(faults.label_faults(text, other, labels)) == {"trusted labels differ": (1, 2)}
    checks.check_same_labels(other, other, labels)
    with pytest.raises(ValueError):
        checks.check_same_labels(text, other, labels)
