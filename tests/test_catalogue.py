"""Every query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from trustweave.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, sql, name):
    ours, theirs = catalogue.queries()[name](spark, D).toPandas(), sql.execute(catalogue.oracle_sql()[name]).fetchdf()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_untrusted_labels_are_not_read(spark):
    from trustweave.operators.teacher import fit_teacher

    v, t = catalogue.views(spark, D), catalogue.trusted(spark, D)
    features = v.select("id", "view_a", "view_b", "joint")
    plan = fit_teacher(features, t).probabilities(features)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[-1]
