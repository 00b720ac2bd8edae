"""Faults of a table as rows: a rule, how many offend, and the first of them. `checks` refuses by these rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def faults(df: DataFrame, rules: dict[str, Column], key: str = "id", some: str | None = None) -> DataFrame:
    """(rule, offenders, first): of every rule the rows it holds for and their smallest key (null if none has one), by one
    aggregate, whatever the number of rules. A rule that is null for a row doesn't hold. some: a rule of which the table
    itself is the one offender, if it has no rows."""
    named = list(rules.items())
    aggs = [x for k, (_, bad) in enumerate(named) for x in (F.count_if(bad).alias(f"n{k}"), F.min(F.when(bad, F.col(key))).alias(f"f{k}"))]
    kind = df.schema[key].dataType
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"n{k}").alias("offenders"), F.col(f"f{k}").alias("first")) for k, (n, _) in enumerate(named)]
    if some:
        aggs.append((F.count(F.lit(1)) == 0).cast("long").alias("none"))
        rows.append(F.struct(F.lit(some).alias("rule"), F.col("none").alias("offenders"), F.lit(None).cast(kind).alias("first")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def vector_rules(column: str, width: int | None = None) -> dict[str, Column]:
    v = F.col(column)
    of = lambda bad: F.exists(v, lambda x: bad(x.cast("double")))
    out = {
        f"{column} is null": v.isNull(),
        f"{column} holds nulls": F.exists(v, lambda x: x.isNull()),
        f"{column} holds NaN": of(lambda x: F.coalesce(F.isnan(x), F.lit(False))),
        f"{column} holds infinite values": of(lambda x: F.coalesce(F.abs(x) == float("inf"), F.lit(False))),
    }
    return out if width is None else out | {f"{column} has not {width} values": F.size(v) != width}


def integral_rules(column: str) -> dict[str, Column]:
    """Of a numeric column whose values must be whole."""
    x = F.col(column).cast("double")
    return {
        f"{column} is null": x.isNull(),
        f"{column} is not finite": F.isnan(x) | (F.abs(x) == float("inf")),
        f"{column} has a fraction": ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != F.floor(x)),
    }


def class_rules(column: str, classes: int) -> dict[str, Column]:
    x = F.col(column).cast("double")
    return {f"{column} is below 0": x < 0, f"{column} is {classes} or more": ~F.isnan(x) & (x < float("inf")) & (x >= classes)}


def weight_rules(column: str) -> dict[str, Column]:
    x = F.col(column).cast("double")
    return {f"{column} is null": x.isNull(), f"{column} is not finite": F.isnan(x) | (F.abs(x) == float("inf")), f"{column} is not positive": (x <= 0) & (x > -float("inf"))}


def trusted_faults(trusted: DataFrame, examples: DataFrame, classes: int) -> DataFrame:
    """Of trusted rows (id, label), both numeric: values by row; repeated and unknown ids by id. Ids are grouped before they
    meet the examples' ids, which are not repeated by the join."""
    rows = faults(trusted, integral_rules("id") | integral_rules("label") | class_rules("label", classes), some="no trusted row")
    ids = trusted.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = examples.select("id", F.lit(True).alias("known")).join(ids.select("id"), "id", "left_semi").distinct()
    met = ids.join(known, "id", "left")
    return rows.unionByName(faults(met, {"id is trusted twice": F.col("n") > 1, "id is not among the examples": F.col("known").isNull()}))


def availability_faults(labels: DataFrame, per_class: int, classes: int) -> DataFrame:
    """Of classes, also those without a row: fewer than per_class rows. first is a class."""
    every = labels.sparkSession.range(classes).select(F.col("id").alias("label"))
    n = labels.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return faults(every.join(n, "label", "left"), {f"class has not {per_class} rows": F.coalesce("n", F.lit(0)) < per_class}, "label")


def label_faults(a: DataFrame, b: DataFrame, trusted: DataFrame) -> DataFrame:
    """Of the trusted ids in both tables (id, label): labels that differ; a null one differs from all but a null."""
    both = trusted.select("id").join(a.select("id", F.col("label").alias("x")), "id").join(b.select("id", F.col("label").alias("y")), "id")
    return faults(both, {"trusted labels differ": ~F.col("x").eqNullSafe(F.col("y"))})


def refuse(found: DataFrame) -> None:
    """Raises with the rules that have offenders; a row a rule comes to the driver."""
    bad = [f"{r['rule']} ({r['offenders']}, first {r['first']})" for r in found.filter("offenders > 0").collect()]
    if bad:
        raise ValueError("; ".join(bad))
