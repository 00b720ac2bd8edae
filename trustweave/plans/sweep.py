"""A grid of budgets and seeds in one pass over the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs
from ..functions.checks import check_available
from ..operators.arrays import collected, with_array
from ..operators.kernels import landmark_map
from ..operators.sampling import balanced_sample, landmarks, shuffled
from ..operators.teacher import Teacher, fit_teacher, scores_of
from ..operators.tiles import tiled_ridge_solve, tiled_statistics
from ..sources.shared import Store

SCHEMA = "per_class int, seed long, trusted int, teacher_accuracy double, kernel_accuracy double, student_accuracy double, trusted_only_accuracy double, all_label_accuracy double, flipped_accuracy double"


def trusted_sets(labels: DataFrame, classes: int, budgets: list[int], seeds: list[int]) -> DataFrame:
    """(k, id, label): the balanced sample of every budget and seed; k counts seeds within budgets, from 0 on. A smaller
    budget's sample is part of the same seed's largest one, so all rows are ranked once a seed."""
    check_available(labels, max(budgets), classes)
    each = None
    for at, seed in enumerate(seeds):
        rank = F.row_number().over(Window.partitionBy("label").orderBy(*shuffled(seed)))
        one = balanced_sample(labels, max(budgets), seed).withColumn("_rank", rank).withColumn("_at", F.lit(at))
        each = one if each is None else each.unionByName(one)
    each = each.select("id", "label", "_rank", "_at", F.posexplode(F.array(*map(F.lit, budgets))).alias("_b", "_budget")).filter("_rank <= _budget")
    return each.select((F.col("_b") * len(seeds) + F.col("_at")).cast("int").alias("k"), "id", "label")


def _picks(parts: list[tuple[int, int, float]], old: int, new: int, classes: int) -> np.ndarray:
    """A map of outputs in groups of classes: (old group, new group, factor)."""
    out = np.zeros((old * classes, new * classes))
    for a, b, x in parts:
        out[a * classes : (a + 1) * classes, b * classes : (b + 1) * classes] += x * np.eye(classes)
    return out


def sweep(train: DataFrame, labels: DataFrame, test: DataFrame, test_labels: DataFrame, config: Config, budgets: list[int], seeds: list[int]) -> DataFrame:
    """A row for each budget and seed, with the accuracies on the test rows of the teacher, of its joint view's kernel alone
    (null where it has none), of the student, and of ridge fits on trusted rows only, on all labels, and on all labels with
    every untrusted one flipped.

    All training rows are scored and summed once, for all conditions: their targets stand side by side, first the labels,
    then the flipped labels, then each teacher's targets. What differs in the trusted rows comes from sums over these alone,
    by condition: their weight, and their labels, which flipping leaves as they are. The test rows are read once, too. The
    width of the targets grows with the number of conditions, of which there are few; rows are never repeated."""
    budgets, seeds, c = sorted(set(budgets)), sorted(set(seeds)), config.classes
    keys = [(b, s) for b in budgets for s in seeds]
    n, ridge = len(keys), config.student_ridge
    store = Store(train.sparkSession, "sweep")
    sets = store.put(trusted_sets(labels.select("id", "label"), c, budgets, seeds), "sets")
    seen = store.put(train.select("id", "view_a", "view_b", "joint").join(sets.select("id").distinct(), "id"), "seen")
    teachers = [fit_teacher(seen, sets.filter(F.col("k") == k).select("id", "label"), config) for k in range(n)]

    own = lambda df: df
    if config.student == "landmark":
        marks = collected(landmarks(train, config.landmarks, config.landmark_seed), "joint")[0]
        own = lambda df: landmark_map(df, marks, config.landmark_gamma).drop("joint").withColumnRenamed("phi", "joint")
    rows = own(_targets(train, labels, sets, teachers, config))
    rows = store.put(rows, "rows")
    whole = tiled_statistics(rows, "joint", "q").kept(store, "whole")
    few = rows.join(sets.select("id", (F.col("k") + 1).cast("long").alias("client")), "id").select("id", "client", "joint", F.slice("q", 1, 2 * c).alias("q"))
    few = tiled_statistics(few, "joint", "q", None, "client").kept(store, "few")

    # One matrix for all labels, flipped labels by condition and, of landmark students, the soft targets.
    groups = 1 + n if config.student == "linear" else 1 + 2 * n
    first = [(0, 0, 1.0)] + [(1, 1 + k, 1.0) for k in range(n)] + [(2 + k, 1 + n + k, 1.0) for k in range(groups - 1 - n)]
    change = {k + 1: _picks([(0, 1 + k, 1.0), (1, 1 + k, -1.0)], 2, groups, c) for k in range(n)}
    both = whole.mapped({0: _picks(first, 2 + n, groups, c)}).plus(few.mapped(change, matrix=False))
    shared = tiled_ridge_solve(both.combined(), ridge)
    at = lambda g: shared[:, g * c : (g + 1) * c]
    true = _picks([(0, 0, 1.0)], 2, 1, c)
    weights = []
    for k in range(n):
        mine = few.of([k + 1]).mapped({k + 1: true})
        alone = tiled_ridge_solve(mine.scaled(1.0, 0), ridge)
        if config.student == "linear":
            soft = whole.mapped({0: _picks([(2 + k, 0, 1.0)], 2 + n, 1, c)})
            student = tiled_ridge_solve(soft.plus(mine.scaled(config.trusted_weight - 1.0, 1)).combined(), ridge)
        else:
            student = at(1 + n + k)
        weights += [student, alone, at(1 + k)]
    rates = _rates(test, test_labels, teachers, [at(0), *weights], own, c)
    kernel = lambda k: rates.get(n + k) if teachers[k].config.joint_teacher else None
    base = n * (2 if config.joint_teacher else 1)
    out = [(b, s, b * c, rates.get(k), kernel(k), rates.get(base + 1 + 3 * k), rates.get(base + 2 + 3 * k), rates.get(base), rates.get(base + 3 + 3 * k)) for k, (b, s) in enumerate(keys)]
    return train.sparkSession.createDataFrame(out, SCHEMA)


def _targets(train: DataFrame, labels: DataFrame, sets: DataFrame, teachers: list[Teacher], config: Config) -> DataFrame:
    """(id, joint, q) with the targets of all conditions in q."""
    c = config.classes
    heat = config.joint_temperature if config.joint_teacher else config.temperature
    member = sets.groupBy("id").agg(F.collect_set("k").alias("_in"))  # as many numbers as there are conditions, at most
    known = train.select("id", "view_a", "view_b", "joint").join(labels.select("id", "label"), "id").join(member, "id", "left")
    hot = exprs.one_hot(F.col("label"), c)
    soft = lambda k: F.when(F.array_contains("_in", k), hot).otherwise(exprs.softmax(F.slice("raw", k * c + 1, c), heat))
    q = F.concat(hot, exprs.one_hot(exprs.flipped(F.col("label"), c, F.lit(True)), c), *(soft(k) for k in range(len(teachers))))
    return scores_of(known, teachers).select("id", "joint", q.alias("q"))


def _rates(test: DataFrame, labels: DataFrame, teachers: list[Teacher], weights: list[np.ndarray], own, classes: int) -> dict[int, float]:
    """Share of test rows that each scorer puts in their class, by its place: teachers, their joint kernels, weights."""
    every = teachers + [t.only("joint") for t in teachers if "joint" in t.anchors]
    w = test.sparkSession.sparkContext.broadcast(np.concatenate(weights, 1))
    rows = scores_of(test.select("id", "view_a", "view_b", "joint"), every).select("id", "joint", "raw")
    rows = with_array(own(rows), "more", ["joint"], lambda z: z @ w.value)
    s = F.concat("raw", "more")
    guess = F.array(*(exprs.argmax(F.slice(s, g * classes + 1, classes)) for g in range(len(every) + len(weights))))
    rows = rows.select("id", guess.alias("guess")).join(labels.select("id", "label"), "id")
    by = rows.select("label", F.posexplode("guess").alias("at", "prediction")).groupBy("at").agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a"))
    return {r["at"]: r["a"] for r in by.collect()}  # a number a scorer
