"""Conditions, grids and summaries of experiments."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import exprs
from ..operators.audit import mutation_audit
from ..operators.kernels import landmark_map
from ..operators.pipeline import fit
from ..operators.sampling import active_clients, balanced_sample, dirichlet_shares, largest_clients, only_trusted, owners
from ..operators.solve import ridge_solve
from ..operators.stats import largest_difference, statistics
from ..operators.student import Student, build_targets
from ..operators.teacher import fit_teacher
from ..operators.tiles import central_ridge, combine_tiles, tiled_statistics
from ..sources.shared import Store
from .sweep import sweep


def _rate(scored: DataFrame, labels: DataFrame) -> float:
    return scored.join(labels, "id").agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a")).collect()[0]["a"]


def condition(train: DataFrame, labels: DataFrame, test: DataFrame, test_labels: DataFrame, config: Config, per_class: int, seed: int, mutated: bool = False) -> dict:
    """One budget and seed: teacher, student, trusted rows only, all labels, and all labels with every untrusted one flipped.
    mutated: also a fit on labels of which every untrusted one is a text that means nothing, and how far it differs.

    The right-hand sides of the three label-using fits stand side by side in one target vector, so one pass over the
    rows makes one matrix for all of them."""
    began, c = time.time(), config.classes
    trusted = balanced_sample(labels, per_class, seed, c)
    m = fit(train, trusted, config)
    known = train.join(labels, "id").join(trusted.select("id", F.lit(True).alias("_t")), "id", "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    target = F.concat(exprs.one_hot(F.col("label"), c), exprs.one_hot(exprs.flipped(F.col("label"), c, ~F.col("_t")), c))
    rows = known.withColumn("q", target)
    own = lambda df: df
    if m.student.landmarks is not None:
        own = lambda df: landmark_map(df, m.student.landmarks, m.student.gamma).drop("joint").withColumnRenamed("phi", "joint")
    ridge = config.student_ridge
    every = statistics(own(rows.select("id", "joint", "q")), "joint", "q")
    few = statistics(own(only_trusted(rows.select("id", "joint", "q"), trusted)), "joint", "q")
    both = ridge_solve(every.a, every.b, ridge)
    alone = ridge_solve(few.a, few.b[:, :c], ridge)
    view = own(test.select("id", "joint"))
    rate = lambda w: _rate(Student(w).predict(view), test_labels)
    teacher = m.teacher.probabilities(test).withColumn("prediction", exprs.argmax(F.col("p")))
    more = {}
    if mutated:
        text = known.select("id", F.col("label").cast("string").alias("label"))
        r = mutation_audit(train, trusted, text, known.select("id", exprs.sentinel(F.col("label"), F.col("_t")).alias("label")), config).to_dict()
        more = {"target_max_diff": r["target_max_diff"], "weight_max_diff": r["student_weight_max_diff"]}
    return more | {
        "per_class": per_class, "seed": seed, "trusted": per_class * c, "teacher_accuracy": _rate(teacher, test_labels), "student_accuracy": _rate(m.predict(test), test_labels),
        "trusted_only_accuracy": rate(alone), "all_label_accuracy": rate(both[:, :c]), "flipped_accuracy": rate(both[:, c:]), "seconds": time.time() - began,
    }


def grid(train, labels, test, test_labels, config: Config, budgets: list[int], seeds: list[int]) -> DataFrame:
    """A row for each budget and seed, out of one pass over the rows; `condition` makes one alone, with its time."""
    return sweep(train, labels, test, test_labels, config, budgets, seeds)


def federated_condition(train: DataFrame, labels: DataFrame, trusted: DataFrame, alpha: float, clients: int, test: DataFrame, test_labels: DataFrame, config: Config, seed: int, repeats: int = 3) -> dict:
    """Rows dealt to clients by a Dirichlet draw: sums of each client once, then every variant as sums of those.

    The test rows are dealt by the same shares, and accuracies are of the test rows; what a client holds is told by
    client_sizes over all clients, those without rows too."""
    spark, ridge = train.sparkSession, config.linear_ridge
    shares = dirichlet_shares(spark, config.classes, clients, alpha, seed)
    teacher = fit_teacher(train, trusted, config)
    owned = owners(labels, shares, seed)
    q = build_targets(teacher.probabilities(train), trusted, config.classes).select("id", "joint", "q")
    rows = q.join(owned.select("id", "client", "label"), "id").persist()
    held = test.select("id", "joint").join(owners(test_labels, shares, seed).select("id", "client", "label"), "id").persist()
    try:
        parts = tiled_statistics(rows, "joint", "q", None, "client").kept(Store(spark, "clients"))
        weights, central = combine_tiles(parts, ridge), central_ridge(rows, "joint", "q", ridge)
        scored = Student(weights).predict(held)
        by = client_accuracy(scored).agg(F.min("accuracy").alias("worst"), F.var_samp("accuracy").alias("variance")).collect()[0]
        big = [r["client"] for r in largest_clients(owned, 2).collect()]
        bad = rows.withColumn("q", exprs.one_hot(exprs.flipped(F.col("label"), config.classes, F.col("client").isin(big)), config.classes))
        naive = central_ridge(bad, "joint", "q", ridge)
        holding = [r["client"] for r in owned.select("client").distinct().collect()]  # one number a client
        every = spark.range(clients).select(F.col("id").cast("int").alias("client"))
        taking = [(rate, r, _accuracy(Student(combine_tiles(parts.of([x["client"] for x in active_clients(every.filter(F.col("client").isin(holding)), rate, r, seed).collect()]), ridge)), held)) for rate in (1.0, 0.8, 0.5) for r in range(repeats)]
        sizes = client_sizes(owned, every).agg(F.min("n").alias("smallest_client"), F.max("n").alias("largest_client"), F.sum((F.col("n") == 0).cast("int")).alias("empty_clients")).collect()[0]
        summed = participation_summary(spark.createDataFrame(taking, "rate double, repeat int, accuracy double")).orderBy("rate").collect()
        return sizes.asDict() | {
            "alpha": alpha, "seed": seed, "weight_diff": largest_difference(central, weights),
            "accuracy": scored.agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a")).collect()[0]["a"], "worst_client": by["worst"], "client_variance": by["variance"],
            "naive_accuracy": _accuracy(Student(naive), held), "participation": [r.asDict() for r in summed],
        }
    finally:
        rows.unpersist()
        held.unpersist()


def federated_grid(train, labels, trusted, test, test_labels, config: Config, alphas: list[float], seeds: list[int], clients: int = 10) -> list[dict]:
    """A condition for each alpha and seed."""
    return [federated_condition(train, labels, trusted, a, clients, test, test_labels, config, s) for a in alphas for s in seeds]


def _accuracy(s: Student, rows: DataFrame) -> float:
    return s.predict(rows).agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a")).collect()[0]["a"]


def client_sizes(owned: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, n): rows of each client, also of those without any."""
    n = owned.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return clients.select("client").join(n, "client", "left").select("client", F.coalesce("n", F.lit(0)).alias("n"))


def client_accuracy(scored: DataFrame) -> DataFrame:
    """(client, n, accuracy); a client without rows has none."""
    return scored.groupBy("client").agg(F.count(F.lit(1)).alias("n"), exprs.accuracy(F.col("prediction"), F.col("label")).alias("accuracy"))


def participation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("rate").agg(F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("min_accuracy"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: share of ids with the same prediction."""
    return a.select("id", F.col("prediction").alias("x")).join(b.select("id", F.col("prediction").alias("y")), "id").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two result tables that differ by more than tolerance."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return both.filter(F.abs(F.col("a") - F.col("b")) > tolerance)


def monitoring(features: DataFrame, model, trusted: DataFrame, labels: DataFrame | None = None, clients: DataFrame | None = None) -> dict:
    """Share of classes with trusted rows and how often teacher and student disagree; with labels (id, label), the class the
    student does worst in; with clients (client, active), the share of them that takes part."""
    t = model.teacher.probabilities(features).select("id", exprs.argmax(F.col("p")).alias("t"))
    both = t.join(model.student.predict(features).select("id", "prediction"), "id")
    out = {
        "class_coverage": trusted.select("label").distinct().count() / model.config.classes,
        "disagreement": both.agg(F.avg((F.col("t") != F.col("prediction")).cast("double")).alias("d")).collect()[0]["d"],
    }
    if labels is not None:
        by = both.join(labels, "id").groupBy("label").agg(exprs.accuracy(F.col("prediction"), F.col("label")).alias("a"))
        worst = by.orderBy("a", "label").limit(1).collect()
        out |= {"worst_class": worst[0]["label"], "worst_accuracy": worst[0]["a"]} if worst else {}
    if clients is not None:
        out["participation"] = clients.agg(F.avg(F.col("active").cast("double")).alias("p")).collect()[0]["p"]
    return out


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or tiny)
                c = 1 + k / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def t_quantile(share: float, df: int) -> float:
    """The t that |T| exceeds with a chance of 1 - share."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 1 - share:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - share else (lo, mid)
    return hi


def signed_rank_p(differences: list[float]) -> float | None:
    """Two-sided exact p-value of the signed-rank test; equal sizes share their mean rank, zeros are left out."""
    d = [x for x in differences if x]
    if not d:
        return None
    size = [abs(x) for x in d]
    # Ranks in halves, so that every sum is a whole number.
    rank = [sum(y < x for y in size) * 2 + sum(y == x for y in size) + 1 for x in size]
    ways = {0: 1}
    for r in rank:
        nxt = dict(ways)
        for s, n in ways.items():
            nxt[s + r] = nxt.get(s + r, 0) + n
        ways = nxt
    plus = sum(r for r, x in zip(rank, d, strict=True) if x > 0)
    least = min(plus, sum(rank) - plus)
    return min(1.0, 2 * sum(n for s, n in ways.items() if s <= least) / 2 ** len(rank))


_SUMMARY = "n long, left_mean double, left_std double, right_mean double, gain double, gain_std double, gain_low double, gain_high double, wins long, ties long, losses long, left_max double, p_value double, signed_rank_p double"


def summary(results: DataFrame, left: str, right: str, by: str = "per_class") -> DataFrame:
    """For each budget: means, deviations, gain of left over right with its 95 % interval, wins, ties and losses, the p-values
    of the paired t-test and of the signed-rank test.

    A budget of one row, or one whose differences are all the same, has neither interval nor t-test; differences that are
    all zero have no signed-rank test. A budget's differences are gathered: a row for each seed."""
    d = F.col(left) - F.col(right)
    s = results.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(left).alias("left_mean"), F.stddev_samp(left).alias("left_std"), F.avg(right).alias("right_mean"),
        F.avg(d).alias("gain"), F.stddev_samp(d).alias("gain_std"), F.sum((d > 0).cast("long")).alias("wins"), F.sum((d == 0).cast("long")).alias("ties"),
        F.sum((d < 0).cast("long")).alias("losses"), F.max(left).alias("left_max"), F.collect_list(d).alias("d"),
    )
    rows = []
    for r in s.orderBy(by).collect():  # a row a budget
        x = r.asDict() | {"gain_low": None, "gain_high": None, "p_value": None, "signed_rank_p": signed_rank_p(r["d"])}
        if r["n"] > 1 and r["gain_std"]:
            error = r["gain_std"] / math.sqrt(r["n"])
            half = t_quantile(0.95, r["n"] - 1) * error
            x |= {"gain_low": r["gain"] - half, "gain_high": r["gain"] + half, "p_value": float(t_two_sided(r["gain"] / error, r["n"] - 1))}
        rows.append(tuple(x[c] for c in [by, *_SUMMARY.split()[::2]]))
    return results.sparkSession.createDataFrame(rows, f"{by} {results.schema[by].dataType.simpleString()}, {_SUMMARY}")


def placeholder_check(rows: DataFrame, classes: int, ridge: float) -> float:
    """Federated against central weights with the same target in every class."""
    u = F.array(*[F.lit(1.0 / classes)] * classes)
    same = rows.withColumn("q", u)
    parts = tiled_statistics(same, "phi", "q", "w", "client").kept(Store(rows.sparkSession, "clients"))
    return largest_difference(combine_tiles(parts, ridge), central_ridge(same, "phi", "q", ridge, "w"))


