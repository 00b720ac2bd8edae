"""python -m trustweave info | audit | federated-audit"""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import STUDENTS, Config
from .functions import exprs
from .operators import audit, pipeline
from .sources.synthetic import problem


def info(_) -> dict:
    return {"version": __version__, "fit": str(inspect.signature(pipeline.fit)), "architectures": list(STUDENTS), "default": Config().student, "takes_untrusted_labels": False, "passed": True}


def run_audit(seed: int) -> dict:
    spark = SparkSession.builder.getOrCreate()
    features, labels, trusted, config = problem(spark, seed)
    text = labels.select("id", F.col("label").cast("string").alias("label"))
    marked = labels.join(trusted.select("id", F.lit(True).alias("t")), "id", "left").select("id", exprs.sentinel(F.col("label"), F.col("t").isNotNull()).alias("label"))
    out = {}
    for name in STUDENTS:
        out[name] = audit.mutation_audit(features, trusted, text, marked, replace(config, student=name)).to_dict()
    return out | {"passed": all(x["passed"] for x in out.values())}


def run_federated(seed: int) -> dict:
    rows = audit.federated_problem(SparkSession.builder.getOrCreate(), seed)
    plain, weighted = audit.federated_audit(rows, 1.0), audit.federated_audit(rows, Config().linear_ridge, weight="w")
    return {"max_weight_diff": plain, "max_weight_diff_trusted_weighted": weighted, "passed": plain < 1e-10 and weighted < 1e-10}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trustweave")
    parser.add_argument("--version", action="version", version=__version__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, f in (("info", info), ("audit", run_audit), ("federated-audit", run_federated)):
        p = sub.add_parser(name)
        p.add_argument("--seed", type=int, default=1)
        p.set_defaults(f=f)
    args = parser.parse_args(argv)
    out = args.f(args.seed)
    print(json.dumps(out, indent=2))
    return 0 if out["passed"] else 1


if __name__ == "__main__":
    sys.exit(main())
