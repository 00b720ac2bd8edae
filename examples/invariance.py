"""Untrusted labels do not matter: two fits whose untrusted labels differ give the same targets and weights, to the last bit."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trustweave import mutation_audit
from trustweave.functions import exprs
from trustweave.sources.synthetic import problem


def run(spark: SparkSession) -> dict:
    features, labels, trusted, config = problem(spark, rows=240, widths=(10, 6), per_class=10)
    known = labels.join(trusted.select("id", F.lit(True).alias("t")), "id", "left")
    text = known.select("id", F.col("label").cast("string").alias("label"))
    marked = known.select("id", exprs.sentinel(F.col("label"), F.col("t").isNotNull()).alias("label"))
    return mutation_audit(features, trusted, text, marked, config).to_dict()


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate()))
