"""Sums of clients add up: weights out of ten clients' sums and out of all rows at once."""

from pyspark.sql import SparkSession

from trustweave.operators.audit import federated_audit, federated_problem


def run(spark: SparkSession) -> float:
    return federated_audit(federated_problem(spark, rows=1000, width=80, classes=10, clients=10), 1.0)


if __name__ == "__main__":
    print("largest difference", run(SparkSession.builder.getOrCreate()))
