"""Tables written to the folder that the cluster shares, which later jobs read instead of a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: on one machine, as in tests, a folder of our own;
    on a cluster there is none that all can read, so it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='trustweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Store:
    """Tables below a folder of its own; what isn't dropped before goes at the session's end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(at)
        path, system = self._system("")
        system.deleteOnExit(path)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path, system = self._system(f"/{name}")
        system.delete(path, True)

    def _system(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
