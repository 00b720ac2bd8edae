"""What the operators share: tables, written intermediates, size-checked joins, byte kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which a side may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, named by spark.checkpoint.dir. Where that is unset: on one machine, as in tests, a
    folder of our own; on a cluster there is none that all can read, so it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='trustweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


class Written:
    """Tables written to the shared folder, so that later jobs neither recompute them nor depend on an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(at)
        path, system = self._system("")
        system.deleteOnExit(path)  # results may be read as long as the session lives
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path, system = self._system(f"/{name}")
        system.delete(path, True)

    def _system(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named in0, in1, ..., so that no working name meets one of them, and the new name of each."""
    names = {c: f"in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str], added: list[str]) -> DataFrame:
    """The columns put aside under their own names again, then the added ones, which replace those of the same name."""
    new = {a.lower() for a in added}
    return df.select(*(F.col(v).alias(k) for k, v in names.items() if k.lower() not in new), *added)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more than limit rows; reads no more than it must to tell."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count of the rows; without it, Spark shuffles and adaptive execution splits hot keys."""
    return F.broadcast(df) if small(df, limit) else df


def broadcast_bytes() -> int:
    """Bytes up to which a written side whose bytes were counted may be broadcast."""
    return 32 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


# ---------------------------------------------------------------- filters of a fixed size

#: Bits of a filter, whatever it is made of: 8 MB. As it fills up, it lets more pass, which the join behind it drops.
FILTER_BITS = 1 << 26


def filter_place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).cast("long").alias("_bit")


def filter_bits(places: DataFrame) -> np.ndarray:
    """The filter with a bit set for each place (column _bit); gathered as one number a word."""
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 31 AS int))")).alias("bits")
    rows = places.groupBy(F.shiftright("_bit", 5).alias("word")).agg(bits).toArrow()
    words = np.zeros(FILTER_BITS // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words


def passes(words: np.ndarray, places: pa.Array) -> pa.Array:
    bit = places.to_numpy(zero_copy_only=False)
    return pa.array((words[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1)


# ---------------------------------------------------------------- byte kernels

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1.. of the step and of its inverse, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        _powers["up"] = np.cumprod(np.full(size, _STEP, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, _STEP_INVERSE, np.uint64))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    for _ in range(2):
        x = x ^ (x >> np.uint64(32))
        x = x * _MIX
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[0] = 0 and H[i+1] = H[i] + (byte i + 1) step^(i+1), modulo 2^64."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of bytes lo..hi, the same wherever those bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _MIX)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
