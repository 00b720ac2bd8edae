"""Quality classifier by compression under dictionaries of good and of bad text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, text_bytes

#: Bytes of a dictionary, level, most labelled rows of a class that are fitted on (half make the dictionary, half the
#: calibration) and their longest text; score from which a text is predicted good.
DICTIONARY, LEVEL, MAX_ROWS, MAX_BYTES, CUT = 112_640, 3, 6000, 16_384, 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    level: int
    slope: float
    offset: float

    def compressors(self):
        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def difference(self, text: bytes, good, bad) -> float:
        """Bytes that the good dictionary saves over the bad one, a byte of text."""
        return (len(bad.compress(text)) - len(good.compress(text))) / len(text) if text else 0.0

    def score(self, difference: float) -> float:
        z = self.slope * difference + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a little ridge so that it always ends."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b" "


def fit(labelled: DataFrame, level: int = LEVEL, size: int = DICTIONARY, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> CompressionModel:
    """labelled: rows (doc_id, text, quality). The first max_rows texts of each class by md5 of the id with 1 to
    max_bytes bytes, whole, come to the driver: 2 * max_rows * max_bytes bytes at most. Every other one makes the
    dictionaries, the rest fit the calibration."""
    order = F.md5(F.col("doc_id").cast("string"))
    rows = []
    for kind in (1, 0):
        some = labelled.filter((F.col("quality") == kind) & F.octet_length("text").between(1, max_bytes))
        rows.append([bytes(r["text"], "utf-8") for r in some.orderBy(order, "doc_id").limit(max_rows).select("text").collect()])
    model = CompressionModel(_dictionary(rows[0][::2], size), _dictionary(rows[1][::2], size), level, 1.0, 0.0)
    if not rows[0] or not rows[1]:  # nothing to tell apart
        return CompressionModel(model.good, model.bad, level, 0.0, 10.0 if rows[0] else -10.0 if rows[1] else 0.0)
    g, b = model.compressors()
    x = np.array([model.difference(t, g, b) for part in rows for t in part[1::2] or part])
    y = np.concatenate([np.full(len(part[1::2] or part), k, float) for part, k in zip(rows, (1, 0), strict=True)])
    slope, offset = calibrate(x, y)
    return CompressionModel(model.good, model.bad, level, slope, offset)


def score(docs: DataFrame, model: CompressionModel, id_column: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """(id, difference, score, predicted) of each row.

    Null or empty text: difference 0, so the score of the offset alone. Repeated rows get the same score. Null id
    stays null. Other columns are not read; no rows give no rows. Texts of any length are compressed whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        g, b = m.compressors()
        for batch in batches:
            d = [m.difference(t, g, b) for t in text_bytes(batch.column(1))]
            s = [m.score(x) for x in d]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.float64()), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())], ["doc_id", "difference", "score", "predicted"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, difference double, score double, predicted int")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(part != 0).filter("quality IN (0, 1)").select("doc_id", "quality")
    # Ids first: at most four times the rows that are fitted on, so that enough short texts are among them.
    some = [labels.filter(F.col("quality") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(2 * MAX_ROWS) for k in (0, 1)]
    ids = Written(spark, "classifier").put(some[0].unionByName(some[1]), "ids")
    model = fit(docs.join(F.broadcast(ids), "doc_id"))
    return score(docs, model).select("doc_id", (part == 0).alias("held_out"), "score", "predicted", "difference")
