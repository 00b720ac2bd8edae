"""Arrays between Arrow batches and NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a small table as arrays; array columns as matrices."""
    t = df.select(*columns).toArrow().combine_chunks()
    out = []
    for c in columns:
        x = t[c].combine_chunks() if t.num_rows else pa.array([], t[c].type)
        out.append(matrix(x) if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else x.to_numpy(zero_copy_only=False))
    return out


#: Bytes of the matrix that with_array makes of an input at a time.
CHUNK_BYTES = 4 << 20


def byte_rows(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column as a matrix, not copied; all of one length and none null, or it is refused."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if column.null_count or (np.diff(at) != at[1:2] - at[:1]).any():
        raise ValueError("all rows must have bytes, as many in each")
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def with_array(df: DataFrame, name: str, inputs: list[str], make: Callable[..., np.ndarray], chunk: int = 2000, read: Callable[[pa.Array], np.ndarray] = matrix, drop: bool = False) -> DataFrame:
    """df and an array of doubles that make computes from matrices of the inputs (as read gives them), a chunk of rows and
    CHUNK_BYTES of a matrix at a time; drop: without the inputs."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name and not (drop and f.name in inputs)] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            wide = max([8 * read(c.slice(0, 1)).shape[1] for c in own] if batch.num_rows else [0])
            step = max(1, min(chunk, CHUNK_BYTES // max(1, wide)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = make(*(read(c.slice(at, step)) for c in own))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), lists(out)], [*keep, name])

    return df.mapInArrow(run, schema)
