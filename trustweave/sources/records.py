"""Files of records of one length as a data source: byte ranges are partitions, and labels can be read alone."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "fixed_records"
#: Bytes of a range, and of what a task reads of it, or a writer makes, at a time.
RANGE, BLOCK = 64 << 20, 4 << 20


@dataclass
class Range(InputPartition):
    """Records first..first + count - 1 of a file."""

    file: int
    path: str
    first: int
    count: int


@dataclass
class Part(WriterCommitMessage):
    path: str
    records: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class FixedRecords(DataSource):
    """Options: length (bytes of a record, the first of which is its label), files (a JSON list of number, path and
    bytes, see read_fixed), labels (true: nothing but the label leaves the reader), range (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file int, record long, label int" + ("" if self.options.get("labels") == "true" else ", bytes binary")

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.length, self.labels = int(options["length"]), options.get("labels") == "true"
        self.files, self.range = json.loads(options["files"]), int(options.get("range", RANGE))

    def partitions(self) -> list[Range]:
        step, out = max(1, self.range // self.length), []
        for file, path, size in self.files:
            n = size // self.length
            out += [Range(file, path, at, min(step, n - at)) for at in range(0, n, step)]
        return out or [Range(0, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """Blocks of records. A range reads its own bytes only; of those, a reader of labels keeps every length-th."""
        if not part.count:
            return
        system, path = _opened(part.path)
        step, n = max(1, BLOCK // self.length), self.length
        with system.open_input_file(path) as f:
            for at in range(part.first, part.first + part.count, step):
                count = min(step, part.first + part.count - at)
                x = np.frombuffer(f.read_at(count * n, at * n), np.uint8).reshape(count, n)
                cols = [pa.array(np.full(count, part.file, np.int32)), pa.array(np.arange(at, at + count)), pa.array(x[:, 0].astype(np.int32))]
                names = ["file", "record", "label"]
                if not self.labels:
                    rest = pa.py_buffer(np.ascontiguousarray(x[:, 1:]))
                    off = pa.py_buffer((np.arange(count + 1) * (n - 1)).astype(np.int32))
                    cols.append(pa.Array.from_buffers(pa.binary(), count, [None, off, rest]))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(cols, names)


class RecordWriter(DataSourceArrowWriter):
    """A file for each task that has rows (label, bytes), below the folder of option path; those of tasks that failed or
    ran twice are removed or never named, as every file has a name of its own and only committed ones stay."""

    def __init__(self, options):
        self.length, self.path = int(options["length"]), options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        at, n, out = f"{folder}/part-{uuid.uuid4().hex}.bin", 0, None
        try:
            for whole in batches:
                for first in range(0, whole.num_rows, max(1, BLOCK // self.length)):
                    batch = whole.slice(first, max(1, BLOCK // self.length))
                    x = np.empty((batch.num_rows, self.length), np.uint8)
                    label, body = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "bytes"))
                    for i, (one, rest) in enumerate(zip(label.to_pylist(), body, strict=True)):
                        rest = rest.as_buffer()
                        if one is None or not 0 <= one < 256 or rest is None or len(rest) != self.length - 1:
                            raise ValueError(f"a record is a label from 0 to 255 and {self.length - 1} bytes")
                        x[i, 0], x[i, 1:] = one, np.frombuffer(rest, np.uint8)
                    out = out or system.open_output_stream(at)
                    out.write(x)
                    n += len(x)
        finally:
            if out:
                out.close()
        return Part(at if n else "", n)

    def commit(self, messages: list[Part | None]) -> None:
        """Files of attempts that were not committed go."""
        system, folder = _opened(self.path)
        kept = {m.path for m in messages if m and m.path}
        system.create_dir(folder, recursive=True)
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith("part-") and f.path not in kept:
                system.delete_file(f.path)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


def read_fixed(spark: SparkSession, paths: str | list[str], length: int, labels: bool = False, bytes_each: int = RANGE, names: list[str] | None = None) -> DataFrame:
    """(file, record, label, bytes) of all records of the files at paths (files, folders or patterns), files with records
    numbered by their place in `names` or, without it, in the order of their paths; labels: without bytes. Files are found and measured by Spark, which reads none of them for it; a file
    whose length is no multiple of the record's is refused before any is read. Ranges of about bytes_each are partitions,
    whatever the files' sizes. Read through Arrow's file systems (local, HDFS, S3, GCS)."""
    if length < 2:
        raise ValueError("a record has a label and at least one byte")
    found = spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect()  # a row a file
    if not found:
        raise ValueError(f"there is no file at {paths}")
    if bad := [r["path"] for r in found if r["length"] % length]:
        raise ValueError(f"{bad[0]} is not made of records of {length} bytes")
    spark.dataSource.register(FixedRecords)
    number = {name: i for i, name in enumerate(names or [])}
    files = json.dumps([(number[r["path"].rsplit("/", 1)[-1]] if names else i, r["path"], r["length"]) for i, r in enumerate(found)])
    return spark.read.format(NAME).options(length=length, files=files, labels=str(labels).lower(), range=bytes_each).load()


def write_fixed(df: DataFrame, path: str, length: int) -> None:
    """Rows (label, bytes) as files of records in a new or empty folder, a file for each partition that has rows."""
    df.sparkSession.dataSource.register(FixedRecords)
    df.select("label", "bytes").write.format(NAME).mode("append").options(length=length).save(path)
