"""SentencePiece encoding and decoding through tables of distinct chunks."""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

MARK = "▁"
#: A chunk: white-space markers and what follows up to the next marker.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Most chunks that are sent to the tasks, characters of text that a task splits at a time, and the number of times from
#: which chunks are not told apart by how often they stand there.
TABLE, BLOCK, COUNTED = 100_000, 1 << 20, 10_000
#: Code points of the longest chunk that the table takes; with TABLE, a bound on its bytes.
LONGEST = 256


class ChunkCodec:
    """Encodes texts as the library does, chunk by chunk.

    Holds where no piece has a marker behind another character, text isn't normalised, a marker is put in front and
    blanks aren't removed: then no merge joins two chunks, and a text's ids are its chunks' ids in order. For any other
    model the library gets whole texts.

    table: ids of chunks; odd: the decoded text of those that do not decode to themselves. A chunk that is not in them
    is segmented once for each call of run.
    """

    def __init__(self, model: str | bytes, bos: bool = True, eos: bool = True, table: dict[str, bytes] | None = None, odd: dict[str, str] | None = None):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model) if isinstance(model, str) else sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table, self.odd, self.bos, self.eos = table or {}, odd or {}, bos, eos
        ids = lambda use, x: np.array([x] if use else [], "<u4").tobytes()
        self.head, self.tail = ids(bos, self.sp.bos_id()), ids(eos, self.sp.eos_id())
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        probe = f" a  b{MARK}céÅﬁ\td "
        apart = self.sp.decode(self.sp.encode(probe)) == probe.replace(MARK, " ") and self.sp.encode("", out_type=str) == [] and self.sp.encode("a", out_type=str)[0].startswith(MARK)
        user = any(self._user_defined(i) for i in range(self.sp.get_piece_size()))
        self.by_chunk = apart and not user and not any(MARK in p.lstrip(MARK) for p in pieces)

    def _user_defined(self, i: int) -> bool:
        sp = self.sp
        return not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and sp.get_score(i) == 0.0 and i > 300

    def segment(self, chunks: list[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Ids of each chunk, and the decoded text of those that do not decode to themselves."""
        ids = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1) if chunks else []  # the library puts the first marker in front
        # A lone marker stands for an empty text, which the library leaves without one.
        table = {c: np.array(i or [self.sp.piece_to_id(MARK)], "<u4").tobytes() for c, i in zip(chunks, ids, strict=True)}
        back = self.sp.decode(ids) if chunks else []
        return table, {c: " " + t for c, t in zip(chunks, back, strict=True) if " " + t != c.replace(MARK, " ")}

    def run(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        if not self.by_chunk:
            ids = self.sp.encode(texts, add_bos=self.bos, add_eos=self.eos, num_threads=1)
            return [(np.array(i, "<u4").tobytes(), self.sp.decode(i)) for i in ids]
        split = [chunks_of(t) for t in texts]
        more, odd = self.segment(list(set().union(*split).difference(self.table)))
        known, odd = ChainMap(more, self.table) if more else self.table, odd | self.odd if odd else self.odd
        out = []
        for chunks in split:
            ids = b"".join((self.head, *map(known.__getitem__, chunks), self.tail))
            text = "".join([odd[c] if c in odd else c for c in chunks] if odd else chunks).replace(MARK, " ")
            out.append((ids, text[1:]))
        return out


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about BLOCK characters."""
    at = 0
    while at < batch.num_rows:
        texts, size, first = [], 0, at
        while at < batch.num_rows and (size < BLOCK or at == first):
            texts.append(batch.column(column)[at].as_py() or "")
            size += len(texts[-1])
            at += 1
        yield first, texts


def chunk_table(docs: DataFrame, shared, text: str = "text", limit: int = TABLE) -> DataFrame:
    """(chunk, ids, decoded) of the distinct chunks of all texts, each segmented once; decoded is null where a chunk decodes
    to itself. If there are more than limit, those that stand there most often; of chunks that stand there equally often,
    or COUNTED times or more, those with the smallest hashes, so that the table is always full. Chunks of over LONGEST code
    points are left to the tasks that meet them. Chunks are counted before they are shuffled; no position is."""
    keep = Written(docs.sparkSession, "chunks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _blocks(batch, 0):
                n = Counter(c for c in chain.from_iterable(map(chunks_of, texts)) if len(c) <= LONGEST)
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["chunk", "n"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ChunkCodec(shared.value)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            ids, odd = own.segment(chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.values(), pa.binary()), pa.array([odd.get(c) for c in chunks], pa.string())], ["chunk", "ids", "decoded"])

    counts = docs.select(text).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.least(F.sum("n"), F.lit(COUNTED)).alias("n"))
    counts = keep.put(counts, "counts")
    least, room, level = COUNTED + 1, limit, None
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).collect():  # COUNTED rows at most
        if r["count"] > room:
            level = r["n"]  # goes in part
            break
        least, room = r["n"], room - r["count"]
    taken = counts.filter(F.col("n") >= least)
    if level is not None and room:
        taken = taken.unionByName(counts.filter(F.col("n") == level).orderBy(F.xxhash64("chunk"), "chunk").limit(room))
    return keep.put(taken.select("chunk").mapInArrow(segment, "chunk string, ids binary, decoded string"), "table")


def encode_decode(docs: DataFrame, model: str, text: str = "text", id_column: str = "doc_id", bos: bool = True, eos: bool = True, limit: int = TABLE) -> DataFrame:
    """(doc_id, ids, decoded) of each row; ids as little-endian unsigned 32-bit integers in one binary value.

    model: path of a SentencePiece model on the driver; its bytes go to the executors. Null text is empty: begin
    and end ids only. Texts of any length are encoded whole. Null ids and repeated rows stay as they are; other
    columns are not read; no rows give no rows.

    The distinct chunks of all texts are segmented once and sent to the tasks, which put their ids together in the
    order of the chunks. At most `limit` are sent, those that stand there most often; a task segments another once
    for each BLOCK of texts it meets it in.
    """
    with open(model, "rb") as f:
        proto = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(proto)  # a file of fixed size
    known = None
    codec = ChunkCodec(proto, bos, eos)
    if codec.by_chunk:
        t = chunk_table(docs, shared, text, limit).toArrow()  # limit rows at most
        chunks, ids, decoded = (t[c].to_pylist() for c in ("chunk", "ids", "decoded"))
        known = docs.sparkSession.sparkContext.broadcast((dict(zip(chunks, ids, strict=True)), {c: d for c, d in zip(chunks, decoded, strict=True) if d is not None}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(shared.value, bos, eos, *(known.value if known else ()))
        for batch in batches:
            for first, texts in _blocks(batch, 1):
                got = codec.run(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def ids_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9(spark, sf_dir, model: str | None = None):
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model or default_model())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
