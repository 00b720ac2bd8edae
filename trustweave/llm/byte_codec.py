"""Byte-level BPE encoding and decoding; long texts by overlapping chunks that are stitched where pre-tokens meet again."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: Code points of a chunk and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Code points behind a boundary that decide whether it is one: the two letters of a contraction.
LOOK = 2
#: Pieces whose ids a task remembers, and code points of the longest of them.
KNOWN, KNOWN_LENGTH = 1 << 17, 64
#: Code points or ids that a task holds as Python's objects at a time (a longer row alone).
BLOCK = 1 << 20
#: The pattern whose matches `cuts` finds; no alternative looks behind itself.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = {1: ("s", "t", "m", "d"), 2: ("re", "ve", "ll")}
SPACE, LETTER, NUMBER, OTHER = range(4)


def read_ranks(path: str) -> list[bytes]:
    """Bytes of each token by its rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    return [found[i] for i in range(len(found))]


def _encoding(tokens: list[bytes], pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def kinds_of_characters() -> np.ndarray:
    """Kind of every code point as the library's own pattern engine sees it; other engines follow other editions of
    Unicode and differ in thousands of letters."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.full(0x110000, OTHER, np.uint8)
    single = [bytes([i]) for i in range(256)]
    for value, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        e = _encoding(single, pattern)  # what the pattern does not match has no ids
        kind[np.frombuffer(e.decode_bytes(e.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = value
    return kind


def cuts(text: str, kind: np.ndarray) -> np.ndarray:
    """Places where the pattern's matches begin, and the text's length; runs of one kind, found all at once."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(codes)
    if n == 0:
        return np.zeros(1, np.int64)
    k = kind[codes]
    begin = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
    end, of = np.append(begin[1:], n), k[begin]
    blank = of == SPACE
    tied = ~blank & (begin > 0) & (codes[begin - 1] == 0x20)  # a blank in front belongs to the match
    at = np.zeros(n + 1, bool)
    at[begin[~tied]] = True
    at[end[blank & (end < n)] - 1] = True  # white space gives its last character away, but at the text's end
    quote = np.flatnonzero((of[:-1] == OTHER) & (end[:-1] - begin[:-1] == 1) & (codes[begin[:-1]] == 0x27) & ~tied[:-1] & (of[1:] == LETTER))
    for a, z in zip((begin[quote] + 1).tolist(), end[quote + 1].tolist(), strict=True):
        more = next((m for m, known in CONTRACTIONS.items() if a + m <= z and text[a : a + m] in known), 0)
        if more:
            at[a] = False
            at[a + more] = True
    at[n] = True
    return np.flatnonzero(at)


def lists_of(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list for each array; they may differ in length."""
    flat = np.concatenate(rows) if rows else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, kind))


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts or lists have about BLOCK items."""
    of = batch.column(column)
    size = (pc.list_value_length if pa.types.is_list(of.type) else pc.utf8_length)(of).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // BLOCK
    cut = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cut, cut[1:], strict=False) if b > a)


class ByteCodec:
    """Ids of pieces, remembered up to a bound, and bytes of ids."""

    def __init__(self, tokens: list[bytes], kind: np.ndarray):
        self.tokens, self.kind, self.known = tokens, kind, {}
        self.library = _encoding(tokens, r"[\s\S]+")  # a piece is a match as a whole

    def pieces(self, text: str, at: np.ndarray) -> np.ndarray:
        """Ids of the pieces between places."""
        places = at.tolist()
        found = [text[a:b] for a, b in zip(places, places[1:], strict=False)]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = {p: np.array(self.library.encode_ordinary(p), "<i4").tobytes() for p in set(found).difference(self.known)}
        self.known |= {p: i for p, i in new.items() if len(p) <= KNOWN_LENGTH}
        known = self.known
        return np.frombuffer(b"".join([new[p] if p in new else known[p] for p in found]), "<i4")

    def encode(self, text: str) -> np.ndarray:
        return self.pieces(text, cuts(text, self.kind))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _chunk_rows(chunk: int, overlap: int):
    """(key, k, start, last, doc_id, text) of the overlapping chunks of each text."""
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py()
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(n):
                    one = [batch.column(0).slice(row, 1), pa.array([k], pa.int32()), pa.array([k * step]), pa.array([k == n - 1]), batch.column(1).slice(row, 1), pa.array([text[k * step : k * step + chunk]])]
                    yield pa.RecordBatch.from_arrays(one, ["key", "k", "start", "last", "doc_id", "text"])

    return run


def _sure(at: np.ndarray, length: int, last: bool) -> np.ndarray:
    """Places whose being a boundary no character behind the chunk can change."""
    return at if last else at[at + LOOK <= length]


def _marks(kind, overlap: int):
    """(key, k, head, tail): boundaries in what a chunk shares with the one before and the one behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (block for b in batches for block in blocks(b, 4)):
            heads, tails = [], []
            for start, last, text in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                at = _sure(cuts(text, kind.value), len(text), last)
                heads.append((at[at <= overlap] + start).tolist())
                tails.append([] if last else (at[at >= len(text) - overlap] + start).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["key", "k", "head", "tail"])

    return run


def _encode_chunks(tokens, kind, step: int):
    """(key, k, doc_id, ids, rest): ids between a chunk's first and last joint; as text what lies behind its last sure
    boundary if it does not meet the next chunk, and all of a chunk behind such a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(tokens.value, kind.value)
        for batch in (block for b in batches for block in blocks(b, 5)):
            ids, rests = [], []
            for start, last, text, begin, end, met in zip(*(batch.column(i).to_pylist() for i in (2, 3, 5, 6, 7, 8)), strict=True):
                if not met:
                    ids.append(np.empty(0, "<i4"))
                    rests.append(text if last else text[:step])
                    continue
                begin -= start
                at = begin + cuts(text[begin:], codec.kind)
                if end is not None or last:
                    stop = len(text) if last else end - start
                else:
                    stop = int(max(at[(at <= step) & (at + LOOK <= len(text))], default=begin))
                ids.append(codec.pieces(text, at[at <= stop]))
                rests.append("" if end is not None or last else text[stop:step])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), lists_of(ids, pa.int32()), pa.array(rests, pa.string())], ["key", "k", "doc_id", "ids", "rest"])

    return run


def _assemble(tokens, kind):
    """(doc_id, ids) of runs of rows with one key, in the order of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, key, doc, have, rest = ByteCodec(tokens.value, kind.value), None, None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc, lists_of([np.concatenate([*have, codec.encode("".join(rest))])], pa.int32())], ["doc_id", "ids"])

        for batch in batches:
            for row in range(batch.num_rows):
                now = batch.column(0)[row].as_py()
                if now != key:
                    if key is not None:
                        yield out()
                    key, doc, have, rest = now, batch.column(2).slice(row, 1), [], []
                have.append(batch.column(3)[row].values.to_numpy(zero_copy_only=False))  # ids never come behind a rest
                rest.append(batch.column(4)[row].as_py())
        if key is not None:
            yield out()

    return run


def encode(docs: DataFrame, ranks: str, text: str = "text", id_column: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of each row: what the library gives for the whole text with PATTERN and no special tokens.

    ranks: path of the rank file on the driver; its tokens go to the executors (a file of fixed size). Texts of up to
    `chunk` code points are encoded where they lie. Longer ones are cut into chunks that share `overlap` code points
    and are dealt out. Each chunk is pre-tokenised by itself; two chunks are joined at the first boundary that both
    found in what they share. No match looks behind itself, so from there on the right chunk's boundaries are those of
    the text. The pieces between joints are then encoded chunk by chunk. Where a pre-token is so long that chunks do not
    meet, the text from there on is encoded in one piece with its document: the same ids, less spread out.

    Null text is empty and has no ids. Null ids, repeated rows and rows with equal ids stay as they are; other columns
    are not read; no rows give no rows. White space that is too long for the library's engine follows the same rule.
    """
    if not LOOK < overlap < chunk:
        raise ValueError("an overlap must be longer than what decides on a boundary, and shorter than a chunk")
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(ranks))
    kind = spark.sparkContext.broadcast(kinds_of_characters())
    each = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of, step = each.schema["doc_id"].dataType.simpleString(), chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(tokens.value, kind.value)
        for batch in (block for b in batches for block in blocks(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of([codec.encode(t) for t in batch.column(1).to_pylist()], pa.int32())], ["doc_id", "ids"])

    short = each.filter(F.char_length("text") <= chunk).mapInArrow(run, f"doc_id {of}, ids array<int>")
    keep = Written(spark, "bytes")
    long = each.filter(F.char_length("text") > chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    chunks = long.mapInArrow(_chunk_rows(chunk, overlap), f"key long, k int, start long, last boolean, doc_id {of}, text string")
    chunks = keep.put(chunks.repartition("key", "k"), "chunks")  # keys are given once: other jobs read them
    marks = chunks.select("key", "k", "start", "last", "text").mapInArrow(_marks(kind, overlap), "key long, k int, head array<long>, tail array<long>")
    in_order = Window.partitionBy("key").orderBy("k")
    joint = F.array_min(F.array_intersect("tail", F.lead("head").over(in_order)))
    met = F.coalesce(F.min(F.col("end").isNotNull()).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    joints = marks.select("key", "k", joint.alias("end")).select("key", "k", F.coalesce(F.lag("end").over(in_order), F.lit(0)).alias("begin"), "end", met.alias("met"))
    parts = chunks.join(joints, ["key", "k"]).select("key", "k", "start", "last", "doc_id", "text", "begin", "end", "met").mapInArrow(_encode_chunks(tokens, kind, step), f"key long, k int, doc_id {of}, ids array<int>, rest string")
    whole = parts.repartition("key").sortWithinPartitions("key", "k").mapInArrow(_assemble(tokens, kind), f"doc_id {of}, ids array<int>")
    return short.unionByName(whole)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded and the bytes its ids stand for, one token's behind the other; they need not be text. A column of the same
    name is replaced; null ids have null bytes; an id that is no rank is refused."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    kept = [c for c in encoded.columns if c.lower() != out.lower()]
    at = [c.lower() for c in kept].index(ids.lower())
    schema = encoded.select(*kept).schema.add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        for batch in (block for b in batches for block in blocks(b, at)):
            rows = [None if i is None else b"".join(map(known.__getitem__, i)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], [*kept, out])

    refused = F.raise_error(F.lit("an id is no rank")).cast(schema[kept[at]].dataType)
    valid = F.when(F.exists(ids, lambda i: (i < 0) | (i >= len(tokens.value))), refused).otherwise(F.col(ids))
    return encoded.select(*(valid.alias(c) if i == at else F.col(c) for i, c in enumerate(kept))).mapInArrow(run, schema)


def default_ranks() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the rank file is for another pattern")
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op12(spark, sf_dir, ranks: str | None = None):
    ranks = ranks or default_ranks()
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
