"""Byte-level BPE against the library on whole texts."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trustweave.llm import byte_codec

RANKS = byte_codec.default_ranks()


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed):
    draw = random.Random(seed)
    parts = ["'", "'s", "'re", "'ll", "' s", " ", "  ", "\n", "\t", " ", " ", "r", "e", "really", "a", "Z", "é", "ﬁ", "漢字", "٣", "7", "123", "½", "!", "...", "😀", "\x00", "\x1c", "՘", "㐀", "'ve", "'v", "ve", "<|endoftext|>", "x" * 70]
    return ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(n)]


def test_cuts(library):
    kind = byte_codec.kinds_of_characters()
    codec = byte_codec.ByteCodec(byte_codec.read_ranks(RANKS), kind)
    for text in odd_texts(3000, 1):
        assert codec.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_every_character_between_letters(library):
    codec = byte_codec.ByteCodec(byte_codec.read_ranks(RANKS), byte_codec.kinds_of_characters())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(every), 5000):
        text = "a".join(every[at : at + 5000])
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(24, 8), (17, 3), (200, 100)])
def test_chunks_of_any_size(spark, library, chunk, overlap):
    texts = [*odd_texts(120, chunk), None, "", "a" * 500, " " * 300 + "x", "ab " * 300 + "q" * 400 + " cd" * 100, "ab " * 300, "ab " * 300]
    docs = spark.createDataFrame([(None if i % 7 == 3 else i % 100, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, k int, ids string")
    got = byte_codec.decode(byte_codec.encode(docs, RANKS, chunk=chunk, overlap=overlap), RANKS)
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got.collect()), key=repr)
    assert got == sorted(((None if i % 7 == 3 else i % 100, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)), key=repr)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert byte_codec.decode(byte_codec.encode(empty, RANKS), RANKS).count() == 0
    text = spark.createDataFrame([("a", "some text"), (None, "some text")], "doc_id string, text string")
    assert sorted(r["doc_id"] or "" for r in byte_codec.encode(text, RANKS).collect()) == ["", "a"]
    rows = spark.createDataFrame([([1, 2], b"old", 5), (None, b"", 6), ([], None, 7)], "ids array<int>, Decoded binary, n int")
    got = {r["n"]: r["decoded"] for r in byte_codec.decode(rows, RANKS).collect()}
    tokens = byte_codec.read_ranks(RANKS)
    assert got == {5: tokens[1] + tokens[2], 6: None, 7: b""}
    with pytest.raises(Exception, match="no rank"):
        byte_codec.decode(rows.withColumn("ids", F.array(F.lit(50_256))), RANKS).collect()
    with pytest.raises(ValueError):
        byte_codec.encode(text, RANKS, chunk=10, overlap=10)


def test_op12(spark, library):
    import hashlib

    at = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in byte_codec.op12(spark, at).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
