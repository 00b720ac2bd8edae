"""The table of chunks at its limit, and texts that are one long chunk."""

import numpy as np
import sentencepiece

from trustweave.llm import piece_codec

MODEL = piece_codec.default_model()


def test_table_is_full_where_chunks_stand_equally_often(spark):
    with open(MODEL, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    texts = [" ".join(f"word{i}" for i in range(1000)), " ".join(["often"] * 3 + ["more"] * 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for limit in (0, 1, 2, 500, 1002, 5000):
        table = [r["chunk"] for r in piece_codec.chunk_table(docs, shared, limit=limit).collect()]
        assert len(table) == len(set(table)) == min(limit, 1002)
        assert {"▁often", "▁more"}.issubset(table) or limit < 2
        again = [r["chunk"] for r in piece_codec.chunk_table(docs.repartition(2), shared, limit=limit).collect()]
        assert sorted(table) == sorted(again)


def test_any_limit_gives_the_ids_of_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a b a b c", "", None, "x" * 300_000, "é" * 257 + " " + "é" * 256, "a  b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for limit in (0, 2, 100):
        for r in piece_codec.encode_decode(docs, MODEL, limit=limit).collect():
            ids = sp.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == sp.decode(ids)
