"""Substring dedup over sliding sentence spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, broadcast_bytes, mix, powers, prefix_hash, span_hash, text_bytes

#: Words a span has at least; it has two sentences at least.
LEAST = 24
#: A sentence ends after a word with one of these last bytes or before a line's end, after a word for which
#: (7 * bytes + last byte) % ONE_IN = 0, and after LONGEST words: so sentences are short in any language, and those of a
#: passage are the same wherever it is planted.
MARKS, ONE_IN, LONGEST = b".!?", 32, 16
#: Bytes of text that are looked at together; a share of the spans that makes one hot, so that there are few of those.
SLAB, HOT = 1 << 20, 1024
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(MARKS)] = True
_SECOND = np.uint64(0xA24BAED4963EE407)


class Slab:
    """Sentences and spans of some texts, in order: arrays over all of them.

    doc, start: the text of each sentence, and the place of its first byte in all the bytes.
    span, last, h1, h2: each span's first and last sentence and its 128 bits, which do not depend on the kind or
    number of blanks between words.
    """

    def __init__(self, texts: list[bytes], least: int = LEAST):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.data, self.at = data, np.concatenate(([0], ends))
        space = _SPACES[data]
        before = np.concatenate(([True], space[:-1]))
        lo = np.flatnonzero(~space & before)
        hi = np.flatnonzero(space & ~before)
        doc = np.searchsorted(ends, lo, side="right")
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        following = np.append(lo[1:], len(data))
        final = data[hi - 1] if len(hi) else np.zeros(0, np.uint8)
        end = _MARKS[final] | (breaks[following] > breaks[hi]) | ((7 * (hi - lo) + final) % ONE_IN == 0)
        begin = np.concatenate(([True], end[:-1])) if len(lo) else np.zeros(0, bool)
        run = np.flatnonzero(begin)
        since = np.arange(len(lo)) - np.repeat(run, np.diff(np.append(run, len(lo))))
        first = np.flatnonzero(since % LONGEST == 0)  # word that each sentence begins with
        bound = np.append(first, len(lo))
        self.doc, self.start = doc[first], lo[first]
        # A text's first sentence has its leading blanks too.
        head = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if len(first) else np.zeros(0, bool)
        self.start = np.where(head, self.at[self.doc], self.start)
        # The shortest run of sentences from each with enough words and two sentences, within its text.
        stop = np.searchsorted(bound, bound[:-1] + least, side="left")
        stop = np.maximum(stop, np.arange(len(first)) + 2)
        limit = np.searchsorted(self.doc, self.doc, side="right")
        whole = np.flatnonzero(stop <= limit)
        # And the shortest run up to each text's end, without which no span may reach that.
        top = limit[head]
        back = np.minimum(np.searchsorted(bound, bound[top] - least, side="right") - 1, top - 2)
        more = (back >= np.flatnonzero(head)) & (stop[np.maximum(back, 0)] != top)
        span, stop = np.concatenate((whole, back[more])), np.concatenate((stop[whole], top[more]))
        order = np.lexsort((stop, span))
        self.span, stop = span[order], stop[order]
        self.last = stop - 1
        a, b = bound[self.span], bound[stop]
        with np.errstate(over="ignore"):
            word = span_hash(prefix_hash(data), lo, hi)
            up, down = powers(len(word) + 1)
            hashes = []
            for w in (word, mix(word * _SECOND + _SECOND)):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)))
                hashes.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * _SECOND).view(np.int64))
        self.h1, self.h2 = hashes

    def first_in_text(self) -> np.ndarray:
        """Of each text's spans with the same words, the first."""
        order = np.lexsort((np.arange(len(self.span)), self.h2, self.h1, self.doc[self.span]))
        d, x, y = self.doc[self.span][order], self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        out = np.zeros(len(order), bool)
        out[order[new]] = True
        return out


def slabs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):  # about SLAB bytes at once
        first, total = at, 0
        while at < len(texts) and (at == first or total + len(texts[at]) < SLAB):
            total += len(texts[at]) + 1
            at += 1
        yield first, at


def _spans(least: int):
    """(h1, h2, row, pos) of batches of (row, text): row as given, pos the span's number in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slabs(texts):
                s = Slab(texts[lo:hi], least)
                of = s.doc[s.span]
                head = np.searchsorted(of, np.arange(hi - lo))
                at = np.flatnonzero(s.first_in_text())
                doc = of[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.h1[at]), pa.array(s.h2[at]), batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array((at - head[doc]).astype(np.int32))], ["h1", "h2", "row", "pos"]
                )

    return run


def _without(least: int):
    """(row, n_sentences, removed, kept_text) of batches of (row, text, starts): starts are spans that stand elsewhere first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = text_bytes(batch.column(1)), batch.column(2)
            for lo, hi in slabs(texts):
                s = Slab(texts[lo:hi], least)
                n = len(s.doc)
                head = np.searchsorted(s.doc, np.arange(hi - lo + 1))
                gone = ~s.first_in_text()
                given = starts.slice(lo, hi - lo)
                if given.null_count < len(given):
                    per = np.diff(given.offsets.to_numpy())
                    flat = given.flatten().to_numpy(zero_copy_only=False)
                    per = np.where(given.is_null().to_numpy(zero_copy_only=False), 0, per)
                    gone[flat + np.repeat(np.searchsorted(s.doc[s.span], np.arange(hi - lo)), per)] = True
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, s.span[gone], 1)
                np.add.at(step, s.last[gone] + 1, -1)
                out = np.cumsum(step[:n]) > 0
                kept, removed = [], []
                for i in range(hi - lo):
                    a, b = head[i], head[i + 1]
                    removed.append(np.flatnonzero(out[a:b]).astype(np.int32))
                    if not len(removed[-1]):
                        kept.append(texts[lo + i])
                        continue
                    edge = np.append(s.start[a:b], s.at[i + 1] - 1)
                    stay = np.repeat(~out[a:b], np.diff(edge))
                    kept.append(s.data[edge[0] : edge[-1]][stay].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(head), pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["row", "n_sentences", "removed", "kept_text"],
                )

    return run


def drop_repeated_spans(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, _key, n_sentences, removed, kept_text) for each row of docs.

    A span is the shortest run of sentences, from each sentence on and up to the text's end, that has two of them and
    `least` words. Each is hashed (128 bits); of the places where one stands, the first by (doc_id, key of the text, position) keeps it, and all
    sentences that any other place covers go, with the blanks behind them. removed: their positions, ascending;
    kept_text: the rest as it was.

    Null or empty text, or fewer words or sentences than a span: nothing goes; null gives an empty kept_text. Null
    doc_id: before all others. Rows with the same doc_id and text are one document and get the same result. A span that
    a text repeats loses all but its first place. Other columns of docs are not read. No rows give no rows.

    Spans that hold more than a HOT-th of all places are joined by broadcast, of which there can be HOT at most; all others
    are joined by shuffle, in which none is longer than that.
    """
    spark = docs.sparkSession
    keep = Written(spark, "spans")
    row = F.struct("doc_id", F.xxhash64(F.col("doc_id"), F.col(text)).alias("key"))
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    spans = keep.put(rows.mapInArrow(_spans(least), f"h1 long, h2 long, row {kind}, pos int"), "spans")
    place = F.struct(F.col("row"), F.col("pos"))
    often = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    often = keep.put(often, "often")
    share = spans.count() // HOT
    hot, rest = often.filter(F.col("n") > share).drop("n"), often.filter(F.col("n") <= share).drop("n")
    cold = spans.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti") if share else spans
    both = cold.join(rest, ["h1", "h2"])
    both = both.unionByName(spans.join(F.broadcast(hot), ["h1", "h2"])) if share else spans.join(often.drop("n"), ["h1", "h2"])
    later = both.filter(~place.eqNullSafe(F.col("first"))).select("row", "pos")
    # Bounded by the sentences of one document.
    gone = keep.put(later.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "gone")
    keep.drop("spans")
    size = gone.agg(F.sum(F.size("starts").cast("long") * 4 + 64).alias("n")).collect()[0]["n"] or 0
    gone = gone.select(F.col("row.key").alias("key"), F.col("row.doc_id").alias("id"), "starts")
    if size <= broadcast_bytes():
        gone = F.broadcast(gone)
    same = (F.col("row.key") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("id"))
    out = rows.join(gone, same, "left").select("row", "text", "starts")
    out = out.mapInArrow(_without(least), f"row {kind}, n_sentences long, removed array<int>, kept_text string")
    return out.select("row.doc_id", F.col("row.key").alias("_key"), "n_sentences", "removed", "kept_text")


def op3(spark, sf_dir):
    out = drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    runs = F.expr("size(filter(transform(removed, (x, i) -> i = 0 OR removed[i - 1] <> x - 1), y -> y))")
    return out.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), runs.cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS raws FROM documents),
x AS (SELECT rid, doc_id, unnest(raws) AS raw, generate_subscripts(raws, 1) AS k FROM d),
y AS (SELECT *, regexp_extract(raw, '[^\x20\x09-\x0D]+') AS word FROM x),
z AS (SELECT *, regexp_matches(word, '[.!?]$') OR regexp_matches(raw, '[^\x20\x09-\x0D][\x20\x09-\x0D]*\n')
        OR (7 * strlen(word) + CAST('0x' || right(hex(word), 2) AS INT)) % 32 = 0 AS ends FROM y),
r AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM z),
i AS (SELECT *, (row_number() OVER (PARTITION BY rid, run ORDER BY k) - 1) % 16 = 0 AS begins FROM r),
s AS (SELECT *, CAST(sum(CAST(begins AS INT)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS pos FROM i),
p AS (SELECT rid, doc_id, pos, min(k) AS a, max(k) AS b, string_agg(raw, '' ORDER BY k) AS raw FROM s GROUP BY rid, doc_id, pos),
l AS (SELECT rid, list(word ORDER BY k) AS words FROM y GROUP BY rid),
n AS (SELECT p.*, max(pos) OVER (PARTITION BY rid) AS top, max(b) OVER (PARTITION BY rid) AS tail FROM p),
e AS (SELECT n.rid, n.doc_id, n.pos, n.a, greatest(q.pos, n.pos + 1) AS till FROM n ASOF JOIN p q ON n.rid = q.rid AND n.a + 23 <= q.b WHERE greatest(q.pos, n.pos + 1) <= n.top
      UNION SELECT rid, doc_id, max(pos), max(a), max(top) FROM n WHERE tail - a >= 23 AND pos < top GROUP BY rid, doc_id),
h AS (SELECT e.*, md5(array_to_string(l.words[e.a:t.b], ' ')) AS span FROM e JOIN l ON l.rid = e.rid JOIN p t ON t.rid = e.rid AND t.pos = e.till),
f AS (SELECT rid, pos, till, row_number() OVER (PARTITION BY span ORDER BY doc_id NULLS FIRST, rid, pos, till) AS rk FROM h),
c AS (SELECT DISTINCT rid, unnest(range(pos, till + 1)) AS pos FROM f WHERE rk > 1),
g AS (SELECT p.rid, count(*) AS n_sentences, count(c.pos) AS n_removed, string_agg(CASE WHEN c.pos IS NULL THEN raw ELSE '' END, '' ORDER BY p.pos) AS kept,
        sum(CASE WHEN c.pos IS NOT NULL AND o.pos IS NULL THEN 1 ELSE 0 END) AS n_spans
      FROM p LEFT JOIN c ON c.rid = p.rid AND c.pos = p.pos LEFT JOIN c o ON o.rid = p.rid AND o.pos = p.pos - 1 GROUP BY p.rid)
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, text)) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
