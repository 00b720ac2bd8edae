"""Prefix trie of conversations: radix partitioning by turns until buckets are local, multikey quicksort within them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, maybe_broadcast

#: Different conversations and turns of a bucket that one task finishes.
LOCAL, LOCAL_TURNS = 2048, 1 << 16
#: Bits of conversation ids whose numbers stand in one row when a node's conversations are listed: 4,096 ids.
LISTED = 12
NONE = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_arrays(df: DataFrame, keep: Written) -> DataFrame:
    """(conv_id, ids, sizes) of each conversation: its turns in order by their numbers in a dictionary of the distinct
    (role, text), and code points of their texts. Texts are read once and go no further than their digests."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).alias("size"))
    turns = keep.put(turns, "turns")
    book = keep.put(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")  # numbers are given once
    coded = turns.join(book, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "size"))).alias("t"))
    return keep.put(coded.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")), "conversations")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations with the first h turns of conversation c - c % 100 in place of their own first h; h = crc32(c) % 6."""
    heads = conversations.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head"), F.slice("sizes", 1, 5).alias("head_sizes"))
    c = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    both = lambda head, own, kind: F.concat(F.slice(F.coalesce(head, F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.size(own)))
    return c.join(maybe_broadcast(heads), "base", "left").select("conv_id", both("head", "ids", "array<long>").alias("ids"), both("head_sizes", "sizes", "array<int>").alias("sizes"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """(ids, sizes, n, conv_id, ends): each sequence of turns once, with its number of conversations, the smallest of them
    and the digest of all. Copies are counted before they are shuffled; their ids come to the task that makes the digest
    in rows of up to 2^LISTED ids, in order, and are never held together."""
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    blocks = conversations.groupBy(key.alias("key"), F.shiftright("conv_id", LISTED).alias("block")).agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("listed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, listed = None, None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held.column(2), held.column(3), pa.array([n]), held.column(5), pa.array([listed.hexdigest()])], ["ids", "sizes", "n", "conv_id", "ends"])

        for batch in batches:
            for row, (now, more, some) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 4, 6)), strict=True)):
                if now != key:
                    if key is not None:
                        yield out()
                    key, held, n, listed = now, batch.slice(row, 1), 0, hashlib.sha256()
                else:
                    listed.update(b",")
                n += more
                listed.update(some.encode())
        if key is not None:
            yield out()

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "ids array<long>, sizes array<int>, n long, conv_id long, ends string")


# ---------------------------------------------------------------- within a bucket


class Sequences:
    """Different sequences of turns of one bucket, which agree in their first `depth` turns."""

    def __init__(self, ids: list[np.ndarray], sizes: list[np.ndarray], n: list[int], conv: list[int], ends: list[str]):
        self.ids, self.sizes, self.n, self.conv, self.ends = ids, sizes, n, conv, ends

    def nodes(self, depth: int, parent: int | None) -> list[tuple]:
        """Nodes of _NODE from depth on: a bucket's own node, then, by multikey quicksort of the turns behind it, those of
        its children. A stack stands for the recursion, so sequences may be of any length."""
        out, up = [], []  # up: place in out of the parent of each node
        todo = [(np.arange(len(self.ids)), depth, parent, -1, True)]
        while todo:
            rows, d, above, at, top = todo.pop()
            if top:
                here = len(out)
                conv, n = min(self.conv[r] for r in rows), sum(self.n[r] for r in rows)
                last = next(r for r in rows)
                ended = [r for r in rows if len(self.ids[r]) == d]  # one at most, as sequences differ
                saved = (n - 1) * int(self.sizes[last][d - 1]) if d else 0
                out.append([conv, d, above, n, 0, 0, saved, self.ends[ended[0]] if ended else NONE])
                up.append(at)
                if at >= 0:
                    out[at][4] += 1
                rows = [r for r in rows if len(self.ids[r]) > d]
                if rows:
                    todo.append((rows, d, conv, here, False))
                continue
            # Three parts by the turn at d: the middle one is a child, the others are sorted on at the same depth.
            turns = [self.ids[r][d] for r in rows]
            a, b, c = turns[0], turns[len(turns) // 2], turns[-1]
            pivot = sorted((a, b, c))[1]
            less, same, more = [], [], []
            for r, t in zip(rows, turns, strict=True):
                (less if t < pivot else same if t == pivot else more).append(r)
            todo += [(part, d, above, at, False) for part in (more, less) if part]
            todo.append((same, d + 1, above, at, True))
        for i in range(len(out) - 1, -1, -1):  # children stand behind their parents
            if out[i][4] == 0:
                out[i][5] = 1
            if up[i] >= 0:
                out[up[i]][5] += out[i][5]
                out[up[i]][6] += out[i][6]
        return [tuple(r) for r in out]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of runs of rows with the same bucket (above: the node that it hangs from, turn); the bucket's own node comes
    first and carries `above`, the others have none."""
    bucket, held = None, []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_pydict()
        arrays = [[np.array(x) for x in t[c]] for c in ("ids", "sizes")]
        above, depth, parent = (t[c][0] for c in ("above", "depth", "parent"))
        rows = Sequences(*arrays, t["n"], t["conv_id"], t["ends"]).nodes(depth, parent)
        kinds = [pa.int64()] * 7 + [pa.string()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([above] + [None] * (len(rows) - 1), pa.int64()), *cols], ["above", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                continue
            if keys[a] != bucket and held:
                yield out()
                held = []
            bucket = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


# ---------------------------------------------------------------- across the cluster


def _is_local(local: int, local_turns: int) -> Column:
    return (F.col("classes") == 1) | ((F.col("classes") <= local) & (F.col("turns") <= local_turns))


def trie(sequences: DataFrame, keep: Written, local: int = LOCAL, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """(_NODE) of the nodes of all prefixes of the sequences (ids, sizes, n, conv_id, ends; no two alike).

    A bucket holds the sequences of a node. A round takes all buckets that are too large for a task: what the smallest and
    the largest sequence of a bucket share is shared by all, so the nodes on that way are told from the two alone, and the
    bucket is split by the turn behind it. Buckets that are small then are put aside, the others go on; so there are as
    many rounds as large nodes with several children stand above each other. One sequence is local at any length.
    """
    spark = sequences.sparkSession
    work = keep.put(sequences.select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<long>").alias("path"), "ids", "sizes", "n", "conv_id", "ends"), "work0")
    small_parts, large_parts, turn = [], [], 0
    total = work.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("turns"))
    if total.filter(_is_local(local, local_turns)).count():
        small_parts.append(work.select(F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("turn"), "depth", "parent", "path", "ids", "sizes", "n", "conv_id", "ends"))
    else:
        while not work.isEmpty():
            # Of each large bucket: what its members share, and its nodes' sums. As many rows as large buckets.
            ends = F.struct("ids", "sizes", "ends")
            of = work.groupBy("bucket").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("path").alias("path"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min(ends).alias("low"), F.max("ids").alias("high"))
            differs = F.filter(F.sequence(F.lit(1), F.size("low.ids")), lambda i: (i > F.size("high")) | (F.get("low.ids", i - 1) != F.get("high", i - 1)))
            shared = F.when(F.size("low.ids") == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, F.size("low.ids")))
            of = of.withColumn("shared", shared)
            of = of.select("bucket", "depth", "parent", "path", "n", "conv_id", "shared", F.slice("low.sizes", F.lit(1), F.col("shared")).alias("sizes"), F.when(F.size("low.ids") == F.col("shared"), F.col("low.ends")).alias("ends"))
            of = keep.put(of, f"large{turn}")
            large_parts.append(of)
            sides = of.select("bucket", "shared", F.col("conv_id").alias("of_conv"), F.array_append("path", F.col("bucket")).alias("of_path"))
            split = work.join(maybe_broadcast(sides), "bucket").filter(F.size("ids") > F.col("shared")).withColumn("turn", F.get("ids", F.col("shared")))
            counts = split.groupBy("bucket", "turn").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.size("ids") - F.col("shared")).alias("turns"))
            again = counts.filter(~_is_local(local, local_turns)).select("bucket", "turn", (F.monotonically_increasing_id() + F.lit((turn + 1) << 50)).alias("next"))
            again = keep.put(again, f"again{turn}")
            split = split.join(maybe_broadcast(again), ["bucket", "turn"], "left")
            at = (F.col("shared") + 1).alias("depth"), F.col("of_conv").alias("parent"), F.col("of_path").alias("path"), "ids", "sizes", "n", "conv_id", "ends"
            dealt = keep.put(split.select("next", F.col("bucket").alias("above"), "turn", *at), f"dealt{turn}")
            small_parts.append(dealt.filter("next IS NULL").drop("next"))
            work = dealt.filter("next IS NOT NULL").select(F.col("next").alias("bucket"), "depth", "parent", "path", "ids", "sizes", "n", "conv_id", "ends")
            turn += 1
    rest = small_parts[0]
    for part in small_parts[1:]:
        rest = rest.unionByName(part)
    done = rest.drop("path").repartition("above", "turn").sortWithinPartitions("above", "turn").mapInArrow(_finish, "above long, " + _NODE)
    if not large_parts:
        return done.drop("above")
    done = keep.put(done, "nodes")
    large = large_parts[0]
    for part in large_parts[1:]:
        large = large.unionByName(part)
    # Sums over subtrees: of small buckets by their first nodes, of large ones by the nodes on their shared way.
    saved_at = lambda d: F.when(d > 0, (F.col("n") - 1) * F.get("sizes", d - 1)).otherwise(F.lit(0)).cast("long")
    way = F.aggregate(F.sequence("depth", "shared"), F.lit(0).cast("long"), lambda s, d: s + saved_at(d))
    tops = done.filter("above IS NOT NULL").groupBy("above").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"))
    paths = large.select("bucket", F.array_append("path", F.col("bucket")).alias("path"))
    below = tops.join(maybe_broadcast(paths), tops.above == paths.bucket).select(F.explode("path").alias("bucket"), "leaves", "saved")
    inner = large.filter(F.size("path") > 0).select(F.explode("path").alias("bucket"), F.lit(0).cast("long").alias("leaves"), way.alias("saved"))
    sums = below.unionByName(inner).groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    children = tops.select(F.col("above").alias("bucket"), "children").unionByName(large.filter(F.size("path") > 0).select(F.element_at("path", -1).alias("bucket"), F.lit(1).cast("long").alias("children"))).groupBy("bucket").agg(F.sum("children").alias("children"))
    whole = large.join(sums, "bucket").join(children, "bucket").withColumn("d", F.explode(F.sequence("depth", "shared")))
    saved = F.aggregate(F.sequence("d", "shared"), F.col("saved"), lambda s, d: s + saved_at(d))
    last = F.col("d") == F.col("shared")
    nodes = whole.select(
        "conv_id",
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") > F.col("depth"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"),
    )
    return done.drop("above").unionByName(nodes)


def prefix_trie(df: DataFrame, rebuild: bool = True, local: int = LOCAL, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """A row for each node of the trie of conversations' turns (conv_id, turn, role, text): _NODE.

    rebuild: whether conversations get their first turns from conversation c - c % 100 (see rebuilt). Turns are numbered
    in a dictionary by the sha256 of role and text, ordered by turn (null first) and by that digest where turns are equal;
    repeated rows are turns of their own. Null role or text is empty. Rows without a conversation id take no part; other
    columns are not read; no conversations have no nodes, not even a root. A conversation is a row of its turns' numbers.
    """
    keep = Written(df.sparkSession, "trie")
    conversations = turn_arrays(df, keep)
    sequences = distinct_sequences(rebuilt(conversations) if rebuild else conversations)
    return trie(sequences, keep, local, local_turns)


def op11(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT role, text, row_number() OVER () AS id, length(text) AS size FROM (SELECT DISTINCT role, text FROM turns)),
coded AS (SELECT conv_id, i, id FROM turns JOIN ids USING (role, text)),
heads AS (
    SELECT conv_id, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS crc
    FROM (SELECT DISTINCT conv_id FROM turns)),
h AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 6 AS h FROM heads),
rebuilt AS (
    SELECT h.conv_id, coded.i, coded.id FROM h JOIN coded ON coded.conv_id = h.conv_id AND coded.i > h
    UNION ALL SELECT h.conv_id, coded.i, coded.id FROM h JOIN coded ON coded.conv_id = h.conv_id - h.conv_id % 100 AND coded.i <= h),
whole AS (
    SELECT h.conv_id, coalesce(list(id ORDER BY i) FILTER (id IS NOT NULL), []) AS s FROM h LEFT JOIN rebuilt USING (conv_id) GROUP BY h.conv_id),
members AS (SELECT conv_id, s[1:d] AS p, d, len(s) = d AS ends FROM whole, unnest(range(0, len(s) + 1)) AS g(d)),
nodes AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY p, d),
counted AS (
    SELECT n.*, u.conv_id AS parent_conv_id, coalesce(c.k, 0) AS k, coalesce((n.n - 1) * ids.size, 0) AS own
    FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
    LEFT JOIN (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1) c ON c.p = n.p
    LEFT JOIN ids ON ids.id = n.p[n.d]),
sums AS (SELECT p[1:e] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM counted, unnest(range(0, d + 1)) AS g(e) GROUP BY 1)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n AS n_convs, k AS n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (p)"""
