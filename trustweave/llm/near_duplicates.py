"""Near-duplicates by bottom-k sketches: inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, aside, back, filter_bits, filter_place, mix, passes, prefix_hash, span_hash
from .components import components

#: Words of a shingle and percent of the union that a link takes, unless a contract says otherwise.
SHINGLE, PERCENT = 5, 80
#: Values a sketch retains, how many of the lowest make inverted lists, and the part of those that a linked pair
#: shares but for a chance of about 5e-8; standard errors that an estimate may lie below the bound.
RETAINED, LISTED, SHARED, SLACK = 192, 32, 0.375, 4.5
#: Most members of a family that meet in one block.
BLOCK = 1024
_FIRST, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once, rows whose sets are held at once.
SLAB, PART = 1 << 20, 256


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: words between ASCII white space, A-Z lower-cased; a
    text with fewer words than a shingle is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # about SLAB bytes at once
        first, total = at, 0
        while at < len(texts) and (at == first or total < SLAB):
            total += len(texts[at]) + 1
            at += 1
        data = _LOWER[np.frombuffer(b" ".join(texts[first:at]) + b" ", np.uint8)]
        ends_at = np.cumsum([len(t) + 1 for t in texts[first:at]])
        space = _SPACES[data]
        before = np.concatenate(([True], space[:-1]))
        start, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        words = span_hash(prefix_hash(data), start, end)
        share = np.searchsorted(start, ends_at)  # words up to each text's end
        if len(words) >= size:
            runs = np.zeros(len(words) - size + 1, np.uint64)
            for i in range(size):
                runs = mix(runs * _NEXT + words[i : len(words) - size + 1 + i] + _FIRST)
        lo = 0
        for hi in share.tolist():
            if hi == lo:
                out.append(np.zeros(0, np.uint64))
            elif hi - lo < size:
                one = np.uint64(0)
                for w in words[lo:hi]:
                    one = mix(np.array([one], np.uint64) * _NEXT + w + _FIRST)[0]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.unique(runs[lo : hi - size + 1]))
            lo = hi
    return out


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = mix(values * _FIRST + _NEXT).sum(dtype=np.uint64) + np.uint64(len(values))
        b = mix(values ^ _NEXT).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def bottom(values: np.ndarray, k: int = RETAINED) -> np.ndarray:
    """The k smallest distinct values, 32 bits each, of the one hash function; as signed numbers in the same order."""
    top = np.unique((values[: 2 * k] >> np.uint64(32)).astype(np.uint32))[:k]
    return (top ^ np.uint32(1 << 31)).view(np.int32)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches (rows, filled up with the largest number) from the bottom k of their union,
    and the standard error at 0.8. Sets that fit into their sketches give the similarity itself."""
    k = a.shape[1]
    fill = np.iinfo(np.int32).max
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    new &= both != fill
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != fill)
    whole = (na <= k) & (nb <= k)
    cut = np.where(whole, 2 * k, k)[:, None]
    place = np.cumsum(new, axis=1)
    inside = place <= cut
    of = np.minimum(place[:, -1], cut[:, 0])
    union = (na + nb) / 1.8
    error = np.where(whole, 0.0, np.sqrt(0.16 / k * np.maximum(0.02, 1 - k / np.maximum(union, k))))
    return (twice & inside).sum(1) / np.maximum(of, 1), error


def likely(a, b, na, nb, percent: float = PERCENT) -> np.ndarray:
    sizes = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    out = sizes.copy()
    at = np.flatnonzero(sizes)
    for i in range(0, len(at), 4096):
        p = at[i : i + 4096]
        e, error = estimates(a[p], b[p], na[p], nb[p])
        out[p] = e + SLACK * error + 1e-6 >= percent / 100
    return out


def _matrix(column: pa.Array, k: int, kind=np.int32, fill: int = np.iinfo(np.int32).max) -> np.ndarray:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    n = np.diff(off)
    out = np.full((len(column), k), fill, kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                sets = shingle_sets([b"" if x is None else x for x in part.column(1).cast(pa.large_binary()).to_pylist()], size)
                d = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([bottom(s) for s in sets], pa.list_(pa.int32()))],
                    ["doc_id", "digest", "n", "d1", "d2", "sketch"],
                )

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: float = PERCENT, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest, first) for each row of docs.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id that links lead to, kept is whether that is the document's own. Links are confirmed on the full sets.
    digest: a hash of the text; first: whether no row of the group has a smaller (doc_id, digest), null ids last.

    Documents with the same set make a class, and only classes are compared. The lowest values of a sketch make
    inverted lists; of a document's lists its rarest count, so many that a linked pair has one in common. The lists of
    one first member (by a hash) make a family, which meets in blocks with its lists' values: pairs that share fewer of
    them than a linked pair go. A block with many pairs left at first gives each member's with the most similar one and
    with the first member; what of them passes the sketches' estimate and is confirmed joins nearly all that belongs
    together. Then such blocks, if they hold several components yet, meet with whole sketches and give all pairs across
    them that pass, so no link between components is left out, and a family of many copies costs rows in proportion to
    its copies.

    Null or empty text, or no words: n_shingles 0, linked with nothing. Rows of one doc_id count as rows of their own
    and share their component_id where their sets are linked. Null doc_id: never a component_id unless all of the group
    are null; then component_id is null and kept true. Other columns are not read. No rows give no rows. doc_id must be
    a whole number or cast to one. A percent below PERCENT is refused: the lists' and the estimate's bounds are made for
    that one, and would lose links of less similar documents.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100")
    spark = docs.sparkSession
    keep = Written(spark, "near")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = given.withColumn("digest", F.xxhash64("text"))
    sketched = keep.put(named.mapInArrow(_sketch_rows(size), "doc_id long, digest long, n long, d1 long, d2 long, sketch array<int>"), "sketched")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    merged = sketched.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.min(place).alias("place"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    classes = keep.put(merged.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = keep.put(sketched.select("doc_id", "digest", "n", "d1", "d2"), "rows")
    keep.drop("sketched")
    some = rows.filter("n > 0")

    # Inverted lists of the values that more than one class has; a class's rarest.
    listed = classes.select("cid", "n", F.expr(f"slice(sketch, 1, {LISTED})").alias("low"))
    values = listed.select("cid", "n", F.size("low").alias("of"), F.explode("low").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    mine = values.join(often, "v").groupBy("cid", "n", "of").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("found"))
    left = F.expr(f"greatest(0, CAST(of - ceil({SHARED} * of) + 1 AS int) - (of - size(found)))")
    rarest = F.explode(F.expr("slice(found, 1, left)"))
    mine = mine.withColumn("left", left).filter("left > 0")
    # Sizes in steps, at least as far apart as those of linked sets may be: a link leads to the same or the next step.
    step = F.least(F.lit(60), F.floor(F.log("n") / max(0.2, 1.001 * log(100 / percent)))).cast("int")
    entries = keep.put(mine.select("cid", step.alias("step"), rarest.alias("e")).select("cid", "step", F.col("e.v").alias("v")), "entries")
    steps = entries.groupBy("v", "step").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("first"), F.count(F.lit(1)).alias("c"))
    own = F.expr("shiftleft(1L, step)")
    firsts = steps.groupBy("v").agg(F.min("first").alias("first"), F.bit_or(own).alias("there"), F.bit_or(F.when(F.col("c") > 1, own).otherwise(0)).alias("twice"))
    firsts = firsts.filter("twice <> 0 OR bit_count(there) > 1").select("v", F.col("first.cid").alias("family"), "there", "twice")
    # A class stays in a list only if the list has another whose size allows a link.
    partner = F.expr("(twice & shiftleft(1L, step)) <> 0 OR (there & (shiftleft(1L, step + 1) | shiftright(shiftleft(1L, step), 1))) <> 0")
    family = keep.put(entries.join(firsts, "v").filter(partner).select("family", "cid").distinct(), "family")
    keep.drop("entries")

    sketches = classes.select("cid", "n", "sketch")

    def blocks(members: DataFrame, several: Column, *more: str) -> DataFrame:
        """members (family, cid, more) of the families for which `several` holds; a large family's parts meet in pairs."""
        size_ = members.groupBy("family").agg(several.alias("several"), F.count(F.lit(1)).alias("members")).filter("several").select("family", "members")
        parts = F.ceil(F.col("members") / block).cast("int")
        rows_ = members.join(size_, "family").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return rows_.withColumn("other", other).select("family", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cid", *more)

    def gathered(members: DataFrame) -> DataFrame:
        return members.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "cid")

    # First each member with those that are most like it by their lists, which joins nearly all that belongs together.
    light = gathered(blocks(family, F.count(F.lit(1)) > 1).join(listed, "cid").select("family", "p", "q", "part", "cid", "n", "low"))
    met = keep.put(light.mapInArrow(_meet_lists(percent), "whole boolean, a long, b long").distinct(), "met")
    close = met.filter("whole").select("a", "b")
    side = lambda x: sketches.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    links = _confirmed(given, classes, keep.put(both.mapInArrow(_passing(percent), "a long, b long"), "close"), keep, size, percent, "1")
    reached = keep.put(components(links, keep, "first"), "reached")
    # Then, where a block had more pairs than it gave and holds several components yet, all pairs across them.
    held = met.filter("NOT whole").select(F.col("a").alias("family"), F.col("b").alias("cid"))
    marked = held.join(reached, F.col("cid") == F.col("node"), "left").select("family", "cid", F.coalesce("root", "cid").alias("root"))
    # The smallest family that two members have in common is the one that gives their pair.
    families = held.groupBy("cid").agg(F.sort_array(F.collect_set("family")).alias("families"))
    full = blocks(marked, F.min("root") < F.max("root"), "root").join(sketches, "cid").join(families, "cid")
    full = gathered(full.select("family", "p", "q", "part", "cid", "root", "n", "sketch", "families"))
    across = full.mapInArrow(_meet(percent), "a long, b long").distinct()
    again = _confirmed(given, classes, keep.put(across, "across"), keep, size, percent, "2")
    every = keep.put(components(links.unionByName(again), keep, "all"), "every")

    of = classes.select("cid", "d1", "d2", "doc", "place").join(every, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = of.groupBy("root").agg(F.min("doc").alias("component_id"), F.min("place").alias("lowest"))
    of = of.join(lowest, "root").select("d1", "d2", "component_id", "lowest")
    linked = some.join(of, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "digest", (place == F.col("lowest")).alias("first"))
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "digest", F.lit(True).alias("first"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "digest", "first")


def _shared(rows: np.ndarray, cols: np.ndarray, sk: np.ndarray) -> np.ndarray:
    """How many values each of rows has in common with each of cols (sk: values, filled up with the largest number)."""
    fill = np.iinfo(np.int32).max
    if len(rows) * len(cols) <= 256:
        return ((sk[rows][:, None, :, None] == sk[cols][None, :, None, :]) & (sk[rows] != fill)[:, None, :, None]).sum((2, 3))
    # A product of 0/1 tables, some values at a time.
    value, at = np.unique(sk, return_inverse=True)
    at = at.reshape(sk.shape)
    many = np.bincount(at.ravel(), minlength=len(value)) > 1
    many[value == fill] = False
    place = np.cumsum(many) - 1
    member, column = np.nonzero(many[at])
    spot = place[at[member, column]]
    order = np.argsort(spot, kind="stable")
    member, spot = member[order], spot[order]
    shared = np.zeros((len(rows), len(cols)), np.float32)
    step = 1024
    for lo in range(0, int(many.sum()), step):
        x, y = np.searchsorted(spot, (lo, lo + step))
        t = np.zeros((len(sk), step), np.float32)
        t[member[x:y], spot[x:y] - lo] = 1
        shared += t[rows] @ t[cols].T
    return shared


def _blocks(batches: Iterator[pa.RecordBatch], take) -> Iterator[tuple]:
    """(family, p, q) and the columns, as take makes arrays of them, of each block; blocks come one after another."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        rest = take(batch)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
            if tuple(keys[a]) != key:
                if held:
                    yield key, [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held, strict=True)]
                key, held = tuple(keys[a]), []
            held.append([x[a:b] for x in rest])
    if held:
        yield key, [np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held, strict=True)]


def _numbers(batch: pa.RecordBatch, lo: int, hi: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(lo, hi)]


def _meet_lists(percent: float):
    """Pairs (whole, a, b) within a block that share enough of their lowest values. Where there are over four a member,
    only each member's with the most similar other and with the family's first, and rows (not whole, family, member) for
    all that have a pair."""
    fill = np.iinfo(np.int32).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (family, p, q), (part, cid, n, low) in _blocks(batches, lambda b: [*_numbers(b, 3, 6), _matrix(b.column(6), LISTED)]):
            rows, cols = np.flatnonzero(part == p), np.flatnonzero(part == q)
            if not len(rows) or not len(cols):
                continue
            shared = _shared(rows, cols, low)
            least = np.ceil(SHARED * (low != fill).sum(1))
            need = np.maximum(least[rows][:, None], least[cols][None])
            i, j = np.nonzero(shared + 0.5 >= need)
            near = (shared / need)[i, j]
            i, j = rows[i], cols[j]
            ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            if p == q:
                ok &= i < j
            i, j, near = i[ok], j[ok], near[ok]
            if not len(i):
                continue
            some = np.zeros(0, np.int64)
            if len(i) > 4 * len(cid):
                some = cid[np.unique(np.concatenate([i, j]))]
                best = np.zeros(len(i), bool)
                for a in (i, j):
                    order = np.lexsort((-near, a))
                    best[order[np.concatenate(([True], a[order][1:] != a[order][:-1]))]] = True
                best |= (cid[i] == family) | (cid[j] == family)
                i, j = i[best], j[best]
            i, j = cid[i], cid[j]
            whole = np.arange(len(i) + len(some)) < len(i)
            a = np.concatenate([np.minimum(i, j), np.full(len(some), family, np.int64)])
            b = np.concatenate([np.maximum(i, j), some])
            yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(a), pa.array(b)], ["whole", "a", "b"])

    return run


def _passing(percent: float):
    """Pairs (a, b) of rows (a, b, sizes, sketches) whose estimate passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = _numbers(batch, 0, 4)
            ok = likely(_matrix(batch.column(4), RETAINED), _matrix(batch.column(5), RETAINED), na, nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return run


def _meet(percent: float):
    """Pairs of different components within a block whose sketches pass, each in one family only."""

    def pairs(family: int, p: int, q: int, part, cid, root, n, sk, families):
        rows, cols = np.flatnonzero(part == p), np.flatnonzero(part == q)
        if not len(rows) or not len(cols):
            return None
        union = (n[rows][:, None] + n[cols][None]) / 1.8
        whole = (n[rows] <= RETAINED)[:, None] & (n[cols] <= RETAINED)[None]
        error = np.where(whole, 0.0, SLACK * np.sqrt(0.16 / RETAINED * np.maximum(0.02, 1 - RETAINED / np.maximum(union, RETAINED))))
        need = np.maximum(1, (percent / 100 - error) * np.where(whole, np.floor(union), np.minimum(RETAINED, np.floor(union))) - 1)
        i, j = np.nonzero((_shared(rows, cols, sk) + 0.5 >= need) & (root[rows][:, None] != root[cols][None]))
        i, j = rows[i], cols[j]
        if p == q:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return None
        ok = np.concatenate([likely(sk[i[c : c + 8192]], sk[j[c : c + 8192]], n[i[c : c + 8192]], n[j[c : c + 8192]], percent) for c in range(0, len(i), 8192)])
        i, j = i[ok], j[ok]
        lowest = np.empty(len(i), np.int64)
        for c in range(0, len(i), 4096):
            x, y = families[i[c : c + 4096]], families[j[c : c + 4096]]
            both = (x[:, :, None] == y[:, None, :]).any(2) & (x != -1)
            lowest[c : c + 4096] = np.where(both, x, np.iinfo(np.int64).max).min(1)
        i, j = cid[i[lowest == family]], cid[j[lowest == family]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, columns in _blocks(batches, lambda b: [*_numbers(b, 3, 7), _matrix(b.column(7), RETAINED), _matrix(b.column(8), LISTED, np.int64, -1)]):
            if (found := pairs(*key, *columns)) is not None:
                yield found

    return run


def _confirmed(given: DataFrame, classes: DataFrame, pairs: DataFrame, keep: Written, size: int, percent: float, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have the similarity. The sets are made again from the texts of the
    classes' first documents, which a filter of a fixed number of bits lets pass (and some more, which a join drops)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    needed = keep.put(classes.select("cid", "d1", "d2", "doc").join(ids, "cid", "left_semi"), f"needed-{name}")
    shared = given.sparkSession.sparkContext.broadcast(filter_bits(needed.select(filter_place("doc"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(passes(shared.value, batch.column(2)))
            for at in range(0, wanted.num_rows, PART):
                part = wanted.slice(at, PART)
                sets = shingle_sets([b"" if x is None else x for x in part.column(1).cast(pa.large_binary()).to_pylist()], size)
                d = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc", "d1", "d2", "set"])

    sets = given.select(F.col("doc_id").alias("doc"), "text", filter_place("doc_id")).mapInArrow(read, "doc long, d1 long, d2 long, set array<long>")
    sets = sets.join(needed, (sets["d1"] == needed["d1"]) & (sets["d2"] == needed["d2"]) & sets["doc"].eqNullSafe(needed["doc"])).select("cid", "set")
    sets = keep.put(sets.groupBy("cid").agg(F.any_value("set").alias("set")), f"sets-{name}")

    side = lambda x: sets.select(F.col("cid").alias(x), F.col("set").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("same"), (F.size("sa") + F.size("sb")).alias("sizes"))
    links = keep.put(both.filter(100 * F.col("same") >= F.lit(percent) * (F.col("sizes") - F.col("same"))).select("a", "b"), f"links-{name}")
    keep.drop(f"sets-{name}")
    return links


def kept_documents(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The first row of docs of each group that near_duplicates found in it, with all its columns and no other.

    Rows without words are groups of their own; of rows that repeat doc_id and text, one stays, null ids too.
    """
    at = lambda i, h: {"id": F.coalesce(i, F.lit(0)), "none": i.isNull(), "hash": h}
    key = ["id", "none", "hash"]
    first = found.filter("first").select(*(c.alias(n) for n, c in at(F.col("doc_id"), F.col("digest")).items())).distinct()
    rows, names = aside(docs)
    rows = rows.withColumns(at(F.col(names["doc_id"]).cast("long"), F.xxhash64(names[text]))).join(first, key, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return back(rows.withColumn("nth", nth).filter("nth = 1"), names, [])


def op7(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2).drop("digest", "first")


#: The same classes; pairs share one of each set's rarest shingles, links are counted in full and followed to the end.
OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s
  FROM split),
classes AS (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT c, n, unnest(s) AS x FROM classes),
often AS (SELECT x, count(*) AS f FROM items GROUP BY x),
placed AS (SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY f, x) AS place FROM items JOIN often USING (x)),
rare AS (SELECT c, n, x FROM placed WHERE 5 * (place - 1) <= n),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM rare a JOIN rare b ON a.x = b.x AND a.c < b.c AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n),
both_sets AS (SELECT a, b, p.n + q.n AS total, len(list_intersect(p.s, q.s)) AS i FROM pairs JOIN classes p ON p.c = a JOIN classes q ON q.c = b),
links AS (SELECT a, b FROM both_sets WHERE 100 * i >= 80 * (total - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
least AS (SELECT reach.a AS c, min(k.least) AS component FROM reach JOIN classes k ON k.c = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN least ON least.c = classes.c
"""
