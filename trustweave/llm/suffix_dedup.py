"""Exact repeats of a fixed length by a collection's Burrows-Wheeler transform, built column by column.

Building the transform of a whole corpus takes as many passes as its longest document has symbols. So only what can
repeat is built: of every 200-byte string the smallest hash of its 50-byte strings is its anchor, equal strings have
equal anchors, and strings whose anchor stands nowhere else are unique. Neighbouring strings with one anchor make a
row; rows are dealt out by anchor and the transform names what repeats in them. Of a content that many rows have, two
go in; what is named there holds for the others of the same 128 bits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, Written, filter_bits, filter_place, passes, prefix_hash, span_hash

#: Bytes of a string, of an anchor, most strings of a row, bytes hashed at once.
LENGTH, GRAM, MOST, SLAB = 200, 50, 256, 1 << 20
#: Bytes of a symbol; a string is a whole number of them.
SYMBOL = 40
#: Rows that one collection has, and rows of an anchor beyond which its strings are dealt out one by one.
COLLECTION, HOT = 2000, 50_000
#: Very common anchors that a list names; more of them are told by a join.
MOST_HOT = 1000
_PIECE = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("many", pa.bool_()), ("first", pa.bool_()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("bytes", pa.binary())])
_NAMED = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, lo, n, twice) of each row: the strings that start at lo .. lo+n-1 of that text have that anchor;
    digest names the row's bytes lo .. lo+n+length-2; twice: the anchor stands in the row more than once."""
    window = length - gram + 1
    parts = []
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    at = 0
    while at < len(long):
        first, size = at, 0
        while at < len(long) and (at == first or size < SLAB):
            size += len(texts[long[at]])
            at += 1
        which = np.array(long[first:at])
        data = np.frombuffer(b"".join(texts[i] for i in long[first:at]), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in long[first:at]])
        begins = ends - np.array([len(texts[i]) for i in long[first:at]])
        prefix = prefix_hash(data)
        p = np.arange(len(data) - gram + 1)
        grams = span_hash(prefix, p, p + gram)
        least, have = grams, 1
        while have * 2 <= window:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if window > have:
            least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
        inside = np.zeros(len(least) + 1, np.int8)
        inside[begins] = 1
        stop = ends - length + 1
        inside[stop[stop <= len(least)]] -= 1
        inside = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        new[begins] = True
        lo = np.flatnonzero(new)
        text = np.searchsorted(ends, lo, side="right")
        hi = np.minimum(np.append(lo[1:], len(least) + 1), stop[text])
        value = least[lo]
        twice = hi - lo > window
        for a in range(0, len(lo), 4096):
            b = slice(a, a + 4096)
            i = np.arange(window)
            here = grams[lo[b, None] + i] == value[b, None]
            there = grams[hi[b, None] - 1 + i] == value[b, None]
            twice[b] |= (lo[b] + here.argmax(1)) != (hi[b] - 1 + window - 1 - there[:, ::-1].argmax(1))
        many = -(-(hi - lo) // most)
        if many.max(initial=1) > 1:
            again = np.repeat(np.arange(len(lo)), many)
            step = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            lo, hi = lo[again] + step * most, hi[again]
            hi = np.minimum(hi, lo + most)
            text, value, twice = text[again], value[again], twice[again]
        digest = span_hash(prefix, lo, hi + length - 1)
        parts.append((which[text], value.view(np.int64), digest.view(np.int64), lo - begins[text], hi - lo, twice))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class External:
    """Arrays in files of their own below a folder that the cluster shares, each written and read from end to end."""

    def __init__(self, folder: str):
        self.fs, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        self.at = f"{base}/collection-{uuid.uuid4().hex}"
        self.fs.create_dir(self.at)

    def __setitem__(self, name: str, values: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.at}/{name}") as f:
            f.write(np.ascontiguousarray(values))

    def read(self, name: str, kind) -> np.ndarray:
        with self.fs.open_input_stream(f"{self.at}/{name}") as f:
            return np.frombuffer(f.read(), kind)

    def close(self) -> None:
        self.fs.delete_dir(self.at)


def _numbered(x: np.ndarray, bits: int) -> np.ndarray:
    """A number below len(x) for each value of x, the same for equal ones; values have so many bits. Values go to the sort
    with their places in the bits behind, where both fit: plain numbers sort much faster than places by numbers."""
    own = len(x).bit_length()
    if bits + own > 63:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)
    both = np.sort(x << own | np.arange(len(x)))
    key, out = both >> own, np.zeros(len(x), np.int64)
    out[both[1:] & ((1 << own) - 1)] = np.cumsum(key[1:] != key[:-1])
    return out


def symbols(data: bytes, width: int) -> np.ndarray:
    """A number for the `width` bytes at each place of data, filled up with zeros: equal bytes have equal numbers. Made
    of numbers of 4 (or fewer) bytes by numbering pairs, so that no two symbols are taken for one."""
    unit = min(width, 4)
    assert width % unit == 0 and unit in (1, 2, 4)
    filled = np.frombuffer(data + b"\0" * width, np.uint8)
    part = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(filled, unit)).view(f"<u{unit}").ravel().astype(np.int64)
    part = _numbered(part, 8 * unit)
    own = len(part).bit_length()
    shifted = lambda x, by: np.concatenate([x[by:], np.full(min(by, len(x)), x[-1])])
    paired = lambda x, y, by: _numbered(x << own | shifted(y, by), 2 * own)
    out, have, left = None, 0, width // unit
    while left:
        if left & 1:
            out = part if out is None else paired(out, part, have)
            have += unit
        left >>= 1
        if left:
            part = paired(part, part, unit)
            unit *= 2
    return out[: len(data)]


def _range_least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value in lo .. hi (hi included, hi >= lo) from a table of least values of 1, 2, 4 ... in a row."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for k in np.unique(level):
        m = level == k
        out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << int(k)) + 1])
    return out


def repeated_starts(rows: list[bytes], folder: str, length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each row the starts of strings of that length that also start elsewhere in the rows.

    A row, read in symbols from each of its first `symbol` bytes, is so many documents. The transform begins with
    their end markers; each round then inserts one symbol of every document, from its last to its first. All suffixes stay
    in order: a document's next suffix goes where the transform's entries, sorted by symbol and place, have the symbol
    that stands before its last one. Each new suffix shares with its neighbour one symbol more than the least that the
    suffixes between the two shared before. Four files hold, in that order, the transform, the shared lengths (no more
    than asked for), where each suffix starts, and the entries by symbol and place; a round reads and writes each once.
    Rows of the same bytes go in once with a count; every string of theirs starts in each of them.
    """
    given, once = rows, {r: None for r in rows}
    index = dict(zip(once, range(len(once)), strict=True))
    which = [index[r] for r in given]
    rows, many = list(once), np.bincount(which, minlength=len(once)) > 1
    need = length // symbol
    assert need * symbol == length
    sizes = np.array([len(r) for r in rows], np.int64)
    offset = np.cumsum(sizes) - sizes
    code = symbols(b"".join(rows), symbol) + 1
    shift = np.arange(symbol)
    count = np.maximum(0, (sizes[:, None] - shift) // symbol).ravel()
    base = (offset[:, None] + shift).ravel()
    base, count = base[count > 0], count[count > 0]
    docs = len(base)
    if not docs:
        return [np.zeros(0, np.int64) for _ in given]
    kind = np.int32 if len(code) < 1 << 31 else np.int64  # of a place in the collection
    files = External(folder)
    try:
        place = np.arange(docs)  # of each document's longest suffix so far
        column = base + symbol * (count - 1)  # where its next symbol stands
        entry = code[column]
        files["bwt"] = entry.astype(np.int32)
        files["lcp"] = np.zeros(docs, np.uint8)
        files["start"] = np.full(docs, -1, kind)
        files["entries"] = np.sort(entry << 32 | place)
        live = np.arange(docs)
        while len(live):
            entries, shared = files.read("entries", np.int64), files.read("lcp", np.uint8)
            key = entry << 32 | place
            order = np.argsort(key)
            live, place, entry, column, key = (x[order] for x in (live, place, entry, column, key))
            rank = np.searchsorted(entries, key)
            to = docs + rank
            # Shared lengths of the new suffixes and of those right behind them.
            mark = np.zeros(len(entries) + 1, bool)
            mark[rank] = mark[rank + 1] = True
            touched = np.flatnonzero(mark[:-1])
            before = np.maximum(touched - 1, 0)
            same = (touched > 0) & (entries[touched] >> 32 == entries[before] >> 32)
            table, k = [shared], 1
            while 2 * k <= len(shared):
                table.append(np.minimum(table[-1][:-k], table[-1][k:]))
                k *= 2
            value = np.zeros(len(touched), np.uint8)
            a, b = (entries[before[same]] & 0xFFFFFFFF) + 1, entries[touched[same]] & 0xFFFFFFFF
            value[same] = np.minimum(_range_least(table, a, b) + np.uint8(1), need)
            # The files with the new suffixes in them.
            bwt, start = files.read("bwt", np.int32), files.read("start", kind)
            size = len(bwt) + len(live)
            fresh = np.zeros(size, bool)
            fresh[to] = True
            old = np.flatnonzero(~fresh)
            more = column > base[live]
            following = np.where(more, code[np.maximum(column - symbol, 0)], 0)
            # Nothing is inserted behind the last round, so only starts and lengths are read again.
            for name, was, now in (("bwt", bwt, following.astype(np.int32)), ("start", start, column))[0 if more.any() else 1 :]:
                out = np.empty(size, was.dtype)
                out[old], out[to] = was, now
                files[name] = out
            out = np.zeros(size, np.uint8)
            out[old] = shared
            out[docs + touched] = value
            files["lcp"] = out
            if not more.any():
                break
            entries = (entries >> 32 << 32) | old[entries & 0xFFFFFFFF]
            live, place, entry, column = live[more], to[more], following[more], column[more] - symbol
            new = np.sort(entry << 32 | place)
            files["entries"] = np.insert(entries, np.searchsorted(entries, new), new)
        hit = np.flatnonzero(files.read("lcp", np.uint8) >= need)
        start = files.read("start", kind).astype(np.int64)
        start_row = np.searchsorted(offset, start, side="right") - 1
        counted = start[(start >= 0) & many[start_row] & (start - offset[start_row] + length <= sizes[start_row])]
        at = np.unique(np.concatenate([start[hit], start[hit - 1], counted]))
    finally:
        files.close()
    row = np.searchsorted(offset, at, side="right") - 1
    cut = np.searchsorted(row, np.arange(len(rows) + 1))
    return [at[cut[i] : cut[i + 1]] - offset[i] for i in which]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(x[0]), len(x)) for x in np.split(starts, cut)]


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def covered(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal (start, end) of bytes that strings starting at lo .. lo+n-1 cover."""
    out: list[list[int]] = []
    for lo, n in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], lo + n + length - 1)
        else:
            out.append([lo, lo + n + length - 1])
    return [(a, b) for a, b in out]


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of docs: kept, the bytes that no repeated string covers.

    Every byte that a string of `length` bytes covers goes if that string also starts anywhere else, in the same text
    too; strings are judged on what is given. spans: maximal removed (start, end).

    Null text is empty; a text shorter than length loses nothing. Rows repeated in full are documents of their own, so
    what of them is long enough goes. Null doc_id: a document as any other. Other columns are not read. No rows give
    no rows. An anchor with more than `hot` rows (a string in very many contexts) has its strings dealt out one by one,
    so that no task holds them all; they go through the transform as rows do.
    """
    spark = docs.sparkSession
    keep = Written(spark, "repeats")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tk"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                i, h, d, lo, n, twice = anchors(_bytes(part.column(2)), length, gram)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(h), pa.array(d), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["doc_id", "tk", "h", "d", "lo", "n", "twice"],
                )

    found = given.mapInArrow(find, "doc_id long, tk long, h long, d long, lo int, n int, twice boolean")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t")).filter("c > 1 OR t").select("h")
    rows = keep.put(found.join(often, "h").drop("twice"), "rows")
    # Two rows of each content, or the only one; `first` tells them apart.
    row = F.struct("doc_id", "tk", "lo", "n")
    contents = rows.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min(row).alias("r"), F.max(row).alias("z"))
    one, two = F.struct(F.lit(True).alias("first"), "r.*"), F.struct(F.lit(False).alias("first"), "z.*")
    wanted = keep.put(contents.select("h", "d", (F.col("c") > 1).alias("many"), F.explode(F.when(F.col("c") > 1, F.array(one, two)).otherwise(F.array(one))).alias("x")).select("h", "d", "many", "x.*"), "wanted")
    lists = wanted.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "d", "many", "first", "lo", "n")).alias("rows"))

    def some(of: DataFrame):
        """The documents that of names, through a filter of fixed size; the join drops the few others."""
        bits = spark.sparkContext.broadcast(filter_bits(of.select(filter_place("doc_id", "tk"))))

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(batch.columns[:3], ["doc_id", "tk", "text"]).filter(passes(bits.value, batch.column(3)))

        return given.select("doc_id", "tk", "text", filter_place("doc_id", "tk")).mapInArrow(run, "doc_id long, tk long, text string"), bits

    def cut(batches):
        for batch in batches:
            out = []
            for i, tk, t, rs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                out += [(r["h"], r["d"], r["many"], r["first"], i, tk, r["lo"], t[r["lo"] : r["lo"] + r["n"] + length - 1]) for r in rs]
            for at in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[at : at + 4096], strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    texts, _ = some(wanted)
    texts = texts.dropDuplicates(["doc_id", "tk"])
    lists = lists.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    same = (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    pieces = keep.put(texts.join(lists, same).select("doc_id", "tk", "text", "rows").mapInArrow(cut, "h long, d long, many boolean, first boolean, doc_id long, tk long, lo int, bytes binary"), "pieces")

    folder = keep.root

    def build(batches):
        for held in _collections(batches):
            starts = repeated_starts([r[-1] for r in held], folder, length)
            out = [(*r[:3], *r[4:6], lo if r[2] else r[6] + lo, n) for r, s in zip(held, starts, strict=True) if r[3] for lo, n in _runs(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _NAMED.types, strict=True)], schema=_NAMED)

    common = [r["h"] for r in wanted.groupBy("h").count().filter(F.col("count") > hot).select("h").limit(MOST_HOT + 1).collect()]
    is_hot = F.col("h").isin(common) if common else F.lit(False)
    if len(common) > MOST_HOT:  # as many as no list should name: told by a join
        named_hot = wanted.groupBy("h").count().filter(F.col("count") > hot).select("h", F.lit(True).alias("is_hot"))
        pieces = keep.put(pieces.join(named_hot, "h", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False))), "told")
        is_hot = F.col("is_hot")
    columns = ["h", "d", "many", "first", "doc_id", "tk", "lo", "bytes"]
    dealt = pieces.filter(~is_hot).select(columns).repartition("h").sortWithinPartitions("h")
    named = dealt.mapInArrow(build, "h long, d long, many boolean, doc_id long, tk long, lo int, n int")
    if common:
        named = named.unionByName(_by_string(pieces.filter(is_hot).select(columns), keep, length))
    named = keep.put(named, "named")
    # Places of a content count from its rows' beginnings.
    shared = named.filter("many").select("h", "d", F.col("lo").alias("at"), F.col("n").alias("of"))
    copies = rows.join(shared, ["h", "d"]).select("doc_id", "tk", (F.col("lo") + F.col("at")).alias("lo"), F.col("of").alias("n"))
    every = named.filter("NOT many").select("doc_id", "tk", "lo", "n").unionByName(copies).distinct()
    gone = keep.put(every.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("lo", "n")).alias("found")), "gone")

    hit, bits = some(gone)

    def clean(batches):
        for batch in batches:
            ok = passes(bits.value, batch.column(3))
            yield _told(batch.filter(pa.array(~ok.to_numpy(zero_copy_only=False))), None, length)

    def remove(batches):
        for batch in batches:
            yield _told(batch, batch.column(3).to_pylist(), length)

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: int, end: int>>, kept binary"
    untouched = given.select("doc_id", "tk", "text", filter_place("doc_id", "tk")).mapInArrow(clean, schema)
    gone = gone.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"})
    touched = hit.join(gone, same, "left").select("doc_id", "tk", "text", "found").mapInArrow(remove, schema)
    return untouched.unionByName(touched)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _told(batch: pa.RecordBatch, found: list | None, length: int) -> pa.RecordBatch:
    texts = _bytes(batch.column(2))
    spans, kept, removed = [], [], []
    for i, t in enumerate(texts):
        gone = covered([(x["lo"], x["n"]) for x in found[i] or ()], length) if found else []
        spans.append([{"start": a, "end": b} for a, b in gone])
        removed.append(sum(b - a for a, b in gone))
        edge = [0, *(x for ab in gone for x in ab), len(t)]
        kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)) if gone else t)
    arrays = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows, sorted by their first column, in lists that hold all rows of a value and at least COLLECTION, but the last."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= COLLECTION and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_string(pieces: DataFrame, keep: Written, length: int) -> DataFrame:
    """What the transform names in rows of very common anchors, their strings dealt out one by one. Strings whose 128 bits
    stand nowhere else do not repeat; of the others two of each go in."""
    spark = pieces.sparkSession

    def hashes(bits):
        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    t = batch.column(7)[at].as_py()
                    lo = np.arange(len(t) - length + 1)
                    data = np.frombuffer(t, np.uint8)
                    h1 = span_hash(prefix_hash(data), lo, lo + length).view(np.int64)
                    h2 = span_hash(prefix_hash(data ^ np.uint8(0x5A)), lo, lo + length).view(np.int64)
                    same = lambda c, m, b=batch, i=at: b.column(c).slice(i, 1).take(pa.array(np.zeros(m, np.int64)))
                    if bits is not None:
                        lo = lo[passes(bits.value, pa.array((h1 >> 1) % FILTER_BITS)).to_numpy(zero_copy_only=False)]
                    first = batch.column(6)[at].as_py()
                    key = [*(same(c, len(lo)) for c in range(6)), pa.array(lo.astype(np.int32)), pa.array(np.full(len(lo), first, np.int32)), pa.array(h1[lo]), pa.array(h2[lo])]
                    names = ["h", "d", "many", "first", "doc_id", "tk", "at", "lo", "h1", "h2"]
                    if bits is not None:
                        key, names = [*key, pa.array([t[x : x + length] for x in lo.tolist()], pa.binary())], [*names, "bytes"]
                    yield pa.RecordBatch.from_arrays(key, names)

        return run

    schema = "h long, d long, many boolean, first boolean, doc_id long, tk long, at int, lo int, h1 long, h2 long"
    strings = keep.put(pieces.mapInArrow(hashes(None), schema), "strings")
    often = keep.put(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h1", "h2"), "often")
    place = F.pmod(F.shiftright("h1", 1), F.lit(FILTER_BITS)).alias("_bit")
    bits = spark.sparkContext.broadcast(filter_bits(often.select(place)))
    again = pieces.mapInArrow(hashes(bits), f"{schema}, bytes binary").select("h1", "h2", "bytes")
    # Equal strings meet before the shuffle: the least and the greatest of those that share 128 bits.
    pairs = again.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k"), F.min("bytes").alias("a"), F.max("bytes").alias("b")).filter("k > 1")
    folder = keep.root

    def build(batches):
        for held in _collections(batches):
            starts = repeated_starts([r[2] for r in held], folder, length)
            out = [r[:2] for r, s in zip(held, starts, strict=True) if len(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["h1", "h2"])

    both = pairs.select("h1", "h2", F.explode(F.array("a", "b")).alias("bytes")).repartition("h1").sortWithinPartitions("h1")
    found = keep.put(both.mapInArrow(build, "h1 long, h2 long").distinct(), "found")
    hit = strings.filter("first").join(found, ["h1", "h2"], "left_semi")
    return hit.select("h", "d", "many", "doc_id", "tk", F.when(F.col("many"), F.col("at")).otherwise(F.col("lo") + F.col("at")).alias("lo"), F.lit(1).alias("n"))


def op2(spark, sf_dir):
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every start's 200 bytes (400 hexadecimal digits), cut from blocks of 100 starts so that no long text is searched again.
OP2_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT r, from_byte, substr(h, 2 * from_byte + 1, 598) AS part FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 100)) AS from_byte FROM texts WHERE len(h) >= 400)),
hashed AS (
  SELECT r, from_byte + i AS pos, md5(substr(part, 2 * i + 1, 400)) AS m
  FROM (SELECT r, from_byte, part, unnest(range(0, least(100, len(part) // 2 - 199))) AS i FROM blocks)),
many AS (SELECT m FROM hashed GROUP BY m HAVING count(*) > 1),
removed AS (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM hashed SEMI JOIN many USING (m)),
numbered AS (SELECT r, pos, sum(CASE WHEN pos <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY pos) AS run FROM removed),
spans AS (SELECT r, min(pos) AS a, max(pos) + 200 AS z FROM numbered GROUP BY r, run),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS free FROM spans),
cut AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS last,
    string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS front
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""
