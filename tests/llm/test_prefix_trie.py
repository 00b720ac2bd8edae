"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from trustweave.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, ids int, depth string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    """Nodes of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        ends = ",".join(str(c) for c in sorted(members[p]) if whole[c] == p)
        below = [out[k] for k in kids[p]]
        saved = ((len(members[p]) - 1) * len(p[-1][1]) if p else 0) + sum(b[6] for b in below)
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def talks(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(-150, 900), n):
        if draw.random() < 0.3:
            rows += [(c, t, "user", f"same {t}") for t in range(9)]  # copies: a third of all
            continue
        length = draw.choice([0, 1, 2, 3, 8, 30])
        rows += [(c, t if t or draw.random() < 0.5 else None, draw.choice(["user", None, ""]), draw.choice(["a", "bé", "", None, "long " * 5])) for t in range(length)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("local", [(10_000, 10_000), (3, 40), (1, 1)])
def test_buckets_of_any_size(spark, local, rebuild):
    rows = talks(local[0], 120) + [(5000 + i, t, "user", f"way {t}" if t < 40 else f"{i} {t}") for i in range(8) for t in range(43)]
    rows += [(None, 1, "user", "no conversation"), (7000, 1, None, None), (7000, 1, None, None), (2**60, 0, "user", "far")]
    got = prefix_trie.prefix_trie(frame(spark, rows), rebuild, *local)
    assert found(got) == plain(rows, rebuild)


def test_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
    rows = [(3, 0, "a", "b")]  # its only turn is replaced by one of a conversation that is not there
    assert zlib.crc32(b"3") % 6 > 0 and found(prefix_trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_many_copies_are_listed_in_order(spark):
    df = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("text").alias("text"))
    got = {r["depth"]: r for r in prefix_trie.prefix_trie(df, rebuild=False).collect()}
    assert got[1]["n_convs"] == 20_000 and got[1]["saved_tokens"] == 19_999 * 4
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op11_equals_sql(spark, at):
    duckdb.sql(f"create or replace view conversations as select * from '{at}/conversations.parquet'")
    want = duckdb.sql(prefix_trie.OP11_SQL)
    got = prefix_trie.op11(spark, at)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
