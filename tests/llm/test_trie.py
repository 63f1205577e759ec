"""The prefix trie against a trie of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barsmith.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(table):
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()), key=repr
    )


def table(rng):
    texts = [None, "", "one", "two é", "three 日本", "🎉"]
    rows = []
    for c in range(-7, 70):
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)))
    rows += rows[:9]  # repeated rows
    rows += [(200 + c, t, "user", "same") for c in range(30) for t in range(6)]  # copies
    rows += [(100, t, "user", f"t{t % 7}") for t in range(400)]  # one long conversation
    rows += [(101, t, "user", f"t{t % 7}") for t in range(390)] + [(None, 1, "user", "no conversation")] * 3
    return rows


def got(df, rebuild=True):
    turns = trie.ordered(df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.report(trie.trie(*(trie.rebuilt(turns) if rebuild else (turns, trie.sizes(turns))))).collect()), key=repr)


@pytest.mark.parametrize(("parts", "piece"), [(4, 4096), (37, 5)])
def test_against_tuples(spark, monkeypatch, parts, piece):
    """Also with conversations spread over many ranges and lists over many pieces."""
    monkeypatch.setattr(trie, "PIECE", piece)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = table(random.Random(3))
        df = spark.createDataFrame(rows, SCHEMA).repartition(6)
        if parts > 4:
            spread = trie.ordered(df).filter("conv_id = 100").select("part").distinct().count()
            assert spread > 2
        assert got(df) == plain(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_without_rebuilding(spark):
    rows = [(c, t, "user", f"turn {t % (c + 1)}") for c in range(9) for t in range(c)]
    own = defaultdict(list)
    for c, _, r, t in rows:
        own[c].append((r, t))
    assert got(spark.createDataFrame(rows, SCHEMA), rebuild=False) == plain(own)


def test_turnless_and_empty(spark):
    # 3 has one turn and takes h > 1 from an absent conversation, so nothing is left of it
    c = next(c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(c, 0, "user", "x")], SCHEMA)
    assert got(df) == plain({c: []})
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_other_columns(spark):
    rows = table(random.Random(5))[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    names = "node parent depth size h head base part place content bytes length last tag lane0 up from to next first ids n".split()
    assert got(df.withColumns({n: F.lit("clash") for n in names})) == got(df) == plain(rebuilt(rows))


def test_doubling_rounds(spark, monkeypatch):
    """A path of 1,000 nodes takes 10 rounds, not 1,000."""
    rounds = []
    kept = trie.stored
    monkeypatch.setattr(trie, "stored", lambda df, name: rounds.append(name) or kept(df, name))
    nodes = spark.range(1000).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS up", "1L AS value")
    found = {r["node"]: r["value"] for r in trie.rollup(nodes, ("value",), 999).collect()}
    assert found == {k: 1000 - k for k in range(1000)} and len(rounds) == 11
