"""The parity-sketch join against all pairs in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import SCHEMA, WORD, ascii_lower, clashing, documents, rows
from pyspark.sql import functions as F

from barsmith.llm import nearcopies, parity


def grams(text, k=4):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def plain(docs):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 20 * len(a & b) >= 17 * len(a | b):
                root[find(i)] = find(j)
    low: dict = {}
    for i, (d, _) in enumerate(docs):
        low.setdefault(find(i), []).append(d)
    least = lambda i: min((d for d in low[find(i)] if d is not None), default=None)
    return sorted(((d, len(s), least(i) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies on both sides of 0.85 at many lengths, chains, and a crowd around one text."""
    rng = random.Random(11)
    out = []
    for t in range(30):
        base = [f"t{t}w{rng.randrange(5000)}" for _ in range([5, 9, 11, 15, 25, 60, 200, 700][t % 8])]
        out += [" ".join(base), " ".join(base[:-1]), " ".join(base + ["more"])]
        out += [edited(rng, base, e) for e in (1, 1, 2, 3, max(1, len(base) // 60), max(1, len(base) // 50), max(1, len(base) // 40))]
        out += [" ".join(base[: int(len(base) * f)]) for f in (0.84, 0.86, 0.88, 0.95)]
    for _ in range(12):  # chains: each close to the next only
        chain = [f"c{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(5):
            chain = edited(rng, chain, 2).split()
            out.append(" ".join(chain))
    base = [f"crowd{rng.randrange(5000)}" for _ in range(150)]
    return out + [edited(rng, base, 1 + i % 4) for i in range(90)]


@pytest.mark.parametrize(("limit", "block"), [(32, 128), (2, 16)])
def test_all_pairs(spark, monkeypatch, texts, limit, block):
    monkeypatch.setattr(parity, "LIST", limit)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    want = plain(list(enumerate(texts)))
    assert rows(parity.near_sets(df), "doc_id", "n_shingles", "component_id") == want
    assert 40 < len({c for *_, c in want}) < len(texts) - 40


def test_awkward_texts(spark):
    df = documents(spark)
    want = plain([(r["doc_id"], r["text"]) for r in df.collect()])
    assert rows(parity.near_sets(df), "doc_id", "n_shingles", "component_id") == want
    assert rows(parity.near_sets(clashing(df)), "doc_id", "n_shingles", "component_id") == want
    empty = parity.near_sets(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id"]


def test_other_similarity(spark, texts):
    some = texts[:60]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(some)], SCHEMA)
    ones = rows(parity.near_sets(df, similar=(1, 1)), "doc_id", "component_id")
    assert all(grams(some[d]) == grams(some[c]) for d, c in ones)


def test_bounds():
    """What the join rests on: Hamming below symmetric difference, shared words, bands of partners."""
    rng = np.random.default_rng(3)
    bands = parity.Bands()
    for n in [*range(1, 60), 200, 333, 1000, 5000]:
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        most = int(2 * len(a) * 3 / 37)
        for gone in {0, 1, most // 2, most // 2 + 1}:
            kept, new = a[gone:], rng.integers(0, 1 << 63, max(0, most - gone), np.uint64)
            b = np.unique(np.r_[kept, new])
            apart = len(np.setxor1d(a, b))
            if not len(b) or apart * 37 > 3 * (len(a) + len(b)):
                continue
            at = bands.of(max(len(a), len(b)))
            if apart:
                assert at in bands.at(len(a)) and at in bands.at(len(b))
            elif not bands.most[at]:
                continue
            x, y = parity.sketch(a, bands.words[at]), parity.sketch(b, bands.words[at])
            assert sum(int(v).bit_count() for v in (x ^ y) & parity.LOW) <= apart <= bands.most[at] and (x != y).sum() <= apart
            shared = np.intersect1d(parity.posted(x, at, len(a), bands), parity.posted(y, at, len(b), bands))
            assert len(shared) >= 1 + bands.spare[at]
            assert len(np.unique(parity.keys_of(x, at))) == len(x)


def test_common_passage_makes_few_pairs(spark):
    """Unlike texts that share a passage, and with it words of their sketches, keep hardly any key."""
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    words = [passage + [f"w{rng.getrandbits(30)}" for _ in range(60)] for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(words)], SCHEMA)
    bands = parity.Bands()
    schema = "doc_id long, digest long, row long, node long, n long, band int, own array<long>, next array<long>"
    texts = df.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("digest"))
    nodes = texts.mapInArrow(parity._sketches(parity.SHINGLE, bands), schema)
    assert parity.candidates(parity.lists(nodes, bands), bands, parity.SIMILAR)[0].count() < 800  # of 79,800
    assert {(r["doc_id"], r["component_id"]) for r in parity.near_sets(df).collect()} == {(i, i) for i in range(400)}
