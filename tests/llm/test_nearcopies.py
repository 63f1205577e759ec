"""Near copies against all pairs in plain Python."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
import xxhash
from helpers import SCHEMA, WORD, documents, near_components

from barsmith.llm import nearcopies


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.getrandbits(40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies of several texts on both sides of 0.8, and a crowd around one text."""
    rng = random.Random(8)
    out = []
    for t in range(12):
        base = [f"t{t}w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        out += [" ".join(base)] + [edited(rng, base, e * len(base) // 200) for e in (1, 2, 3, 4, 5, 6)]
    base = [f"crowd{rng.randrange(5000)}" for _ in range(150)]
    return out + [edited(rng, base, 2 + i % 4) for i in range(80)]


@pytest.mark.parametrize(("limit", "block"), [(32, 128), (2, 16)])
def test_all_pairs(spark, monkeypatch, texts, limit, block):
    monkeypatch.setattr(nearcopies, "LIST", limit)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(df).collect())
    want = list(zip(range(len(texts)), near_components(list(enumerate(texts))), strict=True))
    assert got == want and 20 < len({c for _, c in want}) < len(texts) - 20


def test_awkward_texts(spark):
    df = documents(spark)
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(((r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(df).collect()), key=repr)
    assert got == sorted(zip((d for d, _ in plain), near_components(plain), strict=True), key=repr)
    assert nearcopies.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_drops_copies_of_four_fifths(spark, sf):
    rng = random.Random(4)
    base = [f"word{rng.randrange(9000)}" for _ in range(300)]
    rows = [(1, " ".join(base), "en", "s", 1), (2, edited(rng, base, 6), "en", "s", 1), (3, edited(rng, base, 60), "en", "s", 1)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def plain_fingerprint(text):
    """SimHash of the different 5-word shingles, bit by bit."""
    words = WORD.findall(text.lower())
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)}
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints_alone_find_their_links(spark, sf, monkeypatch):
    """Without a single pair from the minima the stage still joins what operator 8 links and whole sets confirm."""
    monkeypatch.setattr(nearcopies, "MIN_SHARED", nearcopies.BANDS * nearcopies.ROWS + 1)
    rng = random.Random(5)
    texts = []
    for t in range(12):
        base = [f"t{t}w{rng.randrange(5000)}" for _ in range(800)]
        texts += [" ".join(base), edited(rng, base, 1)]
    fps = [plain_fingerprint(t) for t in texts]
    near = [(fps[i] ^ fps[i + 1]).bit_count() <= 2 for i in range(0, len(texts), 2)]
    assert 3 < sum(near) < 12
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, sf).collect())
    assert left == sorted(i for i in range(len(texts)) if i % 2 == 0 or not near[i // 2])


def test_pairs_of_fingerprints(spark):
    """Equal fingerprints meet at the smallest node, others within two bits through the smallest of each."""
    nodes = [(5, 0), (3, 0), (9, 0), (7, 3), (2, 7), (1, -1)]
    got = nearcopies.sign_pairs(spark.createDataFrame(nodes, "node long, fp long")).collect()
    assert sorted(map(tuple, got)) == [(2, 7), (3, 5), (3, 7), (3, 9)]


def test_fingerprint_links_are_checked(spark, monkeypatch):
    """Sets that have only a fingerprint in common stay apart."""
    monkeypatch.setattr(nearcopies, "fingerprint", lambda hashes: 0)
    texts = [" ".join(f"t{t}w{i}" for i in range(60)) for t in range(6)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert all(r["doc_id"] == r["component_id"] for r in nearcopies.near_copies(df).collect())
