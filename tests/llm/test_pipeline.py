"""The pipeline stage by stage against plain Python."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest
from helpers import SCHEMA, WORD, clashing, documents, line_dedup, near_components, repeat_words
from pyspark.sql import functions as F

from barsmith.llm import mixing, packing, quality
from barsmith.llm.common import scratch


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage returns for a small corpus, written and read again."""
    folder = tmp_path_factory.mktemp("corpus")
    extra = [f"Document number {i} is about the sea and the sky, and it is told at some length. " * 1 + " ".join(f"w{i}x{k} and the" for k in range(40)) + "\nA passage that many of the documents repeat word by word." for i in range(12)]
    docs = documents(spark).union(spark.createDataFrame([(500 + i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(extra)], SCHEMA))
    docs = docs.union(spark.createDataFrame([(700, extra[3], "en", "src1", 5), (701, extra[3], "en", "src1", 5)], SCHEMA))
    docs.write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(folder)).write.parquet(f"{folder}/stage{i}")
        out.append(spark.read.parquet(f"{folder}/stage{i}"))
    return str(folder), out


def listed(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_shapes(tables):
    _, out = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "source mixing", "best-fit packing"]
    assert all(t.columns == list(corpus_pipeline.COLUMNS) for t in out[:-1])
    assert corpus_pipeline.ORACLE_SQL is None


def fails(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    if len(w) < 50 or 100 * repeat_words(w) > 50 * len(w):
        return True
    chars = sum(map(len, w))
    symbols = sum(c in quality.SYMBOLS for c in t)
    return (
        100 * chars < 250 * len(w)
        or 100 * chars > 1500 * len(w)
        or 100 * symbols > 10 * len(w)
        or (len(lines) - len(set(lines)) >= 3 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines))
        or (2 * sum(c.isascii() and c.isalpha() for c in t) > chars and len({x for x in w if x in quality.STOP_FORMS}) < 2)
    )


def test_quality_stage(tables):
    _, out = tables
    want = [r for r in listed(out[0]) if not fails(r[1])]
    assert sorted(listed(out[1]), key=repr) == sorted(want, key=repr)
    assert {500 + i for i in range(12)} <= {r[0] for r in want}


def test_line_stage(tables):
    _, out = tables
    before = listed(out[1])
    kept = line_dedup([(r[0], r[1]) for r in before])
    want = [(r[0], k[3], r[2], r[3], len(k[3])) for r, k in zip(before, kept, strict=True)]
    assert sorted(listed(out[2]), key=repr) == sorted(want, key=repr)


def test_near_stage(tables):
    _, out = tables
    before = listed(out[2])
    lowest = near_components([(r[0], r[1]) for r in before])
    want = [r for r, low in zip(before, lowest, strict=True) if r[0] is None or r[0] == low]
    assert sorted(listed(out[3]), key=repr) == sorted(want, key=repr)
    assert 701 not in {r[0] for r in want}  # of the emptied copies the first stays


def test_mixing_stage(tables):
    _, out = tables
    taken = {(r["doc_id"], r["source"]): (r["size"], r["taken"]) for r in mixing.mix(out[3]).collect()}
    words: dict = {}
    texts = {(r[0], r[3]): r[1] for r in listed(out[3])}
    for d, text, _, source, n in listed(out[4]):
        words[d, source] = words.get((d, source), 0) + len(WORD.findall(text))
        assert texts[d, source].startswith(text) and n == len(text)
    assert words == {k: t for k, (_, t) in taken.items() if t}


def test_stages_with_clashing_columns(spark, tables):
    """Further columns of any name change nothing and come along."""
    folder, out = tables
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, clashing(out[i]), folder)
        assert got.columns == clashing(out[i]).columns
        assert sorted(listed(got), key=repr) == sorted(listed(out[i + 1]), key=repr)
        assert got.select("gone", "words", "size").distinct().collect() == [("clash",) * 3]


def test_packing_stage_and_run(spark, tables):
    folder, out = tables
    last = out[5].collect()
    encode = packing.encoder("byte_bpe_50k.json")
    assert sum(r["length"] for r in last) == sum(len(encode(r[1] or "")) + 1 for r in listed(out[4]))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted(map(tuple, df.select(*keep).collect()))
    with scratch() as made:
        last = corpus_pipeline.run(spark, folder)
    assert key(last) == key(out[5])
    left = [p for p in made if Path(p.removeprefix("file:")).exists()]
    assert len(made) > 20 and all("packing" in p or "source-mixing" in p for p in left)  # no stage's tables stay


def test_first_words(spark):
    texts = ["a bb  ccc\nd", "  lead a b", "one", " \n x "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2):
        got = [r[0] for r in df.select(corpus_pipeline.first_words(F.col("t"), F.lit(n))).collect()]
        for t, g in zip(texts, got, strict=True):
            assert t.startswith(g) and WORD.findall(g) == WORD.findall(t)[:n]
