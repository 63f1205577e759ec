"""Scopes of threads, letters, secrets of any length, shards beyond two bytes."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from helpers import SCHEMA, line_dedup, rows
from pyspark.sql import functions as F

from barsmith.llm import language, linededup, secrets
from barsmith.llm.common import discard, scratch, shared_path, stored


def test_a_scope_holds_the_paths_of_its_own_thread(spark):
    seen, opened, made = {}, threading.Event(), threading.Event()

    def other():
        opened.wait(60)
        df = stored(spark.range(5), "other-query")
        made.set()
        seen["rows"] = df

    worker = threading.Thread(target=other)
    worker.start()
    with scratch() as mine:
        own = stored(spark.range(3), "own")
        with scratch() as inner:
            path = shared_path(spark, "inner")
        opened.set()
        assert made.wait(120)
    worker.join(60)
    assert len(mine) == 2 and inner == [path] == mine[1:] and all("other-query" not in p for p in mine)
    assert own.count() == 3
    discard(spark, mine)
    assert seen["rows"].count() == 5  # the other query's table is still there


def test_number_signs_are_no_letters(spark):
    texts = ["the cat and the dog " * 20] * 30 + ["²", "½ 12", "① Ⅷ 3", "7", "", None, "x²", "я"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs).collect()}
    for i, t in enumerate(texts):
        lettered = any(c.isalpha() for c in t or "")
        assert (got[i][0] == "und") != lettered and (lettered or got[i][1] == 0)


@pytest.mark.parametrize("size", [36, 37, 60, 5000])
def test_prefixed_secrets_are_whole(spark, size):
    text = "ab ghp_" + "a1B2c"[:5] * (size // 5) + "x" * (size % 5) + " and AIza" + "Q-_z" * (size // 4) + "Q" * (size % 4) + "."
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    spans = secrets.report(secrets.SecretLedger(spark).update(docs)).first()["spans"].split(",")
    assert {s for s in spans if s.startswith("prefixed")} == {f"prefixed:3:{7 + size}", f"prefixed:{12 + size}:{16 + 2 * size}"}


def test_shards_beyond_two_bytes(spark):
    rng = np.random.default_rng(4)
    keys = np.frombuffer(rng.bytes(16 * 500), np.uint8).reshape(-1, 16)
    shards = 3_000_017
    df = spark.createDataFrame([(bytearray(k.tobytes()),) for k in keys], "key binary")
    got = [r["shard"] for r in df.select(linededup.shard_of(shards)).collect()]
    assert got == [int.from_bytes(k[12:].tobytes(), "big") % shards for k in keys] and max(got) > 65536
    filters = {s: linededup.Cuckoo.built(keys[np.array(got) == s]) for s in set(got)}
    assert linededup.passing(keys, filters, shards).all()
    # few shards: the places in a filter do not follow from the shard
    one = keys[(np.array([int.from_bytes(k[12:].tobytes(), "big") for k in keys]) % 4) == 1]
    assert len(np.unique(linededup.Cuckoo.parts(one, 64)[1])) > 40
    docs = [(i, f"line number {i % 7} of these\nown line of text {i}") for i in range(40)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA)
    found = rows(linededup.dedup(table, shards=shards).withColumn("kept", F.col("kept")), "doc_id", "n_lines", "n_dropped", "kept")
    assert found == sorted(line_dedup(docs), key=repr)
