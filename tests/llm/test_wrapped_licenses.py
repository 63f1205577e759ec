"""License notices that are wrapped over lines."""

from __future__ import annotations

import textwrap

from helpers import SCHEMA, TEXTS, documents, rows

from barsmith.llm import licenses

PROSE = "The sea was calm that day and nobody thought of the storm to come, for there was work to do. "
#: Every template word with little of the others near it.
SPREAD = "\n\n".join(f"{w} {PROSE * 3}" for w in licenses.TEMPLATES["gpl"].split())


def labels(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return [(r["labels"].split(","), r["score"]) for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_wrapped_notices(spark):
    names = list(licenses.TEMPLATES)
    wrap = lambda t, width, sign: textwrap.fill(t, width, initial_indent=sign, subsequent_indent=sign)
    texts = [f"{PROSE}\n{wrap(licenses.TEMPLATES[n], w, sign)}\n{PROSE}" for n in names for w, sign in ((60, "# "), (24, " * "))]
    for name, (found, score) in zip([n for n in names for _ in range(2)], labels(spark, texts), strict=True):
        assert name in found and score == 1.0


def test_blank_lines_and_words_between(spark):
    words = licenses.TEMPLATES["bsd"].split()
    broken = "\n \n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))  # by runs of words only
    long = " ".join(f"{w} and so on" for w in words[:11]) + "\n" + " ".join(f"{w} and so on" for w in words[11:])  # by its paragraph only
    got = labels(spark, [broken, long, SPREAD, "\n" * 200_000 + " " * 200_000])
    assert got[0] == (["bsd"], 1.0) and got[1] == (["bsd"], 1.0)
    assert got[2] == ([""], 0.0) and got[3] == ([""], 0.0)


def test_many_templates_by_join(spark, monkeypatch):
    """The join of tables gives what the literal gives."""
    texts = TEXTS + [textwrap.fill(licenses.TEMPLATES["bsd"], 40) + "\n\n" + licenses.TEMPLATES["mit"], "redistribution and use in source " * 5]
    df = documents(spark, texts)
    names = ("doc_id", "n_words", "n_base", "labels", "score")
    want = rows(licenses.scan(df), *names)
    monkeypatch.setattr(licenses, "MAX_INDEX_TOKENS", 10)
    assert rows(licenses.scan(df), *names) == want and sum("bsd" in r[3] for r in want) > 0
    many = licenses.TEMPLATES | {f"own{i}": " ".join(f"t{i}w{k}" for k in range(12)) for i in range(600)}
    texts = ["x " + many["own7"] + " y", many["own8"].replace("t8w3", "other"), " ".join(many["own9"].split()[:9])] + [""] * 6
    got = rows(licenses.scan(documents(spark, texts, copies=0), many), "labels", "score")
    assert {r[0] for r in got} >= {"own7", "own8", ""} and not any("own9" in r[0] for r in got)
    assert licenses.scan(documents(spark).filter("false"), many).count() == 0
