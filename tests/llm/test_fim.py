"""Fill-in-middle against a version that keeps all units."""

from __future__ import annotations

import hashlib
import re

import pytest
from helpers import SCHEMA, clashing, documents, rows

from barsmith.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


EXTRA = ["<P> mark", "a <S", "<M", " lead and trail \n", "x" + " " * 200_000, "é 日本 \x0b🎉 <", "<<S <P <M<", " " * 5, "w"] * 12


@pytest.fixture(scope="module")
def docs(spark):
    df = documents(spark)
    more = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(EXTRA)], SCHEMA)
    return df.union(more).cache()


def test_against_all_units(docs):
    got = rows(fim.transform(docs), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    want = [plain(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_round_trip_and_other_marks(docs):
    marks = fim.Marks("⟨p⟩", "⟨s⟩", "⟨m⟩")
    for m, rate in ((fim.Marks(), 100), (marks, 100)):
        found = fim.transform(docs, keep=("doc_id", "text"), rate=rate, seed=7, marks=m)
        back = found.select("row.text", "form", fim.restored(found["output"], found["form"], m).alias("back")).collect()
        assert all((r["text"] or "") == r["back"] for r in back)
        assert sum(r["form"] != "plain" for r in back) > len(back) // 2
    for bad in (fim.Marks("<P>", "<P>", "<M>"), fim.Marks("<P<", "<S>", "<M>"), fim.Marks("", "a", "b"), fim.Marks("[a", "b[", "c")):
        with pytest.raises(ValueError):
            fim.transform(docs, marks=bad)


def test_report(spark, docs):
    got = rows(fim.report(fim.transform(docs)), "doc_id", "output_sha256", "restored_sha256")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r["doc_id"], sha(plain(r["doc_id"], r["text"])[-1]), sha(r["text"] or "")) for r in docs.collect()]
    assert got == sorted(want, key=repr)
    assert rows(fim.report(fim.transform(clashing(docs))), "doc_id", "output_sha256", "restored_sha256") == got
    empty = fim.report(fim.transform(spark.createDataFrame([], SCHEMA)))
    assert empty.count() == 0 and empty.columns == fim.report(fim.transform(docs)).columns


def test_matcher_is_lazy(monkeypatch):
    """The second pass takes no match beyond the larger rank, and neither pass holds any."""
    taken = []

    class Counting:
        def finditer(self, text):
            for m in fim_unit.finditer(text):
                taken.append(m.end())
                yield m

    fim_unit = fim.UNIT
    monkeypatch.setattr(fim, "UNIT", Counting())
    assert fim.ends(b"a b c d e f", 1, 3) == (1, 5) and len(taken) == 3
    assert fim.ends(b"a b c", 0, 0) == (0, 0) and fim.ends(b"a b c ", 4, 4) == (6, 6)
