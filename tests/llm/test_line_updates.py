"""Documents that are deleted from the line ledger and inserted again."""

from __future__ import annotations

from barsmith.llm import linededup


def test_insert_after_delete(spark):
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    one, two = (linededup.key_of(x) for x in (b"shared line number one", b"another shared line"))
    dropped = lambda x: {(r["doc"], bytes(r["key"])) for r in x.dropped().collect()}
    ledger = linededup.LineDedup(spark, shards=2)
    ledger.insert(make([(1, "shared line number one"), (2, "shared line number one\nanother shared line")]))
    ledger.delete(make([(1, "")]).select("doc_id"))
    assert dropped(ledger) == set()
    ledger.insert(make([(1, "another shared line")]))  # an update: the old line stays out
    assert dropped(ledger) == {(2, two)}
    ledger.delete(make([(1, "")]).select("doc_id"))
    assert dropped(ledger) == set()
    ledger.insert(make([(1, "shared line number one")]))
    assert dropped(ledger) == {(2, one)}
