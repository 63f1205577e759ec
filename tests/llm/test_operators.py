"""The ten operators against plain Python, on a fixture with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import LONG, SCHEMA, WORD, ascii_lower, clashing, components, digest, documents, fingerprint, line_dedup, listed, repeat_words, rows, spans_of
from pyspark.sql import functions as F

from barsmith.llm import language, licenses, linededup, mixing, packing, pii, quality, secrets, simhash, topk
from barsmith.llm.components import stars


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


RUNS = {
    "secrets": (lambda d: secrets.report(secrets.SecretLedger(d.sparkSession).update(d)), "doc_id"),
    "language": (language.identify, "doc_id"),
    "quality": (lambda d: quality.report(quality.judge(d)), "doc_id"),
    "licenses": (licenses.scan, "doc_id"),
    "linededup": (lambda d: linededup.report(linededup.dedup(d)), "doc_id"),
    "mixing": (lambda d: mixing.report(mixing.mix(d)), "doc_id"),
    "pii": (lambda d: pii.report(pii.find(d)), "doc_id"),
    "simhash": (lambda d: simhash.report(simhash.near_duplicates(d)), "doc_id"),
    "packing": (packing.pack, "doc_id"),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_and_clashing_columns(spark, docs, name):
    run, _ = RUNS[name]
    empty = run(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    once, again = run(docs), run(clashing(docs))
    assert once.columns == again.columns == empty.columns
    keep = [c for c in once.columns if c != "sequence_id" and c != "offset"]
    assert rows(once, *keep) == rows(again, *keep)


def secret_spans(text):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(s, 0, e, "assign") for s, e in spans_of(text, assign, lambda m: len(m[2]) >= 6)]
    found += [(s, 1, e, "access") for s, e in spans_of(text, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20)]
    return found + [(s, 2, e, "hex") for s, e in spans_of(text, "[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def test_secrets(docs, plain):
    got = rows(RUNS["secrets"][0](docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = []
    for d, t in plain:
        f = secret_spans(t or "")
        count = [sum(x[3] == k for x in f) for k in ("assign", "access", "hex")]
        want.append((d, *count, digest(listed(f))))
    assert got == sorted(want, key=repr)
    spans = {r["spans"] for r in RUNS["secrets"][0](docs).collect()}
    assert any("prefixed:" in s for s in spans) and any("address:" in s for s in spans)


def test_ledger_scans_only_what_is_new(spark, docs):
    ledger = secrets.SecretLedger(spark)
    ledger.update(docs)
    first = ledger.read().count()
    assert first == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    ledger.update(docs)
    assert ledger.read().count() == first  # nothing is scanned again
    more = spark.createDataFrame([(900, "secret=abcdefghi", "en", "s", 1)], SCHEMA)
    assert secrets.report(ledger.update(more)).first()["n_assign"] == 1
    assert ledger.read().count() == first + 1
    assert ledger.read().select("spans").filter(F.size("spans") > 0).count() > 0
    newer = tuple(secrets.Rule(r.name, r.pattern, r.valid, r.gate, 2) if r.name == "hex" else r for r in secrets.RULES)
    changed = secrets.SecretLedger(spark, ledger.path, newer)
    again = changed.update(docs)
    added = changed.read().filter(F.size("scanned") == 1)
    assert added.count() == first and set(added.select(F.col("scanned")[0]).distinct().first()) == {newer[2].version}
    assert again.filter(F.size(F.filter("found", lambda s: s["kind"] == "hex")) > 0).count() == 1


def test_narrowed_rule_and_doubled_batches(spark):
    """A narrower version drops what the wider one found, and a batch written twice counts once."""
    df = spark.createDataFrame([(1, "a" * 25 + " and " + "0123456789abcdef" * 2, "en", "s", 1)], SCHEMA)
    ledger = secrets.SecretLedger(spark)
    assert secrets.report(ledger.update(df)).first()["spans"] == "hex:0:25,hex:30:62"
    narrow = tuple(secrets.Rule("hex", "[0-9a-f]{30,}") if r.name == "hex" else r for r in secrets.RULES)
    again = secrets.SecretLedger(spark, ledger.path, narrow)
    assert secrets.report(again.update(df)).first()["spans"] == "hex:30:62"
    again.read().write.parquet(f"{ledger.path}/batch=twice")
    row = secrets.report(again.update(df)).first()
    assert (row["n_hex"], row["spans"]) == (1, "hex:30:62")
    back = secrets.SecretLedger(spark, ledger.path)  # the older rules find their own spans again
    assert secrets.report(back.update(df)).first()["spans"] == "hex:0:25,hex:30:62"


def test_long_secrets(spark):
    """No rule bounds a secret from above."""
    long = "aB3" * 1700
    texts = [f"x eyJ{long}.eyJ{long}.{long} y", f"redis://:{long}@host", f"https://{long}:{long}@host", "-----BEGIN " + "VERY " * 40 + "PRIVATE KEY-----", "github_pat_" + "g1" * 41]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["spans"] for r in RUNS["secrets"][0](df).collect()}
    want = [f"jwt:2:{len(texts[0]) - 2}", f"address:5:{len(texts[1]) - 4}", f"address:5:{len(texts[2]) - 4}", f"pem:0:{len(texts[3])}", f"prefixed:0:{len(texts[4])}"]
    assert [got[i] for i in range(5)] == want


def test_quality(docs, plain):
    got = rows(RUNS["quality"][0](docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t in plain:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = repeat_words(w)
        bad = len(w) < 50 or 100 * n > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, bad))
    assert got == sorted(want, key=repr)
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert not [x for x in quality.judge(docs).collect() if x["base_failed"] and x["kept"]]


def test_clean_texts_of_other_languages_stay(spark):
    """Other scripts, other languages, capitals, and a short text that repeats a line."""
    texts = [
        "В тот день море было спокойным и никто не думал о буре потому что было много работы " * 1 + " ".join(f"слово{i}ы" for i in range(60)),
        "Tego dnia morze było spokojne i nikt nie myślał o burzy, że jest to dużo pracy " + " ".join(f"słowo{i}a" for i in range(60)),
        "THE SEA WAS CALM THAT DAY AND NOBODY THOUGHT OF THE STORM " + " ".join(f"WORD{i}X" for i in range(60)),
        "a line\nthe sea and the sky " + " ".join(f"word{i}x" for i in range(60)) + "\na line",
        " ".join(f"xq{i}z" for i in range(80)),
    ]
    df = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in quality.kept(df).collect()} == {0, 1, 2, 3}


def test_licenses(docs, plain):
    got = rows(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    sets = licenses.tokens_of(licenses.TEMPLATES)
    want = []
    for d, t in plain:
        split = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", x) if w]
        low = ascii_lower(t or "")
        w = split(low)
        at = [(i, n) for i in range(len(w)) for p, n in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
        base = sorted({n for _, n in at})
        more = {k for line in low.split("\n") for k, s in sets.items() if len(s & set(split(line))) / len(s) >= licenses.THRESHOLD - 1e-12}
        places = [i for i, _ in at]
        want.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *more}))))
    assert got == sorted(want, key=repr)
    assert any("gpl-3" in r[-1] for r in got)


def test_line_dedup(docs, plain):
    got = rows(linededup.dedup(docs), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == sorted(line_dedup(plain), key=repr)
    assert sum(r[2] for r in got) > 4


def test_line_dedup_is_reversible(spark):
    docs = [(1, "shared line number one\nonly in one here"), (2, "shared line number one\nsecond shared line"), (3, "SECOND shared line\nshared line number one")]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    ledger = linededup.LineDedup(spark, shards=3)
    ledger.insert(make(docs[:2]))
    ledger.insert(make(docs[2:]))
    text = lambda df: {(r["doc"], bytes(r["key"])) for r in df.collect()}
    one, two = (linededup.key_of(x) for x in (b"shared line number one", b"second shared line"))
    assert text(ledger.dropped()) == {(2, one), (3, one), (3, two)}
    ledger.delete(make(docs[:1]).select("doc_id"))
    assert text(ledger.dropped()) == {(3, one), (3, two)}  # the next document keeps the line
    ledger.delete(make(docs[1:2]).select("doc_id"))
    assert text(ledger.dropped()) == set()
    assert not any(f["filter"].strip(b"\0") for f in ledger.filters.collect())  # all fingerprints are gone


def test_line_dedup_counts_documents(spark):
    """Deletion first, repeated ids, updates of live documents and growth of the filters."""
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    empty = linededup.LineDedup(spark)
    empty.delete(make([(1, "")]).select("doc_id"))
    assert empty.dropped().count() == 0
    rng = random.Random(9)
    ledger, live = linededup.LineDedup(spark), {}
    for step in range(4):
        batch = [(rng.randrange(12), "\n".join(f"a line with number {rng.randrange(25)}" for _ in range(6))) for _ in range(5)]
        ledger.insert(make(batch))
        for d, t in batch:
            live.setdefault(d, set()).update(t.split("\n"))
        gone = rng.sample(range(14), 3)
        ledger.delete(make([(d, "") for d in gone]).select("doc_id"))
        live = {d: t for d, t in live.items() if d not in gone}
        holders: dict = {}
        for d, lines in live.items():
            for x in lines:
                holders.setdefault(linededup.key_of(x.encode()), set()).add(d)
        refs = {bytes(r["key"]): (r["n"], r["keeper"]) for r in ledger.refs().filter("n > 0").collect()}
        assert refs == {k: (len(h), min(h)) for k, h in holders.items()}
        got = {(r["doc"], bytes(r["key"])) for r in ledger.dropped().collect()}
        assert got == {(d, k) for k, h in holders.items() for d in h if d != min(h)}
        assert ledger.keys == sum(len(h) > 1 for h in holders.values())


def test_line_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 40)
    make = lambda lo, hi: spark.createDataFrame([(d, "\n".join(f"a shared line with number {i}" for i in range(lo, hi))) for d in (2 * lo, 2 * lo + 1)], "doc_id long, text string")
    ledger = linededup.LineDedup(spark)
    for lo, hi in ((0, 10), (10, 300), (300, 1500)):
        ledger.insert(make(lo, hi))
        assert ledger.shards >= ledger.keys / 40 and ledger.dropped().count() == hi
    fixed = linededup.LineDedup(spark, shards=2)  # shards that overflow are built anew
    for lo, hi in ((0, 10), (10, 300), (300, 1500)):
        fixed.insert(make(lo, hi))
        assert fixed.shards == 2 and fixed.dropped().count() == hi


def test_carried_columns(spark, docs):
    """Columns to keep come along whatever their names."""
    wide = clashing(docs)
    for run in (lambda: linededup.dedup(wide, keep=tuple(wide.columns)), lambda: mixing.mix(wide, keep=tuple(wide.columns))):
        got = run().select("row.*")
        assert got.columns == wide.columns and got.select("h", "b", "doc", "size").distinct().collect() == [("clash",) * 4]
        assert rows(got, "doc_id", "text") == rows(wide, "doc_id", "text")


def test_line_dedup_by_shuffle(spark, docs, monkeypatch):
    want = rows(linededup.dedup(docs), "doc_id", "n_dropped")
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(linededup, "TASK_POSTINGS", 3)
    assert rows(linededup.dedup(docs, shards=3), "doc_id", "n_dropped") == want


def test_cuckoo_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 16), np.uint8)
    others = rng.integers(0, 256, (5000, 16), np.uint8)
    f = linededup.Cuckoo.built(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.01
    f = linededup.Cuckoo.unpacked(f.packed())
    for i in range(2500):
        assert f.remove(keys[i : i + 1])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def water(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Clamping and resharing until none is above, as the contract words it."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        share = {s: left * weights[s] / w for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark, docs):
    mixed = mixing.mix(docs).collect()
    order = sorted({r["source"] for r in mixed}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in mixed if r["source"] == s) for s in order}
    want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        own = [r for r in mixed if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert want[s] - 1 - 1e-6 <= sum(r["taken"] for r in own) <= want[s] + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, again))
    shuffled = mixing.mix(docs, hash_digits=1)
    assert rows(shuffled, "doc_id", "size", "taken") == rows(mixing.mix(docs), "doc_id", "size", "taken")


def test_mixing_caps(spark):
    """A source far below its share stops at three times its size."""
    data = [(i, "w " * 100, "en", "big", 1) for i in range(50)] + [(90, "a b c", "en", "tiny", 1), (91, None, "en", "void", 1)]
    got = {r["source"]: r for r in mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["tiny"]["target"] == 9.0 and got["tiny"]["taken"] == 9
    assert got["void"]["target"] == 0.0 and got["big"]["target"] == 5003.0 - 9.0


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    }
    return [(s, i, e, k) for i, (k, (p, ok)) in enumerate(kinds.items()) for s, e in spans_of(text, p, ok)]


def test_pii(docs, plain):
    got = rows(RUNS["pii"][0](docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t in plain:
        f = personal_spans(t or "")
        want.append((d, *[sum(x[3] == k for x in f) for k in ("email", "ip", "card", "phone")], digest(listed(f))))
    assert got == sorted(want, key=repr)


def test_pii_on_random_texts(spark):
    rng = random.Random(3)
    alphabet = "a.b@+-_1 2(3)4é\n9"
    texts = ["".join(rng.choice(alphabet) for _ in range(200)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["base_sha256"] for r in RUNS["pii"][0](df).collect()}
    assert got == {i: digest(listed(personal_spans(t))) for i, t in enumerate(texts)}


def test_weak_supervision_learns_reliability():
    agree, differ = (1, 1, 1, 1), (0, 0, 0, 0)
    patterns = [("ssn", agree, 500), ("ssn", differ, 500), ("ssn", (1, 1, -1, 0), 20), ("ssn", (0, 0, -1, 1), 20)]
    post = pii.estimated(patterns)
    flat = (0,) * len(pii.SHAPES)
    weights = pii.fitted([(k, v, flat, n) for k, v, n in patterns], post)
    assert post["ssn", agree] > 0.95 > 0.05 > post["ssn", differ]
    value = lambda v: sum(a * b for a, b in zip(weights, pii.features("ssn", v, flat), strict=True))
    assert value(agree) > 0 > value(differ)


def test_pii_added_kinds_precision_and_recall(spark):
    """Planted numbers of the three added kinds among look-alikes of other things."""
    rng = random.Random(11)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts, planted = [], set()
    for i in range(900):
        ssn = f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}"
        phone = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{num(4)}"
        iban = f"{rng.choice(['DE', 'FR', 'ES', 'IT'])}{num(2)} " + " ".join(num(4) for _ in range(5))
        true = [("ssn", f"My social security number is ssn {{}} today.", ssn), ("local_phone", "Please call {} in the morning.", phone), ("iban", "Send it to the account {} please.", iban)]
        false = [("ssn", "See part no {}_a of the catalogue.", f"000-00-{num(4)}"), ("local_phone", "The build {}x was broken.", f"1{num(2)}.{num(3)}.{num(4)}"), ("iban", "Serial {}_b of the machine.", f"QQ{num(2)}{num(4)}{num(4)}{num(4)}")]
        kind, frame, hit = (true if i % 2 else false)[i // 2 % 3]
        text = "Some words before. " * (i % 4) + frame.format(hit)
        texts.append((i, text, "en", "s", 0))
        if i % 2:
            planted.add((i, kind, text.index(hit), text.index(hit) + len(hit)))
    found = pii.find(spark.createDataFrame(texts, SCHEMA)).collect()
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in found for s in r["found"] if s["kind"] not in pii.BASE}
    assert len(got & planted) >= 0.95 * len(planted)
    assert len(got & planted) >= 0.95 * len(got)


def test_many_matches_in_one_text(spark):
    """400,000 addresses in one text: places in seconds, and the right ones."""
    n = 400_000
    text = " ".join(f"u{i}@host.example" for i in range(n))
    df = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    got = pii.report(pii.find(df)).first()
    ends, at = [], 0
    for i in range(n):
        end = at + len(f"u{i}@host.example")
        ends.append(f"email:{at}:{end}")
        at = end + 1
    assert got["n_email"] == n and got["base_sha256"] == digest(ends)
    text = " ".join(f"token={i:08d}" for i in range(100_000))
    got = RUNS["secrets"][0](spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)).first()
    assert got["n_assign"] == 100_000 and got["base_sha256"] == digest([f"assign:{15 * i}:{15 * i + 14}" for i in range(100_000)])


def test_spans_apart(spark):
    rng = random.Random(4)
    make = lambda n: [(s := rng.randrange(4000), 0, s + rng.randrange(1, 30), "x", [1], [0], True) for _ in range(n)]
    for a, b in ((0, 5), (5, 0), (90, 300)):
        base, more = make(a), make(b)
        kind = pii.CANDIDATE
        df = spark.createDataFrame([(base, more)], f"base {kind}, more {kind}")
        got = df.select(pii.apart(F.col("more"), F.col("base"))).first()[0]
        want = [m for m in more if not any(m[0] < x[2] and x[0] < m[2] for x in base)]
        assert sorted((r["start"], r["end"]) for r in got) == sorted((m[0], m[2]) for m in want)


def test_simhash(docs, plain):
    got = rows(RUNS["simhash"][0](docs), "doc_id", "fingerprint", "component_id")
    pairs = [(d, fingerprint(t)) for d, t in plain]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(pairs, components(pairs), strict=True)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [48, 1])
def test_simhash_links_are_whole(spark, monkeypatch, limit):
    """Chains and crowds of near fingerprints; with a limit of 1 all go the linear way."""
    monkeypatch.setattr(simhash, "LIST", limit)
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(f)
            for _ in range(rng.choice([1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    root = {r["u"]: r["v"] for r in stars(edges).collect()}
    got = [root.get(s, s) for s in signed]
    want = components([(i, f) for i, f in enumerate(fps)])
    pairing = {}
    assert all(pairing.setdefault(g, w) == w for g, w in zip(got, want, strict=True))
    assert len(set(got)) == len(set(want))


def test_stars_on_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id AS u", "id - 1 AS v")
    edges = edges.union(spark.range(1000, 1050).selectExpr("1000 AS u", "id AS v"))
    got = {r["u"]: r["v"] for r in stars(edges).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {i: 1000 for i in range(1001, 1050)}


def topk_plain(vectors, k=5, every=50):
    """Every usable row is a candidate, repeated ones each; only a query's own id is left out."""
    usable = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2048, 16])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 8192 if block > 16 else 2)
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(260)]
    vectors += [(400 + i, vectors[3][1]) for i in range(9)]  # ties
    vectors += [vectors[100], vectors[50], vectors[50], vectors[1], vectors[1]]  # repeated rows
    vectors += [(500, None), (501, [None] * 8), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (None, [0.1] * 8), (600, [0.0] * 8), (650, [1e4, -1e4] * 4)]
    vectors += [(700, [0.5, -0.5]), (701, []), (702, [1.0] * 3)]  # shorter ones
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    df = df.withColumns({n: F.lit("clash") for n in ("q", "n", "times", "part", "rank", "each", "query_id", "score")})
    got = rows(topk.search(df), "query_id", "rank", "vec_id", "score")
    assert got == topk_plain(vectors)
    assert topk.search(df.filter("false")).count() == 0
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert topk.search(few).count() == 2  # fewer candidates than k


def test_topk_beyond_64_bits(spark):
    small = [(i, [1e6 * (i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(small, "vec_id long, embedding array<double>")
    assert topk.search(df).count() == 10  # sums that pass 64 bits on the way
    with pytest.raises(Exception, match="(?i)overflow|too large|int"):
        topk.search(spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")).collect()


def test_topk_stops_on_proof(monkeypatch):
    """Skewed vectors let the search stop early, and what it returns is still exact."""
    rng = np.random.default_rng(3)
    values = (rng.standard_cauchy((3000, 16)).clip(-500, 500) * 20).astype(np.int64).astype(float)
    block = topk.Segments(np.arange(3000), values)
    done = []
    monkeypatch.setattr(topk.np, "partition", lambda s, k, real=np.partition: (done.append(1), real(s, k))[1])
    for q in values[:20]:
        found, scores = block.search(q, -1, 5, None)
        exact = values @ q
        assert scores.tolist() == sorted(exact.tolist(), reverse=True)[:5]
        assert (exact[found] == scores).all()
    assert len(done) < 20 * len(topk.STEPS)  # some queries stop before their last segment


def test_packing(docs, plain):
    out = packing.pack(docs, capacity=512).collect()
    encode = packing.encoder("byte_bpe_50k.json")
    want = []
    for d, t in plain:
        ids, start = [*encode(t or ""), 0], 0
        first = len(ids) % 512 or 512
        for i, n in enumerate([len(ids)] if len(ids) <= 512 else [first] + [512] * ((len(ids) - first) // 512)):
            part = np.array(ids[start : start + n], "<u4").tobytes()
            want.append((d, i, start, n, zlib.crc32(part)))
            start += n
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    filled: dict = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)  # gapless from 0
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 512
    assert len(filled) <= -(-sum(filled.values()) // 512) + 1


def test_token_ids_are_the_tokenizers_own(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json")
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "  a\n\n b\t", "it's 1234 naïve 日本語 🎉\x00", "end <|endoftext|> here", LONG[:5000], " 　x y"]
    texts += [" " * 1_200_000 + "x", "\n" * 120_000, "a" * 50_000, "0a9f" * 20_000, "日本" * 20_000]
    for t in texts:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_and_is_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(np.exp(rng.normal(5.5, 1.1, 4000)).astype(int), 1, 2048)
    n, c = np.unique(lengths, return_counts=True)
    histogram = dict(zip(map(int, n), map(int, c), strict=True))
    configs = packing.plan(histogram)
    total: dict = {}
    for config, times in configs:
        assert sum(n * k for n, k in config.items()) <= 2048 and times > 0
        for n_, k in config.items():
            total[n_] = total.get(n_, 0) + k * times
    assert total == histogram
    assert sum(t for _, t in configs) <= -(-int(lengths.sum()) // 2048) * 1.01 + 1
    assert packing.bound(histogram) <= sum(t for _, t in configs)
    assert packing.plan({}) == [] and packing.plan({2048: 3}) == [({2048: 1}, 3)]


@pytest.mark.parametrize(("triplets", "slack"), [(100, 0.03), (2000, 0.02), (20000, 0.01)])
def test_plan_of_triplets(triplets, slack):
    """Sequences of just three pieces, which best fit alone leaves an eighth above the optimum."""
    rng = np.random.default_rng(triplets)
    histogram: dict = {}
    for _ in range(triplets):
        a = b = c = 0
        while not 512 < c < 1024:
            a, b = rng.integers(513, 1024, 2)
            c = 2048 - a - b
        for n in (a, b, c):
            histogram[int(n)] = histogram.get(int(n), 0) + 1
    configs = packing.plan(histogram)
    total: dict = {}
    for config, times in configs:
        assert sum(n * k for n, k in config.items()) <= 2048 and times > 0
        for n, k in config.items():
            total[n] = total.get(n, 0) + k * times
    assert total == histogram
    assert triplets - 1e-6 <= packing.bound(histogram) + 1e-3 <= triplets + 1
    assert sum(t for _, t in configs) <= triplets * (1 + slack)
    assert sum(t for _, t in packing.best_fit(histogram, 2048)) > triplets * 1.1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    seen = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert seen > 0.97
    crc = {r["doc_id"]: r["held_out"] for r in out.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in crc.items())


def test_language_edges(docs, plain):
    got = language.identify(docs).collect()
    texts = {(d, t) for d, t in plain}
    silent = {d for d, t in texts if t is None or not re.search(r"[^\W\d_]", t)}
    loud = {d for d, t in texts if t is not None and re.search(r"[^\W\d_]", t)}
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in silent - loud:
            assert r["lang_pred"] == "und"
        elif r["doc_id"] in loud - silent:
            assert r["lang_pred"] in ("en", "fr")


def test_language_model_is_a_distribution():
    """The probabilities of all bytes after any context add up to one."""
    text = b"the cat sat on the mat, the rat ate the cat"
    padded = bytes(3) + text
    grams = np.array([int.from_bytes(padded[i : i + 4], "big") for i in range(len(text))])
    gram, n = np.unique(grams, return_counts=True)
    model = language.Model(["x"], [gram], [n])
    table = np.exp2(-model.tables[0].reshape(-1, model.a) / language.UNIT)
    known = model.a - 1
    sums = table[:, 1:].sum(1) + table[:, 0] * (256 - known)
    assert np.allclose(sums, 1, atol=2e-3)
    assert model.code_lengths([text])[0, 0] < model.code_lengths([text[::-1]])[0, 0]


def test_language_blocks_do_not_matter(monkeypatch):
    text = "le chat est sur la table et la souris danse ".encode() * 50
    padded = bytes(3) + text
    grams = np.array([int.from_bytes(padded[i : i + 4], "big") for i in range(len(text))])
    gram, n = np.unique(grams, return_counts=True)
    model = language.Model(["x"], [gram], [n])
    whole = model.code_lengths([text, b"", b"a", text])
    monkeypatch.setattr(language, "BLOCK", 64)
    assert (model.code_lengths([text, b"", b"a", text]) == whole).all()
    assert whole[0] == whole[3] and whole[1] == 0


def test_sha_of_nothing(docs):
    none = hashlib.sha256(b"").hexdigest()
    assert none in {r["base_sha256"] for r in RUNS["secrets"][0](docs).collect()}


def test_extreme_texts(spark):
    """Long runs that invite backtracking, deep recursion or quadratic scans."""
    texts = [
        "a@" + "b." * 100_000 + "c",
        "x" * 500_000 + " @ ",
        "1 " * 200_000,
        "1." * 20_000 + "1",
        "+1" + " 1" * 200_000,
        "eyJ" * 100_000,
        "token" + " " * 500_000,
        "under " * 100_000 + "the mit license",
        "-" * 300_000,
        "same words here " * 30_000,
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in RUNS["pii"][0](df).collect()}
    assert found == {i: (0, 0, 0, 0) for i in range(10)} | {0: (1, 0, 0, 0), 3: (0, 5000, 0, 0)}
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in RUNS["secrets"][0](df).collect()) == 0
    assert {r["doc_id"]: r["n_base"] for r in licenses.scan(df).collect()} == {i: int(i == 7) for i in range(10)}
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(df).collect()}[9] == 90_000
    assert simhash.near_duplicates(df).count() == linededup.dedup(df).count() == mixing.mix(df).count() == 10
    assert packing.pack(df).agg(F.countDistinct("doc_id")).first()[0] == 10
    assert language.identify(df).count() == 10
