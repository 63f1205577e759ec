"""Language identification with many languages and long texts."""

from __future__ import annotations

import math
import random
import re
import zlib

from helpers import SCHEMA

from barsmith.llm import language


def made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_more_than_64_languages(spark):
    rng = random.Random(6)
    data, i = [], 0
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)]
        for _ in range(9 if k < 64 else 6):
            data.append((i, made(rng, words, 60), f"l{k:02}", "s", 0))
            i += 1
    labels = {r[0]: r[2] for r in data}
    got = language.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r["lang_pred"] for r in got} == set(labels.values())
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_a_language_of_long_texts(spark):
    rng = random.Random(7)
    data = [(i, made(rng, ["one", "two", "three", "four"], 50), "en", "s", 0) for i in range(20)]
    data += [(100 + i, made(rng, ["один", "два", "три", "четыре"], 20_000), "ru", "s", 0) for i in range(12)]
    assert all(len(t.encode()) > language.MAX_FIT_BYTES for _, t, lang, _, _ in data if lang == "ru")
    df = spark.createDataFrame(data, SCHEMA)
    assert {r["doc_id"] for r in language.identify(df).collect() if r["lang_pred"] == "ru"} == set(range(100, 112))
    assert max(len(r["text"].encode()) for r in language.sampled(df, 400).collect()) <= language.MAX_FIT_BYTES


def plain_bits(training: list[bytes], text: bytes, order: int = 3) -> int:
    """Code length by prediction by partial matching, byte by byte from dictionaries."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in training:
        padded = bytes(order) + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                own = counts.setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1

    def chances(context: bytes) -> dict[int, float]:
        below = chances(context[1:]) if context else dict.fromkeys(range(256), 1 / 256)
        own = counts.get(context)
        if not own:
            return below
        whole = sum(own.values()) + len(own)
        left = sum(p for b, p in below.items() if b not in own)
        escape = len(own) / whole / (left or 1)
        return {b: own[b] / whole if b in own else p * escape for b, p in below.items()}

    memo: dict[bytes, dict[int, float]] = {}
    padded, bits = bytes(order) + text, 0
    for i in range(order, len(padded)):
        context = padded[i - order : i]
        if context not in memo:
            memo[context] = chances(context)
        bits += round(-math.log2(max(memo[context][padded[i]], 2.0**-40)) * language.UNIT)
    return bits


def test_predictions_against_plain_python(spark):
    """Language and score of every text, of code lengths found from dictionaries."""
    rng = random.Random(12)
    words = {"en": "the sea was calm and cold that day", "de": "das meer war an dem tag ruhig und kühl", "ru": "море было в тот день тихим"}
    data = [(i, made(rng, words[lang].split(), rng.randrange(3, 25)), lang if i % 7 else None, "s", 0) for i, lang in enumerate(["en", "de", "ru"] * 12)]
    data += [(90, "wholly other letters: ñ 日本 zzz", "en", "s", 0), (91, None, "de", "s", 0), (92, "", "de", "s", 0), (93, "12 34", "de", "s", 0)]
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(data, SCHEMA), sample=10**6).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in data}
    names = sorted({lang for _, _, lang, *_ in data if lang})
    training = {n: [t.encode() for i, t, lang, *_ in data if lang == n and t is not None and not out[i]] for n in names}
    for i, text, *_ in data:
        if text is None or not re.search(r"[^\W\d_]", text):
            assert got[i] == (out[i], "und", 0.0)
            continue
        bits = [plain_bits(training[n], text.encode()) for n in names]
        best = min(bits)
        score = 1 / sum(2.0 ** ((best - b) / language.UNIT) for b in bits)
        assert got[i][:2] == (out[i], names[bits.index(best)]) and abs(got[i][2] - score) < 1e-6
