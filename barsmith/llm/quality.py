"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over one document, so the plan is a scan and a
projection: no shuffle, no join, no user function. A rule is (name, measure, comparison,
bound); the table is data, and `compiled` turns it into the one Boolean column.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, text_or_empty, unused, ws_words

#: Frequent function words of languages in Latin letters: English, French, German and
#: Spanish, then a few each of Italian, Portuguese, Dutch, Swedish, Danish, Polish, Czech, Finnish,
#: Turkish, Romanian, Hungarian, Indonesian and Vietnamese.
STOP_WORDS = (
    "the of and to in is that it for on as with by this be are was or an at from "
    "le la les de des et en un une que qui dans pour sur est au du par "
    "der die das und zu den von mit ist im ein eine nicht auf dem "
    "el los las y del se por con una para su al lo como "
    "il di che non per della e sono o em uma os do da het van een niet dat voor och att som det inte på "
    "og på til af w nie na i jest że a v je ja ei ovat oli ve bir bu için și cu nu az és egy hogy yang dan di ini và của là"
).split()
#: A word as texts have it: small, with a capital, all capitals.
STOP_FORMS = tuple(sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())}))
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails when `measure` `comparison` `bound` holds."""

    name: str
    measure: str
    comparison: str
    bound: float


#: Base rules of the contract, in integers so that no rounding decides.
BASE_RULES = (
    Rule("too_short", "n_words", "<", 50),
    Rule("repetitive", "100 * n_repeat_words - 50 * n_words", ">", 0),
)
#: Rules of this table; ratios are written as products for the same reason.
RULES = (
    Rule("short_words", "100 * word_chars - 250 * n_words", "<", 0),
    Rule("long_words", "100 * word_chars - 1500 * n_words", ">", 0),
    Rule("symbols", "100 * n_symbols - 10 * n_words", ">", 0),
    # a text of few lines may repeat one
    Rule("repeated_lines", "CASE WHEN n_dup_lines >= 3 THEN 100 * n_dup_lines - 30 * n_text_lines ELSE 0 END", ">", 0),
    # the list speaks for texts in plain Latin letters only
    Rule("no_stop_words", "CASE WHEN 2 * n_ascii_letters > word_chars THEN n_stop_words ELSE 2 END", "<", 2),
)


def failed(rules: tuple[Rule, ...]) -> Column:
    """The rules as one Boolean expression over the measures."""
    said = [f"(({r.measure}) {r.comparison} {r.bound:g})" for r in rules]
    return F.expr(" OR ".join(said) or "false")


def repeat_words(grams: Column) -> Column:
    """Words that stand in a window which the text holds twice or more. `grams` are the
    3-word windows in order (none, if no window can repeat). They are sorted with their places
    and neighbours compared, n log n for any text."""
    at = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, j: x["g"].eqNullSafe(F.get(s, j - 1)["g"]) | x["g"].eqNullSafe(F.get(s, j + 1)["g"]),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(f: Column) -> Column:
        following = F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.lit(2_000_000_000)))
        steps = F.zip_with(f, following, lambda a, b: F.least(F.lit(3), b - a).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    counted = let(F.sort_array(at), lambda s: let(places(s), covered))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), counted).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Per document the id, the text and all measures."""
    more = [F.col(carry)] if carry else []
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *more)
    df = df.withColumn("words", ws_words(F.col("text")))
    n = F.size("words")
    grams = F.when(
        n >= 3,
        F.transform(
            F.slice("words", 1, n - 2),
            lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1), F.lit(" "), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    hashes = F.when(
        n >= 3,
        F.transform(F.slice("words", 1, n - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    ascii_letters = string.ascii_letters
    stop = F.array_intersect(F.array(*map(F.lit, STOP_FORMS)), F.col("words"))
    # equal windows have equal hashes: all hashes distinct proves that no window repeats
    df = df.withColumns({"hashes": hashes, "lines": lines})
    unlike = F.size(F.array_distinct("hashes")) == F.size("hashes")
    df = df.withColumn("grams", F.when(unlike, F.array().cast("array<string>")).otherwise(grams))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    long = lambda c: c.cast("long")
    return df.select(
        "doc_id",
        "text",
        long(n).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.when(F.rlike("text", F.lit(f"[{SYMBOLS}]")), symbols).otherwise(0)).alias("n_symbols"),
        long(F.size("lines")).alias("n_text_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeat_words(F.col("grams")).alias("n_repeat_words"),
        long(F.size(stop)).alias("n_stop_words"),
        long(F.length("text") - F.length(F.translate("text", ascii_letters, ""))).alias("n_ascii_letters"),
        *more,
    )


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
) -> DataFrame:
    """Measures and verdict of every document, one row each.

    Null or empty text has no word, fails the length rule and is not kept. A null id stays
    null, repeated rows are judged each, and an empty table gives an empty result. Columns
    of docs other than id and text are not read, whatever their names. No rule compares
    documents, so ties do not arise; equal lines all but the first are repeats.
    """
    df = measured(docs, id_col, text_col, carry).drop("text")
    return df.withColumn("base_failed", failed(BASE_RULES)).withColumn(
        "kept", ~(F.col("base_failed") | failed(rules))
    )


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. The row number keeps the optimizer
    from moving the filter below the projections, where it would hold every measure many times."""
    row = unused(docs, "row")
    judged = judge(docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), rules, carry=row)
    judged = judged.withColumnRenamed(row, "the row").withColumn("at", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("at") >= 0)).select(*[F.col(f"`the row`.`{c}`") for c in docs.columns])


def report(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
