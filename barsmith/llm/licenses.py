"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are the lines, the paragraphs (lines up to a blank one) and, for each template, all runs of
as many words as it has, divided by the threshold; so a notice may be wrapped over lines or have
words between. A block's token set is joined with every template whose containment
|block & template| / |template| reaches the threshold. A paragraph contains no less of a template
than any of its lines, so lines need no join of their own. Tokens are ordered by their document
frequency in all rows, rarest first; a template of size s can only be met by a block that
holds one of its s - need + 1 rarest tokens (prefix filter), has `need` tokens (length filter)
and, from the place of its first shared token on, enough template tokens left (positional
filter). Each template's survivors are verified by counting the shared tokens.

One pass over the texts cuts them into words; it keeps the text of documents that hold enough of some
template, which all blocks are part of, and the second pass reads only those. Up to
MAX_INDEX_TOKENS the templates are a literal in the projection: that join shuffles nothing and
no group can be hot. Larger sets are joined by their rarest tokens as tables, with the same blocks,
filters and results. The frequencies of the templates' own tokens cross the network
pre-aggregated, one row a token and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored, text_or_empty

OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The end of a line before a blank one.
BLANK = r"\n[\x20\x09\x0B-\x0D]*+(?=\n)"
#: Fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD = 0.8
#: Token sets larger than this together are joined as tables.
MAX_INDEX_TOKENS = 5_000
#: Short notices by which texts state their license.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def words_of(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased."""
    return F.filter(F.split(text, OTHER + "+", -1), lambda w: w != "")


def tokens_of(templates: dict[str, str]) -> dict[str, set[str]]:
    return {label: set(text.split()) for label, text in templates.items()}


def needed(tokens: set[str] | list[str], threshold: float) -> int:
    """So many tokens of a template a block has to hold."""
    return math.ceil(threshold * len(tokens) - 1e-9)


def frequencies(rows: DataFrame) -> dict[str, int]:
    """Rows that hold each token; rows: a column `held`. At most one row a token of the templates
    comes to the driver."""
    counts = rows.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


def containment(words: Column, paragraphs: Column, own: Column, need: Column, span: Column) -> Column:
    """The tokens of a template that its best block holds; null if no block passes. own: the template's tokens,
    the rarest first."""
    size = F.size(own)
    prefix = F.slice(own, F.lit(1), size - need + 1)

    def shared(block: Column) -> Column:
        held = F.array_intersect(own, block)  # keeps the template's order
        first = F.array_position(own, F.get(held, F.lit(0)))  # from 1
        return F.when(size - first + 1 >= need, F.size(held))

    met = F.filter(paragraphs, lambda p: (F.size(p) >= need) & F.arrays_overlap(prefix, p))
    by_paragraph = F.array_max(F.transform(met, shared))

    at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(own, x["w"]))

    def by_run(hits: Column) -> Column:
        """Runs start at a template word; the template's words in a run are its hits."""
        run = lambda h, k: F.filter(F.slice(hits, k + 1, span), lambda x: x["i"] < h["i"] + span)
        held = lambda h, k: F.transform(run(h, k), lambda x: x["w"])
        one = lambda h, k: F.when(F.arrays_overlap(prefix, held(h, k)), F.size(F.array_distinct(held(h, k))))
        return F.array_max(F.transform(hits, one))

    most = F.greatest(by_paragraph, let(at, by_run))
    return F.when(most >= need, most)


def cut(text: Column) -> tuple[Column, Column]:
    """The words and the paragraphs (as word sets) of a text."""
    return words_of(text), F.transform(F.split(text, BLANK, -1), lambda part: F.array_distinct(words_of(part)))


MET = "array<struct<label:string,score:double>>"


def met_by_literal(text: Column, held: Column, templates: dict[str, str], threshold: float, seen: dict[str, int]) -> Column:
    """array<struct<label, score>> of the templates that a block of the text meets."""
    sets = tokens_of(templates)

    def found(z: Column) -> Column:
        out = []
        for label, tokens in sets.items():
            own = F.array(*[F.lit(t) for t in sorted(tokens, key=lambda t: (seen.get(t, 0), t))])
            need = needed(tokens, threshold)
            span = math.ceil(len(templates[label].split()) / threshold - 1e-9)
            most = containment(z["words"], z["paragraphs"], own, F.lit(need), F.lit(span))
            hit = F.transform(F.filter(F.array(most), lambda n: n.isNotNull()), _scored(label, len(tokens)))
            # a block holds no more of a template than its document
            out.append(F.when(F.size(F.array_intersect(own, held)) >= need, hit).otherwise(F.array().cast(MET)))
        return F.concat(*out)

    words, paragraphs = cut(text)
    return let(F.struct(words.alias("words"), paragraphs.alias("paragraphs")), found)


def _scored(label: str, size: int):
    return lambda n: F.struct(F.lit(label).alias("label"), (n / size).alias("score"))


def met_by_join(rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(m_rid, met) of the rows (rid, text) that meet a template, for template sets of any size."""
    spark = rows.sparkSession
    listed = [(k, sorted(v), needed(v, threshold), math.ceil(len(templates[k].split()) / threshold - 1e-9)) for k, v in tokens_of(templates).items() if v]
    table = stored(spark.createDataFrame(listed, "label string, tokens array<string>, need int, span int"), "license-templates")
    words = rows.select("rid", F.array_distinct(words_of(F.col("text"))).alias("words"))
    words = words.select("rid", F.size("words").alias("size"), F.explode("words").alias("word"))
    each = table.select("label", "need", F.size("tokens").alias("all"), F.explode("tokens").alias("token"))
    counts = words.groupBy(F.col("word").alias("c_word")).agg(F.count(F.lit(1)).alias("n"))
    each = each.join(counts, F.col("token") == F.col("c_word"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = Window.partitionBy("label").orderBy("n", "token")
    each = stored(each.withColumn("place", F.row_number().over(rarest)).select("label", "need", "all", "token", "place"), "license-index")
    prefix = each.filter("place <= all - need + 1")
    pairs = words.join(prefix, F.col("word") == F.col("token")).filter("size >= need AND all - place + 1 >= need").select("rid", "label").distinct()
    own = each.groupBy(F.col("label").alias("o_label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("own"))
    own = own.join(table.select("label", "need", "span"), F.col("o_label") == F.col("label")).drop("label")
    both = pairs.join(own, F.col("label") == F.col("o_label")).join(rows.select(F.col("rid").alias("t_rid"), "text"), F.col("rid") == F.col("t_rid"))
    all_words, paragraphs = cut(F.col("text"))
    most = containment(all_words, paragraphs, F.col("own"), F.col("need"), F.col("span"))
    both = both.select("rid", "label", F.size("own").alias("all"), most.alias("most")).filter("most IS NOT NULL")
    hit = F.struct(F.col("label"), (F.col("most") / F.col("all")).alias("score"))
    return both.groupBy(F.col("rid").alias("m_rid")).agg(F.sort_array(F.collect_list(hit)).cast(MET).alias("met"))


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document the places of the base phrases and the labels of both.

    Null and empty texts have no word, no label and score 0; repeated rows and null ids are
    kept as they are; an empty table gives an empty result; other columns are not read. Tokens of
    one frequency are ordered by code point, which changes no result. score is 1 with a base label,
    else the highest containment found.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = with_phrases(df)
    sets = tokens_of(templates)
    none = F.array().cast(MET)
    if sum(map(len, sets.values())) <= MAX_INDEX_TOKENS:
        vocabulary = sorted(set().union(*sets.values()))
        df = df.withColumn("held", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("words")) if vocabulary else F.array().cast("array<string>"))
        enough = F.lit(False)
        for tokens in sets.values():
            enough = enough | (F.size(F.array_intersect(F.array(*map(F.lit, sorted(tokens))), F.col("held"))) >= needed(tokens, threshold))
        df = df.withColumn("text", F.when(enough, F.col("text")))
        df = stored(df.select("doc_id", "text", "held", *PLACES), "license-words")
        met = met_by_literal(F.col("text"), F.col("held"), templates, threshold, frequencies(df)) if vocabulary else none
        df = df.withColumn("met", F.when(F.col("text").isNotNull(), met).otherwise(none))
    else:
        df = stored(df.select("doc_id", "text", *PLACES).withColumn("rid", F.monotonically_increasing_id()), "license-rows")
        met = met_by_join(df, templates, threshold)
        df = df.join(met, F.col("rid") == F.col("m_rid"), "left").withColumn("met", F.coalesce("met", none))
    both = F.array_sort(F.array_union("base_set", F.transform("met", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("met", lambda m: m["score"])), F.lit(0.0))
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


PLACES = ("n_words", "n_base", "first_word", "last_word", "base_set")


def with_phrases(df: DataFrame) -> DataFrame:
    """Adds the counts and places of the base phrases to rows with `text` and `words`."""
    said = [p.replace(" ", OTHER + "++") for p in PHRASES]
    phrase = rf"(?<!{WORD})(?:{'|'.join(said)})(?!{WORD})"
    base = F.regexp_extract_all("text", F.lit(phrase), F.lit(0))
    # the look-behind is slow, so it is tried only on texts that pass without it
    base = F.when(F.rlike("text", F.lit("(?:" + "|".join(said) + ")")), base).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("base", base)
    count = lambda t: F.size(words_of(t))
    gaps = F.split("text", phrase, -1)
    some = F.size("base") > 0
    first = F.when(some, count(F.get(gaps, F.lit(0))))
    last = F.when(some, F.size("words") - count(F.element_at(gaps, -1)) - count(F.element_at("base", -1)))
    names = F.transform("base", lambda b: F.coalesce(*[F.when(b.startswith(p.split()[0]), F.lit(n)) for p, n in PHRASES.items()]))
    return df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_base": F.size("base").cast("long"),
            "first_word": first.cast("long"),
            "last_word": last.cast("long"),
            "base_set": F.array_sort(F.array_distinct(names)),
        }
    )
