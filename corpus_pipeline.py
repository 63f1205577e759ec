"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes the documents that its predecessor kept and returns a table of its own; the
first four return documents again, with the columns of the table they got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import linededup, mixing, nearcopies, packing, quality
from barsmith.llm.common import WS, discard, scratch, stored, unused

#: So many ids at most are broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the rest stays as it is."""
    return quality.kept(docs)


def with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs out of a struct `row`, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a document with a smaller id holds; no document goes."""
    rows = linededup.dedup(docs, keep=tuple(docs.columns))
    return rows.select(*with_text(docs, F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) the document with the
    smallest id stays, all rows of that id if there are several; a document without an id stays."""
    found = nearcopies.near_copies(docs)
    key = unused(docs, "gone")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    gone = stored(gone, "pipeline-near-copies")
    # a bounded table is broadcast, so that no text moves
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    parts = F.split(text, f"(?<={WS})(?!{WS})", -1)  # each part but a leading one of white space starts a word
    lead = F.when(F.rlike(text, F.lit("^" + WS)), 1).otherwise(0)
    return F.rtrim(F.array_join(F.slice(parts, F.lit(1), n.cast("int") + lead), ""))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as the mix takes them: a row for each whole repetition and, for
    the one document of a source at the edge, a row with the words that are still taken."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.filter(F.array(part), lambda x: x > 0))
    rows = mixed.withColumn("words", F.explode(copies))
    text = F.when(F.col("words") > 0, first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    return rows.withColumn("cut", text).select(*with_text(docs, F.col("cut")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints and token ids are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. Once a stage's result is written, what it read and what it made on the
    way is deleted."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(spark, old + made[:-1])
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
