"""Strategy artifacts in batches: every program of a folder in a few plans, one row for each artifact.

An artifact names a program by the numbers of a vocabulary, and a symbol. What cannot run keeps its
reason. The different programs of the rest are cut into waves of at most `width`; a wave is one plan over
all its symbols, in which equal expressions of different programs are columns once. A strategy sees its
symbol alone, so cross-sections are of one bar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barsmith.functions.algebra import BLOCK, Engine

from .formulas import VOCABULARY, Vocabulary, compiled, executable
from .reports import profit

#: Programs of one plan.
WIDTH = 32
FIGURES = "n_bars long, annual double, total_return double, sharpe double, max_drawdown double"


class Alone(Engine):
    """An engine for which every symbol is the only one."""

    def __init__(self, panel: DataFrame, block: int | None = None):
        super().__init__(panel, block)
        self.across = W.partitionBy("symbol", "bar_idx", BLOCK)


def checked(artifacts: DataFrame, symbols: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """artifacts (formula array<int>, symbol, vocab_version; others stay) with `status`: ok, or why not. A
    missing version counts as the present one. symbols: a column symbol, each once."""
    known = symbols.select(F.col("symbol").alias("k_symbol"))
    n = len(vocabulary.names)
    version = F.coalesce("vocab_version", F.lit(vocabulary.version))
    status = (
        F.when(F.coalesce(F.size("formula"), F.lit(0)) <= 0, "no formula")
        .when(version != vocabulary.version, F.concat(F.lit("made with vocabulary "), version))
        .when(F.exists("formula", lambda t: t.isNull() | (t < 0) | (t >= n)), "unknown token")
        .when(F.col("k_symbol").isNull(), "unknown symbol")
        .otherwise("ok")
    )
    return artifacts.join(known, F.col("symbol") == F.col("k_symbol"), "left").withColumn("status", status).drop("k_symbol")


def waves(programs: list[tuple[int, ...]], width: int) -> list[list[tuple[int, ...]]]:
    """Programs in plans of at most `width`, those that begin alike together, as they share expressions."""
    ordered = sorted(programs)
    return [ordered[k : k + width] for k in range(0, len(ordered), width)]


def scan(artifacts: DataFrame, panel: DataFrame, figures: Callable[[DataFrame], DataFrame], width: int = WIDTH, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """artifacts with status and the figures of each on its own symbol. panel: bars by symbol and bar_idx with
    a column `cost`; figures: from (program, symbol, bar_idx, pnl) to rows by (program, symbol).

    Artifacts that name the same program and symbol share a computation and have a row each; invalid
    ones and those of an empty panel have no figures.
    """
    spark = artifacts.sparkSession
    own = artifacts.withColumn("formula", F.col("formula").cast("array<int>"))
    own = checked(own, panel.select("symbol").distinct(), vocabulary)
    # programs become expressions of plans, so they come to the driver: a few numbers each, never bars
    programs = [tuple(r["formula"]) for r in own.filter("status = 'ok'").select("formula").distinct().collect()]
    runs = {p: executable([vocabulary.names[t] for t in p], vocabulary) for p in programs}
    numbers = spark.createDataFrame([(list(p), k if runs[p] else None) for k, p in enumerate(programs)], "formula array<int>, program int")
    own = own.join(F.broadcast(numbers), "formula", "left")  # as many rows as programs
    own = own.withColumn("status", F.when((F.col("status") == "ok") & F.col("program").isNull(), "not executable").otherwise(F.col("status")))
    own = own.withColumn("program", F.when(F.col("status") == "ok", F.col("program")))
    place = {p: k for k, p in enumerate(programs)}
    parts = []
    wanted = own.filter("status = 'ok'").select(F.col("program").alias("w_program"), F.col("symbol").alias("w_symbol")).distinct()
    for wave in waves([p for p in programs if runs[p]], width):
        b = Alone(panel)
        cols = {f"p{place[p]}": profit(b, compiled(b, [vocabulary.names[t] for t in p], vocabulary), b.col("cost"))["pnl"] for p in wave}
        kinds = ", ".join(f"{c[1:]}, {c}" for c in cols)
        rows = b.frame(**cols).selectExpr("symbol", "bar_idx", f"stack({len(cols)}, {kinds}) AS (program, pnl)")
        asked = (F.col("program") == F.col("w_program")) & (F.col("symbol") == F.col("w_symbol"))
        parts.append(figures(rows.join(wanted, asked, "left_semi")))
    if not parts:
        return own.drop("program").select("*", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in FIGURES.split(", ")])
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = found.withColumnsRenamed({"program": "f_program", "symbol": "f_symbol"})
    return own.join(found, (F.col("program") == F.col("f_program")) & (F.col("symbol") == F.col("f_symbol")), "left").drop("program", "f_program", "f_symbol")
