"""Strategy artifacts and report sinks as JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGY = (
    "vocab_version string, symbol string, formula array<int>, best_score double, formula_decoded string, "
    "timeframe string, data_file string, mode string, train_steps int"
)


def read_strategies(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts, one JSON value a file; a bare list is a formula without anything else."""
    text = spark.read.text(path, wholetext=True)
    whole, bare = F.from_json("value", STRATEGY), F.from_json("value", "array<int>")
    is_list = F.startswith(F.ltrim(F.col("value")), F.lit("["))
    fields = [f.split(" ")[0] for f in STRATEGY.split(", ")]
    picked = [F.when(is_list, bare).otherwise(whole["formula"]).alias(n) if n == "formula" else F.when(~is_list, whole[n]).alias(n) for n in fields]
    return text.select(*picked)


def write_json(df: DataFrame, path: str) -> None:
    """The writer's commit protocol makes the result appear at once or not at all."""
    df.write.mode("overwrite").json(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by symbol and timeframe, so that a scan reads only the folders it asks for."""
    bars.write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)
