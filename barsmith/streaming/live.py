"""Streams of ticks: closed bars, direction flips, and signals of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barsmith.sources.storage import shared_path

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
HISTORY = 60


def ticks(spark: SparkSession, folder: str, name: str = "events.parquet", files_each: int = 1) -> DataFrame:
    """Files of a folder as a stream. The zone-less time becomes an instant, as watermarks need."""
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def closed_bars(stream: DataFrame, width: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Tumbling bars; in append mode a bar comes out once the watermark has passed its end, so the
    forming bar never does, and later ticks of a closed bar are dropped."""
    key = F.struct("ts", "event_id")
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.unix_timestamp("w.start").alias("time"), "open", "high", "low", "close", "volume")
    )


def direction(value: F.Column, low: float = 45.0, high: float = 55.0) -> F.Column:
    return F.when(value >= high, "LONG").when(value <= low, "SHORT").otherwise("FLAT")


def flips(stream: DataFrame) -> DataFrame:
    """An event for each change of a symbol's direction, none for its first. The state is the last
    direction and the history of the last 60; ticks of a micro-batch are taken in time order."""

    def run(key, frames, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last, past = state.get if state.exists else (None, [])
        past, out = list(past), []
        for row in rows.itertuples():
            if last is not None and row.dir != last:
                out.append((key[0], row.event_id, last, row.dir))
            last = row.dir
            past.append(row.dir)
        state.update((last, past[-HISTORY:]))
        yield pd.DataFrame(out, columns=["symbol", "event_id", "was", "dir"])

    rows = stream.select(F.col("event_type").alias("symbol"), "ts", "event_id", direction(F.col("value")).alias("dir"))
    return rows.groupBy("symbol").applyInPandasWithState(
        run, "symbol string, event_id long, was string, dir string", "last string, past array<string>", "append", GroupStateTimeout.NoTimeout
    )


def drained(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, written with exactly-once file commits and read again."""
    path, schema = shared_path(spark, name), out.schema
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def each_batch(stream: DataFrame, signal: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Evaluates closed bars of each micro-batch; the sink gets the signals and the batch number,
    so that a repeated batch can be told."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(signal(df), n)).option("checkpointLocation", checkpoint).start()
