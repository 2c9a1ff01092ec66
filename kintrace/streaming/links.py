"""Pair counts and first days kept up to date over a stream of award rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_pair_counts(rows: DataFrame) -> DataFrame:
    """Rows, sum and first day of each (entity, parent) so far; for the update or complete mode."""
    return rows.groupBy("uei", "puei").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amt"), F.min("day").alias("first_day"))


def windowed_spend(rows: DataFrame, time: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Money per entity and window of event time; state is dropped once rows that late are past."""
    timed = rows.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("window"), "uei").agg(F.sum("amount").alias("amt"), F.count(F.lit(1)).alias("n"))


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run to the end of what is there, into a table in memory."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
