"""Bars from a stream of events, and the generations of a search as micro-batches into the store.

The engine's operators are batch; these are the two ends at which it meets a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import store


def streamed_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a fixed width, each emitted once the watermark has passed it."""
    price = (F.lit(1000.0) + F.col("value") / 10.0).cast("float")
    at = F.struct("ts", "event_id")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("price", price).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("volume")
    )
    return out.select(F.col("w")["start"].alias("ts"), "open", "high", "low", "close", "volume")


def into_store(kept: store.Store):
    """A foreachBatch function that upserts strategy rows, one atomic version for each batch."""
    return lambda batch, _: kept.upsert(batch)
