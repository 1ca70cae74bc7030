"""Streams of triples and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, key, n) by tumbling window; the watermark bounds the state. Works on batches and streams alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_deliveries(triples: DataFrame, late: str = "60 days") -> DataFrame:
    """Triples without repeated deliveries; on a stream, repeats are known within the watermark."""
    keys = ["triple_id", "head", "tail", "relation", "extracted_at", "loaded_at"]
    if triples.isStreaming:
        return triples.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(keys)
    return triples.dropDuplicates(keys)
