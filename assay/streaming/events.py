"""Streaming forms of row checks and of the run's event log.

State is bounded by the watermark: counters of closed windows and ids older than
the delay are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.completeness import blanks


def blank_counts(stream: DataFrame, time: str, columns: Sequence[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, rows, and the blanks of each column as <column>_empty) of each event-time window."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    out = w.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(f"{c}_empty") for c, t in blanks(stream, columns).items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", *[f"{c}_empty" for c in columns])


def duplicates_dropped(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def events_since(log: DataFrame, seq: int) -> DataFrame:
    """The events of an ordered log (seq, ...) from a sequence number on; a log file read by readStream works alike."""
    return log.where(F.col("seq") >= seq)
