"""Tracking rows as a stream: gap segments as session windows, late rows up to a watermark. An extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "match_id string, player_id string, period_id int, timestamp double, x double, y double, at timestamp"


def arriving(spark: SparkSession, path: str, rows_schema: str = ROWS) -> DataFrame:
    """JSONL files of tracking rows as they arrive; `at` is the time of each row."""
    return spark.readStream.schema(rows_schema).json(path)


def live_segments(rows: DataFrame, gap_seconds: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """A row for each segment of a track that no row prolongs any more: first, last, samples and extent."""
    gap = f"{int(gap_seconds * 1000)} milliseconds"
    return (
        rows.withWatermark("at", late)
        .groupBy("match_id", "player_id", "period_id", F.session_window("at", gap))
        .agg(
            F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("samples"),
            F.min("x").alias("least_x"), F.max("x").alias("most_x"),
        )
        .drop("session_window")
    )
