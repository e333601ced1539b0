"""Temporal rules over a transfer stream. The same functions run over stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, SLIDE = "10 minutes", "1 minute"
MIN_COUNT = 5
CEILING = 49_999.0


def bursts(events: DataFrame, span: str = SPAN, slide: str = SLIDE, min_count: int = MIN_COUNT,
           ceiling: float = CEILING) -> DataFrame:
    """Windows in which an account sent ``min_count`` or more transfers, all below ``ceiling``.

    Counts are combined before the shuffle, so a busy sender costs one row per window and task.
    """
    return (
        events.groupBy(F.window("ts", span, slide).alias("span"), "src")
        .agg(F.count("*").alias("transfers"), F.max("amount").alias("largest"), F.sum("amount").alias("total"))
        .where((F.col("transfers") >= min_count) & (F.col("largest") < ceiling))
        .select("src", F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
                "transfers", "largest", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per sender: transfers at most ``gap`` apart."""
    return (
        events.groupBy(F.session_window("ts", gap).alias("span"), "src")
        .agg(F.count("*").alias("transfers"), F.sum("amount").alias("total"))
        .select("src", F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "transfers", "total")
    )
