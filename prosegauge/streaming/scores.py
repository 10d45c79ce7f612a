"""Scores over streams (an extension): every scorer is a projection, so the batch code is reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.operators.scoring import with_slop


def scored_stream(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """Slop of each arriving text; stateless."""
    return with_slop(texts, text_column)


def rolling_slop(texts: DataFrame, time_column: str = "ts", length: str = "10 minutes", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Mean slop in tumbling (or sliding) windows of event time; texts that are too late are left out."""
    window = F.window(time_column, length, slide) if slide else F.window(time_column, length)
    return scored_stream(texts).withWatermark(time_column, late).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg("slop").alias("slop"))
