"""Windows over streams of observations. The same functions serve static tables, where watermarks have no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(observed: DataFrame, keys: list[str], value: str, *, width: str = "5 days", late: str = "10 days", start: str | None = None) -> DataFrame:
    """keys, start, n, mean, highest of each tumbling window. Rows later than the watermark are dropped from streams only."""
    window = F.window("ts", width, width, start) if start else F.window("ts", width)
    grouped = observed.withWatermark("ts", late).groupBy(*keys, window.alias("w"))
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest")).select(*keys, F.col("w.start").alias("start"), "n", "mean", "highest")


def sliding(observed: DataFrame, keys: list[str], value: str, *, width: str = "10 days", step: str = "5 days", late: str = "10 days") -> DataFrame:
    """keys, start, n, mean of overlapping windows."""
    grouped = observed.withWatermark("ts", late).groupBy(*keys, F.window("ts", width, step).alias("w"))
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def runs(observed: DataFrame, keys: list[str], value: str, *, gap: str = "5 days", late: str = "10 days") -> DataFrame:
    """keys, first, last, n, highest of runs of observations less than a gap apart: the growth intervals of a stream."""
    grouped = observed.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max(value).alias("highest")).drop("w")
