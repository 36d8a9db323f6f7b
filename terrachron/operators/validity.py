"""Campaign windows and validity of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def campaign_windows(campaigns: DataFrame) -> DataFrame:
    """region, year, first, last: from a campaign's start to the next year's, or to the end of the next year where none is set."""
    order = Window.partitionBy("region").orderBy("year")
    following = F.when(F.lead("year").over(order) == F.col("year") + 1, F.lead("start_date").over(order))
    return campaigns.select("region", "year", F.col("start_date").alias("first"), F.coalesce(following, F.make_date(F.col("year") + 1, F.lit(12), F.lit(31))).alias("last"))


def valid_version(start: Column, end: Column, first: Column, last: Column) -> Column:
    """Began by the window's end, and ended within it or not yet. Versions that end later don't count."""
    return (start <= last) & (end.between(first, last) | end.isNull())


def valid_pairs(versions: list[tuple[Column, Column]], first: Column, last: Column) -> Column:
    """Every (start, end) of a row is valid, as for a parcel and its geometry."""
    valid = F.lit(True)
    for start, end in versions:
        valid = valid & valid_version(start, end, first, last)
    return valid


def closed(end: Column, year: Column) -> Column:
    """Day a version ends; the last day of the year for one that is open."""
    return F.coalesce(end.cast("date"), F.make_date(year, F.lit(12), F.lit(31)))


def with_geometry(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows that have a geometry, with their days as text (yyyy-MM-dd), as files of areas hold them."""
    kept = rows.filter(F.col(geometry).isNotNull())
    return kept.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in kept.dtypes))


def valid_line(start: Column, end: Column, first: Column, last: Column, *, mode: str = "frame") -> Column:
    """The same for declaration lines; in 'frame' mode open lines count whenever they began."""
    return ((start <= last) & end.between(first, last)) | end.isNull() if mode == "frame" else (start <= last) & (end.between(first, last) | end.isNull())
