"""Composed runs: overlays with states, indices by feature, tables of indices to markers, markers by province."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, spectral
from . import markers as m
from . import spatial as sp

INDICES = ("ndvi", "ar", "as1")
CASTS = {"ndvi": spectral.int16, "as1": spectral.int16, "ar": spectral.uint16}


def declared_pieces(parcels: DataFrame, lines: DataFrame, *, size: int = 2) -> DataFrame:
    """id, lid, area, state of the pieces of the union overlay of parcels(id) and lines(lid, use, product, incidence), each cleaned before. Pieces without a line have the state of a missing product."""
    pieces = sp.overlay(sp.cleaned(parcels, "id"), sp.cleaned(lines, "lid"), "id", "lid", size=size)
    told = lines.select("lid", codes.state(F.col("use"), F.col("product"), F.col("incidence")).alias("state"))
    none = codes.state(F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string"))
    return pieces.join(told, "lid", "left").select("id", "lid", "area", F.coalesce("state", none).alias("state"))


def feature_indices(pixels: DataFrame, zones: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, day and the mean indices over the pixels (x, y) of each feature's box, from start until before end. Ground that isn't clear counts as 0, in the index too; means are cast as their index is."""
    bands = {c: F.col(c) for c in pixels.columns if c.startswith("b")}
    seen = pixels.filter((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    values = seen.select("x", "y", "day", *(spectral.masked(spectral.index(i, bands), F.col("scl"), cloud="zero").alias(i) for i in INDICES))
    # features of the same boxes have the same means, which are worked out once
    members, shapes = sp.shape_classes(zones, key)
    means = sp.holding(values, shapes, "_first").groupBy("_first", "day").agg(*(CASTS[i](F.avg(i)).alias(i) for i in INDICES))
    nameless = sp.holding(values, zones.filter(F.col(key).isNull()), key).groupBy(key, "day").agg(*(CASTS[i](F.avg(i)).alias(i) for i in INDICES))
    columns = [key, "day", *INDICES]
    return means.join(members, "_first").select(columns).unionByName(nameless.select(columns))


def joined_indices(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Wide tables, one an index, side by side for the keys that all have; columns get the index as suffix. Tables of unequal length are an error."""
    counts = {name: t.count() for name, t in tables.items()}
    if len(set(counts.values())) > 1:
        raise ValueError(f"tables of unequal length: {counts}")
    named = [t.select(key, *(F.col(f"`{c}`").alias(f"{c}_{name}") for c in t.columns if c != key)) for name, t in tables.items()]
    out = named[0]
    for t in named[1:]:
        out = out.join(t, key)
    return out


def with_final_columns(found: DataFrame, wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    """found with each named column: its own, else the values of wide's columns that end in _name, joined by commas, else 0."""
    lacking = [n for n in names if n not in found.columns]
    columns = {n: [F.col(f"`{c}`").cast("string") for c in wide.columns if c.endswith(f"_{n}")] for n in lacking}
    filled = wide.select(key, *(F.concat_ws(",", *c).alias(n) for n, c in columns.items() if c))
    out = found.join(filled, key, "left")
    return out.select("*", *(F.lit(0).alias(n) for n, c in columns.items() if not c))


def province_markers(series: DataFrame, units: DataFrame, wide: DataFrame, *, key: str = "id", thresholds: m.Thresholds = m.Thresholds(), final: list[str] = list(INDICES)) -> DataFrame:
    """Markers of every unit of units(key, province), with the final columns: one run over all provinces, to be dealt by province when written."""
    found = units.select(key, "province").join(m.markers(series, key, thresholds=thresholds), key)
    return with_final_columns(found, wide, key, final)


def folder_markers(tables: DataFrame, key: str, *, thresholds: m.Thresholds = m.Thresholds()) -> DataFrame:
    """Markers of the units of several wide tables (columns <yyyyMMdd>T_INDEX and file_name); a unit is named by its file and key."""
    from ..sources.readers import long_from_wide

    named = tables.withColumn("unit", F.concat_ws("-", "file_name", key))
    out = None
    for i in INDICES:
        one = long_from_wide(named.drop(key, "file_name"), "unit", i).withColumnRenamed("value", i)
        out = one if out is None else out.join(one, ["id", "ts"])
    return m.markers(out, thresholds=thresholds)
