"""Gap filling and smoothing of series, by window functions over one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timegrid import resampled

#: Quadratic smoothing over five points; rows for the first two points, the inner ones and (mirrored) the last two.
SMOOTH_EDGE = (31, 9, -3, -5, 3)
SMOOTH_NEXT = (9, 13, 12, 6, -5)
SMOOTH_INNER = (-3, 12, 17, 12, -3)


def interpolated(grid: DataFrame, key: str, values: list[str], *, extrapolate: bool = True) -> DataFrame:
    """Fill zeros and nulls between the nearest known samples on a line; outside, the first or last segment goes on. Fewer than two samples: null where unknown."""
    out = grid
    for v in values:
        known = F.coalesce(F.col(v) != 0, F.lit(False))
        by_kind = Window.partitionBy(key, f"_{v}_known").orderBy("pos")
        point = F.struct(F.col("pos").alias("x"), F.col(v).alias("y"))
        out = out.withColumn(f"_{v}_known", known)
        out = out.withColumn(f"_{v}", F.when(known, F.struct(point.alias("here"), F.lag(point).over(by_kind).alias("before"), F.lead(point).over(by_kind).alias("after"))))
    order = Window.partitionBy(key).orderBy("pos")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    out = out.select("*", *(F.last(f"_{v}", ignorenulls=True).over(back).alias(f"_{v}_l") for v in values), *(F.first(f"_{v}", ignorenulls=True).over(ahead).alias(f"_{v}_r") for v in values))

    def filled(v: str) -> Column:
        left, right = F.col(f"_{v}_l"), F.col(f"_{v}_r")
        a = F.when(left.isNull(), right["here"]).when(right.isNull(), left["before"]).otherwise(left["here"])
        b = F.when(left.isNull(), right["after"]).when(right.isNull(), left["here"]).otherwise(right["here"])
        line = a["y"] + (F.col("pos") - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
        if not extrapolate:
            line = F.when(left.isNull(), F.lit(None)).when(right.isNull(), left["here"]["y"]).otherwise(line)
        return F.when(F.col(f"_{v}_known"), F.col(v)).otherwise(line)

    hidden = {c for v in values for c in (f"_{v}", f"_{v}_known", f"_{v}_l", f"_{v}_r")}
    return out.select(*(filled(c).alias(c) if c in values else c for c in out.columns if c not in hidden))


def smoothed(grid: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Quadratic smoothing over five points, with the fitted parabola at both ends; series of under five points stay."""
    order = Window.partitionBy(key).orderBy("pos")
    all_ = Window.partitionBy(key)
    at, n = F.row_number().over(order), F.count(F.lit(1)).over(all_)

    def weighted(v: str, weights: tuple[int, ...], first: int) -> Column:
        terms = [w * (F.lag(v, -(first + k)).over(order) if first + k < 0 else F.lead(v, first + k).over(order) if first + k > 0 else F.col(v)) for k, w in enumerate(weights)]
        return sum(terms[1:], terms[0]) / 35

    def value(v: str) -> Column:
        return (
            F.when(F.col("_n") < 5, F.col(v))
            .when(F.col("_at") == 1, weighted(v, SMOOTH_EDGE, 0))
            .when(F.col("_at") == 2, weighted(v, SMOOTH_NEXT, -1))
            .when(F.col("_at") == F.col("_n"), weighted(v, SMOOTH_EDGE[::-1], -4))
            .when(F.col("_at") == F.col("_n") - 1, weighted(v, SMOOTH_NEXT[::-1], -3))
            .otherwise(weighted(v, SMOOTH_INNER, -2))
        )

    out = grid.withColumn("_at", at).withColumn("_n", n)
    return out.select(*(value(c).alias(c) if c in values else c for c in grid.columns))


def mean_series(series: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Bins of five days, gaps filled within, smoothed, rounded half to even."""
    out = smoothed(interpolated(resampled(series, key, values), key, values, extrapolate=False), key, values)
    return out.select(*(F.rint(c).alias(c) if c in values else c for c in out.columns))

