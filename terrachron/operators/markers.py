"""Stability markers: yearly angles, growth intervals, annual cycle, class."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import angle_flag, stability_class
from .series import interpolated, smoothed
from .timegrid import STEP_DAYS, aligned

YEAR_STEPS = 73
LEAST_ANGLE_INDEX = 7000


@dataclass(frozen=True)
class Thresholds:
    angle: float = 0.4
    days: float = 60
    productivity: float = 10000


def smooth_series(series: DataFrame, key: str = "id") -> DataFrame:
    """Grid, gaps filled, smoothed: ndvi, ar and as1 of each unit."""
    values = ["ndvi", "ar", "as1"]
    grid = aligned(series, key, values, floors={"ar": LEAST_ANGLE_INDEX, "as1": LEAST_ANGLE_INDEX})
    return smoothed(interpolated(grid, key, values), key, values)


def angle_pairs(grid: DataFrame, key: str = "id", value: str = "ndvi") -> DataFrame:
    """key, i, j, angle between the years i < j, years being blocks of 73 steps from the first; the rest is dropped."""
    size = Window.partitionBy(key)
    blocks = grid.select(key, F.floor(F.col("pos") / YEAR_STEPS).cast("int").alias("blk"), (F.col("pos") % YEAR_STEPS).cast("int").alias("step"), F.col(value).alias("v"), F.floor(F.count(F.lit(1)).over(size) / YEAR_STEPS).alias("n"))
    whole = blocks.filter("blk < n and not isnan(v)").select(key, "blk", "step", "v")
    # a year is an array of steps, so pairs of years are joined once a unit, and not once a step
    years = whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("blk", "step", "v"))).alias("y"))
    per = years.select(key, F.explode(F.array_distinct(F.transform("y", lambda s: s["blk"]))).alias("blk"), "y").select(key, "blk", F.filter("y", lambda s: s["blk"] == F.col("blk")).alias("y"))
    left = per.select(key, F.col("blk").alias("i"), F.map_from_entries(F.transform("y", lambda s: F.struct(s["step"], s["v"]))).alias("a"))
    right = per.select(F.col(key).alias("_key"), F.col("blk").alias("j"), F.map_from_entries(F.transform("y", lambda s: F.struct(s["step"], s["v"]))).alias("b"))
    pairs = left.join(right, (F.col(key) == F.col("_key")) & (F.col("i") < F.col("j"))).drop("_key")

    def total(terms):
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    steps = F.sequence(F.lit(0), F.lit(YEAR_STEPS - 1))
    a, b = (lambda k, c=c: F.element_at(c, k) for c in ("a", "b"))
    dot = total(F.transform(steps, lambda k: a(k) * b(k)))
    norm = F.sqrt(total(F.transform(steps, lambda k: a(k) * a(k)))) * F.sqrt(total(F.transform(steps, lambda k: b(k) * b(k))))
    measured = pairs.select(key, "i", "j", dot.alias("dot"), norm.alias("norm"))
    return measured.select(key, "i", "j", F.when(F.col("norm") == 0, F.lit(math.pi / 2)).otherwise(F.acos(F.try_divide("dot", "norm"))).alias("angle"))


def growth_intervals(grid: DataFrame, key: str = "id") -> DataFrame:
    """key, grp, start, end, days, amplitude of the runs of positive signal (ar - as1). A run breaks before its k-th known step only from k = 2 on, and the step k = 1 never lengthens a run."""
    signal = grid.select(key, "pos", "ts", F.when(F.isnan("ar") | F.isnan("as1"), None).otherwise(F.greatest(F.col("ar") - F.col("as1"), F.lit(0.0))).alias("s"))
    order = Window.partitionBy(key).orderBy("pos")
    known = signal.filter("s > 0").withColumn("k", F.row_number().over(order) - 1).withColumn("gap", F.col("pos") - F.lag("pos").over(order))
    marked = known.withColumn("grp", F.sum(F.when((F.col("k") >= 2) & (F.col("gap") != 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.coalesce(F.max(F.when(F.col("k") != 1, F.col("pos"))), F.min("pos"))
    runs = marked.groupBy(key, "grp").agg(F.min("pos").alias("p0"), last.alias("p1"), F.min("ts").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("points"))
    top = F.array_max(F.transform(F.filter("points", lambda p: p["pos"] <= F.col("p1")), lambda p: p["s"]))
    return runs.select(key, F.col("grp").cast("int").alias("grp"), "start", F.date_add("start", ((F.col("p1") - F.col("p0")) * STEP_DAYS).cast("int")).alias("end"), ((F.col("p1") - F.col("p0")) * STEP_DAYS).cast("int").alias("days"), top.alias("amplitude"))


def annual_cycle(intervals: DataFrame, years: DataFrame, key: str = "id", *, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """key, cycle: 'c' and, for each calendar year of years(key, y0, y1), how many intervals start or end in it, last longer than the threshold (and under 365 days) and are more productive."""
    spine = years.select(key, F.explode(F.sequence("y0", "y1")).alias("year"))
    good = intervals.filter((F.col("days") > thresholds.days) & (F.col("days") < 365) & (F.col("amplitude") > thresholds.productivity))
    touched = good.select(key, F.explode(F.array_distinct(F.array(F.year("start"), F.year("end")))).alias("year")).groupBy(key, "year").count()
    counted = spine.join(touched, [key, "year"], "left").select(key, "year", F.coalesce("count", F.lit(0)).alias("n"))
    digits = F.transform(F.sort_array(F.collect_list(F.struct("year", "n"))), lambda x: x["n"].cast("string"))
    return counted.groupBy(key).agg(F.concat(F.lit("c"), F.array_join(digits, "")).alias("cycle"))


def markers(series: DataFrame, key: str = "id", *, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """key, angles, cycle, flag, status of each unit."""
    grid = smooth_series(series, key)
    years = grid.groupBy(key).agg(F.year(F.min("ts")).alias("y0"), F.year(F.max("ts")).alias("y1"))
    pairs = angle_pairs(grid, key).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "angle"))), lambda x: x["angle"]).alias("angles"))
    cycle = annual_cycle(growth_intervals(grid, key), years, key, thresholds=thresholds)
    joined = cycle.join(pairs, key, "left").withColumn("angles", F.coalesce("angles", F.array().cast("array<double>")))
    flagged = joined.withColumn("flag", angle_flag(F.col("angles"), thresholds.angle))
    return flagged.select(key, "angles", "cycle", "flag", stability_class(F.col("cycle"), F.col("flag")).alias("status"))


def sigma_clip(values: DataFrame, column: str, sigma: float) -> tuple[float | None, float | None, int]:
    """Mean, population deviation and rounds after dropping, again and again, what is not strictly within sigma deviations of the mean. Each round is one aggregation; only three numbers reach the driver."""
    v = F.col(column).cast("double")
    kept = values.select(v.alias("v")).filter("v is not null and not isnan(v)").persist()
    try:
        return _clipped(kept, sigma)
    finally:
        kept.unpersist()


def _clipped(kept: DataFrame, sigma: float) -> tuple[float | None, float | None, int]:
    mean, dev, n = kept.agg(F.avg("v"), F.stddev_pop("v"), F.count("v")).first()
    lo, hi = -math.inf, math.inf
    for round_ in itertools.count(1):  # every round but the last drops a value, so it ends
        if not n:
            return None, None, round_
        lo, hi = max(lo, mean - sigma * dev), min(hi, mean + sigma * dev)
        mean2, dev2, n2 = kept.filter((F.col("v") > lo) & (F.col("v") < hi)).agg(F.avg("v"), F.stddev_pop("v"), F.count("v")).first()
        if n2 == n:
            return mean2, dev2, round_
        mean, dev, n = mean2, dev2, n2


def calibrate(pairs: DataFrame, intervals: DataFrame) -> Thresholds:
    """Thresholds from the angles (mean and two deviations, clipped at 2), days (mean, 2.5) and amplitudes (mean, 2), to two decimals."""
    mean, dev, _ = sigma_clip(pairs, "angle", 2)
    days, _, _ = sigma_clip(intervals, "days", 2.5)
    amplitude, _, _ = sigma_clip(intervals, "amplitude", 2)
    rounded = lambda x: math.nan if x is None else round(x, 2)
    return Thresholds(rounded(None if mean is None else mean + 2 * dev), rounded(days), rounded(amplitude))
