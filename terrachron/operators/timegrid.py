"""Operators on the time axis. A grid is a row for each step; nothing is iterated on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP_DAYS = 5
#: Days of a batch by resolution in metres.
BATCH_DAYS = {10: 40, 20: 180}


def date_grid(spark: SparkSession, start: str, end: str, step: int = STEP_DAYS) -> DataFrame:
    """ts: every step-th day from start to end, both included."""
    return spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {int(step)} days)) as ts")


def grids(series: DataFrame, key: str, step: int = STEP_DAYS) -> DataFrame:
    """key, pos, ts: the grid of each series, from its first day on."""
    span = series.groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return span.select(key, F.posexplode(F.sequence("lo", "hi", F.make_dt_interval(F.lit(step)))).alias("pos", "ts"))


def aligned(series: DataFrame, key: str, values: list[str], *, floors: dict[str, float] | None = None) -> DataFrame:
    """Values on the grid: absent steps are 0, days off the grid are dropped, and values under their floor count as absent. Of several rows of a day the first counts, in the order of the values, nulls first."""
    once = series.groupBy(key, "ts").agg(F.min(F.struct(*values)).alias("_row")).select(key, "ts", "_row.*")
    out = grids(series, key).join(once, [key, "ts"], "left")
    kept = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    for v, least in (floors or {}).items():
        kept[v] = F.when(kept[v] < least, 0.0).otherwise(kept[v])
    return out.select(key, "pos", "ts", *(c.alias(v) for v, c in kept.items()))


def grid_start(first: Column, start: Column, step: int = STEP_DAYS) -> Column:
    """Start of the grid that keeps the phase of the first acquisition: whole steps back from it, as near to start as possible."""
    gap = F.datediff(first, start)
    return F.when(gap > step, F.date_sub(first, (F.floor(gap / step) * step).cast("int"))).otherwise(first)


def missing_dates(items: DataFrame, key: str, start: str, end: str, step: int = STEP_DAYS) -> DataFrame:
    """key, ts: days of each key's grid on which nothing was acquired."""
    within = items.select(key, F.to_date("ts").alias("ts")).filter(F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).distinct()
    first = within.groupBy(key).agg(F.min("ts").alias("first"))
    grid = first.select(key, F.explode(F.sequence(grid_start(F.col("first"), F.lit(start).cast("date"), step), F.lit(end).cast("date"), F.make_dt_interval(F.lit(step)))).alias("ts"))
    return grid.join(within, [key, "ts"], "left_anti")


def with_missing_frames(frames: DataFrame, keys: list[str], start: str, end: str, bands: list[str], step: int = STEP_DAYS) -> DataFrame:
    """frames(keys, ts, bands, scl) and, for each place and each day of the grid that it has no frame on, one of zeros with scl 0, which masks take for no clear ground."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(step)))
    spine = frames.select(*keys).distinct().withColumn("ts", F.explode(days))
    absent = spine.join(frames.select(*keys, "ts"), [*keys, "ts"], "left_anti")
    kinds = dict(frames.dtypes)
    zeros = absent.select(*keys, "ts", *(F.lit(0).cast(kinds[c]).alias(c) for c in (*bands, "scl")))
    return frames.select(*keys, "ts", *bands, "scl").unionByName(zeros)


def batches(spark: SparkSession, start: str, end: str, days: int, cut: str) -> DataFrame:
    """first, last: ranges of at most `days` days, none across the cut; each starts the day after the one before it ends."""
    sql = f"""
        with parts as (
            select date'{start}' as lo, least(date'{end}', date_sub(date'{cut}', 1)) as hi
            union all select greatest(date'{start}', date'{cut}'), date'{end}'
        )
        select first, least(date_add(first, {int(days)}), hi) as last
        from (select hi, explode(sequence(lo, hi, interval {int(days) + 1} days)) as first from parts where lo <= hi)
    """
    return spark.sql(sql)


def resampled(series: DataFrame, key: str, values: list[str], step: int = STEP_DAYS) -> DataFrame:
    """Means of bins of `step` days from each series' first day; empty bins are null."""
    first = Window.partitionBy(key)
    binned = series.withColumn("_lo", F.min("ts").over(first)).withColumn("pos", F.floor(F.datediff("ts", "_lo") / step).cast("int"))
    means = binned.groupBy(key, "pos").agg(F.min("_lo").alias("_lo"), *(F.avg(v).alias(v) for v in values))
    spine = means.groupBy(key).agg(F.max("pos").alias("last"), F.min("_lo").alias("_lo")).select(key, "_lo", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("pos"))
    out = spine.join(means.drop("_lo"), [key, "pos"], "left")
    return out.select(key, "pos", F.date_add("_lo", F.col("pos") * step).alias("ts"), *values)
