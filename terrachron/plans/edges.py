"""Queries of the outer layer: polygons, stacks, provinces and windows of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons as pg
from ..sources import sinks
from ..sources.provinces import TABLE, provinces
from ..streaming import windows as win
from . import runs  # noqa: F401  registers its queries
from . import standins as st
from .catalog import ORACLES, QUERIES, query
from .standins import rounded, rounded_sql

__all__ = ["ORACLES", "QUERIES"]


def _events(spark, sf):
    return st.table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


@query(f"with {st.PARCELS} select id, cast((x2 - x1) * (y2 - y1) as double) area, cast(2 * ((x2 - x1) + (y2 - y1)) as double) perimeter from parcels")
def polygon_measures(spark, sf):
    p = st.parcels(spark, sf).select("id", pg.measures(pg.box("x1", "y1", "x2", "y2")).alias("m"))
    return p.select("id", "m.area", "m.perimeter")


@query(f"with {st.PARCELS} select id, cast(greatest(0, least(x2, 700) - greatest(x1, 300)) * greatest(0, least(y2, 600) - greatest(y1, 200)) as double) area from parcels")
def polygon_clip(spark, sf):
    p = st.parcels(spark, sf).withColumn("part", pg.clipped(pg.box("x1", "y1", "x2", "y2"), 300, 200, 700, 600))
    return p.select("id", pg.measures("part")["area"].alias("area"))


@query("select p_brand file, p_partkey band_index, row_number() over (order by p_brand, p_partkey) stack_index from part")
def part_stack_layout(spark, sf):
    return sinks.stacked(st.table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("band_index")))


_REGIONS = "provinces(number, region) as (values " + ", ".join("({}, '{}')".format(*(lambda w: (w[0], w[2]))(line.split())) for line in TABLE.strip().splitlines()) + ")"


@query(f"with {_REGIONS} select region, count(*) n from supplier join provinces on number = s_suppkey % 50 + 1 group by region")
def province_regions(spark, sf):
    p = F.broadcast(provinces(spark))
    s = st.table(spark, sf, "supplier").select((F.col("s_suppkey") % 50 + 1).alias("number"))
    return s.join(p, "number").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"select event_type, time_bucket(interval 5 days, ts, timestamp '1970-01-01') as start, count(value) n, {rounded_sql('avg(value)')} mean, max(value) highest from events group by 1, 2")
def event_windows(spark, sf):
    return win.binned(_events(spark, sf), ["event_type"], "value").select("event_type", "start", "n", rounded("mean").alias("mean"), "highest")


@query(
    "with apart as (select *, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end b from events window w as (partition by user_id order by ts)), "
    "told as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) g from apart) "
    "select user_id, min(ts) as first, max(ts) as last, count(*) n, max(value) highest from told group by user_id, g"
)
def event_runs(spark, sf):
    return win.runs(_events(spark, sf), ["user_id"], "value", gap="6 hours")
