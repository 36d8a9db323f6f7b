"""Queries of composed runs, and of operators through the library's own functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, spectral
from ..operators import chains
from ..operators import markers as m
from ..operators import series as ser
from ..operators import spatial as sp
from ..operators import timegrid as tg
from ..operators import validity as val
from ..sources import readers, sinks
from . import standins as st
from .catalog import _COMMON, _STRINGS, _WINDOWS, _YEARLY, INDEX_SQL, MARKERS, ORACLES, THRESHOLDS, _cells, _sg, _sql_int, _state_sql, crono_strings, query, smooth

_CLOUDS = "0, 1, 2, 3, 8, 9, 10, 11"
_SECOND = 'd0 + 45 <= "last" and (d1 + 300 between "first" and "last" or d1 is null)'


@query(f'with {_WINDOWS}, {st.VERSIONS} select id, region, "year" from versions join windows using (region) where d0 <= "last" and (d1 between "first" and "last" or d1 is null) and {_SECOND}')
def parcel_validity(spark, sf):
    v = st.versions(spark, sf).join(F.broadcast(val.campaign_windows(st.campaigns(spark))), "region")
    pairs = [(F.col("d0"), F.col("d1")), (F.date_add("d0", 45), F.date_add("d1", 300))]
    return v.filter(val.valid_pairs(pairs, F.col("first"), F.col("last"))).select("id", "region", "year")


@query(f'with {_WINDOWS}, {st.VERSIONS} select id, "year", coalesce(d1, make_date("year", 12, 31)) as "end" from versions join windows using (region) where d0 <= "last" and (d1 between "first" and "last" or d1 is null)')
def closed_versions(spark, sf):
    v = st.versions(spark, sf).join(F.broadcast(val.campaign_windows(st.campaigns(spark))), "region")
    valid = v.filter(val.valid_version(F.col("d0"), F.col("d1"), F.col("first"), F.col("last")))
    return valid.select("id", "year", val.closed(F.col("d1"), F.col("year")).alias("end"))


@query(f"with {st.VERSIONS} select id, region geometry, cast(d0 as varchar) d0, cast(d1 as varchar) d1 from versions where region <> 'east'")
def geometry_present(spark, sf):
    v = st.versions(spark, sf).withColumn("geometry", F.when(F.col("region") != "east", F.col("region")))
    return val.with_geometry(v.select("id", "geometry", "d0", "d1"))


_ALL_USES = "AG|CA|CI|CO|ED|FO|FY|IM|IV|OF|OV|PA|PR|PS|TA|TH|VF|VI|VO|ZC|ZU|ZV|FS|FL|FV|IS|OC|CV|CF|CS|FF|EP|MT|OP"


@query(f"with {_YEARLY} select parcel, u_crono from ({_STRINGS}) where regexp_matches(u_crono, '{_ALL_USES}')")
def use_filter_all(spark, sf):
    return crono_strings(spark, sf).filter(codes.matches_use(F.col("u_crono"), ("TODOS",))).select("parcel", "u_crono")


_ONE = "1995-01-01"


@query(f"""with {st.PIXELS}, g as (select tile, cx, date '{_ONE}' + cast(30 * (("day" - date '{_ONE}') // 30) as integer) ts, b08, scl, row_number() over (partition by tile, cx, ("day" - date '{_ONE}') // 30 order by px, ln) r from pixels where "day" between date '{_ONE}' and date '1998-12-31'),
one as (select * from g where r = 1), spine as (select tile, cx, cast(unnest(range(date '{_ONE}', date '1999-01-01', interval 30 day)) as date) ts from (select distinct tile, cx from one))
select s.tile, s.cx, s.ts, coalesce(case when scl not in ({_CLOUDS}) then b08 end, 0) b08 from spine s left join one o on o.tile = s.tile and o.cx = s.cx and o.ts = s.ts""")
def missing_frames(spark, sf):
    p = st.pixels(spark, sf).filter(F.col("day").between(F.lit(_ONE).cast("date"), F.lit("1998-12-31").cast("date")))
    at = p.withColumn("ts", F.expr(f"date_add(date'{_ONE}', cast(30 * (datediff(day, date'{_ONE}') div 30) as int))"))
    one = at.groupBy("tile", "cx", "ts").agg(F.min(F.struct("px", "ln", "b08", "scl")).alias("f")).select("tile", "cx", "ts", "f.b08", "f.scl")
    every = tg.with_missing_frames(one, ["tile", "cx"], _ONE, "1998-12-31", ["b08"], 30)
    return every.select("tile", "cx", "ts", F.coalesce(spectral.masked(F.col("b08"), F.col("scl")), F.lit(0.0)).alias("b08"))


@query(f"with {st.PIXELS} select px, ln, b04 red, b01 b1, b08 b8, b12, scl, b09 nir_20m from pixels")
def band_members(spark, sf):
    p = st.pixels(spark, sf)
    bands = {c: F.col(c) for c in p.columns if c.startswith("b")} | {"scl": F.col("scl"), "b8a": F.col("b09")}
    return p.select("px", "ln", *(spectral.index(n, bands).alias(n) for n in ("red", "b1", "b8", "b12", "scl")), spectral.index("nir", bands, resolution=20).alias("nir_20m"))


@query(f"""with {st.PIXELS} select tile, cx, cy, "day", arg_min(b08, px * 8 + ln) filter (where scl not in ({_CLOUDS})) b08, arg_min(b04, px * 8 + ln) filter (where scl not in ({_CLOUDS})) b04 from pixels group by 1, 2, 3, 4""")
def same_day_merged(spark, sf):
    p = st.pixels(spark, sf).withColumn("ts", F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, 0, 0, cast(px * 8 + ln as decimal(18, 6)) / 1000000)"))
    seen = p.select("tile", "cx", "cy", "ts", *(spectral.masked(F.col(b), F.col("scl")).alias(b) for b in ("b08", "b04")))
    return readers.same_day_merged(seen, ["tile", "cx", "cy"], ["b08", "b04"])


_MEANS = """
r_ as (select user_id id, cast(ts as date) d, floor(value * 100) v from events), f_ as (select id, min(d) lo, max(d) hi from r_ group by id),
s_ as (select id, lo, cast(unnest(range(0, (hi - lo) // 5 + 1)) as integer) pos from f_), a_ as (select r_.id, cast((d - lo) // 5 as integer) pos, avg(v) y from r_ join f_ using (id) group by 1, 2),
bins as (select s_.id, s_.pos, lo + 5 * s_.pos ts, y from s_ left join a_ on a_.id = s_.id and a_.pos = s_.pos),
kn as (select id, pos x, y, row_number() over w k, lead(pos) over w x1, lead(y) over w y1 from bins where y <> 0 window w as (partition by id order by pos)),
pl as (select *, count(case when y <> 0 then 1 end) over (partition by id order by pos rows between unbounded preceding and current row) c from bins),
filled as (select p.id, 'v' v, p.pos, p.ts, case when p.y <> 0 then p.y when c = 0 then null when k.x1 is null then k.y else k.y + (p.pos - k.x) * (k.y1 - k.y) / (k.x1 - k.x) end y from pl p left join kn k on k.id = p.id and k.k = c)"""


@query(f"with {_MEANS}, {_sg().split('wide as')[0].rstrip().rstrip(',')} select id, pos, ts, round_even(y, 0) + 0.0::double v from smooth")
def mean_series(spark, sf):
    rows = st.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("ts"), F.floor(F.col("value") * 100).alias("v"))
    return ser.mean_series(rows, "id", ["v"]).select("id", "pos", "ts", (F.col("v") + 0.0).alias("v"))


@query(f"select (select angle from ({ORACLES['threshold_angle']})) angle, (select days from ({ORACLES['threshold_days']})) as days, (select productivity from ({ORACLES['threshold_productivity']})) productivity")
def calibrated_thresholds(spark, sf):
    grid = smooth(spark, sf)
    found = m.calibrate(m.angle_pairs(grid), m.growth_intervals(grid))
    return spark.createDataFrame([(found.angle, found.days, found.productivity)], "angle double, days double, productivity double")


@query("select c_nationkey id, '[' || string_agg(cast(y as varchar), ',' order by y) || ']' as years_ts from (select distinct c_nationkey, year(o_orderdate) y from orders join customer on o_custkey = c_custkey) group by 1")
def json_cells(spark, sf):
    rows = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return sinks.arrays_as_json(rows.groupBy(F.col("c_nationkey").alias("id")).agg(F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("years_ts")))


@query(f"with {st.PARCELS}, c as {_cells('parcels', 'id', ', product, ' + chr(34) + 'year' + chr(34))}, t as (select cx, cy, min(case when \"year\" = 2020 then product end) a, min(case when \"year\" = 2021 then product end) b from c group by 1, 2) select a || '_' || b crono, cast(4 * count(*) as bigint) area from t where a is not null and b is not null group by a, b")
def crono_inner(spark, sf):
    return sp.chronology_inner(st.parcels(spark, sf), [2020, 2021], "product")


def _cleaned(source: str, key: str) -> str:
    small = f"(select *, (x2 - x1) * (y2 - y1) area from {source} where 2 * ((x2 - x1) + (y2 - y1)) <= (x2 - x1) * (y2 - y1))"
    return f"""(select * from (select *, row_number() over (partition by x1, y1, x2, y2 order by {key}) r from {small} a
        where not exists (select 1 from {small} b where a.{key} <> b.{key} and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 and {_COMMON} > 0.01 * least(a.area, b.area) and a.area <= b.area)) where r = 1)"""


@query(f"""with {st.PARCELS}, {st.LINES}, pc as {_cleaned('parcels', 'id')}, lc as {_cleaned('lines', 'lid')}, a as {_cells('pc', 'id')}, b as {_cells('lc', 'lid')},
pieces as (select id, lid, cast(4 * count(*) as bigint) area from a full join b on a.cx = b.cx and a.cy = b.cy group by 1, 2)
select p.id, p.lid, p.area, {_state_sql('frame')} state from pieces p left join lines l on l.lid = p.lid""")
def declared_pieces(spark, sf):
    return chains.declared_pieces(st.parcels(spark, sf), st.lines(spark, sf))


@query(f"""with {st.PIXELS}, {st.PLOTS}, p as (select *, (px * 7 + ln * 131) % 1000 x, (px * 13 + ln * 57) % 1000 y from pixels where "day" >= date '1996-01-01' and "day" < date '1998-01-01'),
i as (select lid, "day", """ + ", ".join(f"case when scl in ({_CLOUDS}) then 0 else {INDEX_SQL[n]} end {n}" for n in ("ndvi", "ar", "as1")) + f""" from p join plots on x >= x1 and x < x2 and y >= y1 and y < y2),
k as (select lid, "day", avg(ndvi) ndvi, avg(ar) ar, avg(as1) as1 from i group by 1, 2)
select lid, "day", {_sql_int('ndvi', 16, True)} ndvi, {_sql_int('ar', 16, False)} ar, {_sql_int('as1', 16, True)} as1 from k""")
def feature_indices(spark, sf):
    p = st.pixels(spark, sf).withColumn("x", F.expr("(px * 7 + ln * 131) % 1000")).withColumn("y", F.expr("(px * 13 + ln * 57) % 1000"))
    return chains.feature_indices(p, st.plots(spark, sf), "lid", "1996-01-01", "1998-01-01")


_YEARS = range(1995, 1999)


def _wide(spark, sf, value):
    """id and the sum of each year, columns y<year>."""
    s = st.series(spark, sf).select("id", F.concat(F.lit("y"), F.year("ts")).alias("y"), value)
    return s.groupBy("id").pivot("y", [f"y{y}" for y in _YEARS]).sum(value)


@query(f"with {st.SERIES} select id, " + ", ".join(f"cast(sum(case when year(ts) = {y} then {v} end) as bigint) y{y}_{v}" for v in ("ar", "as1", "ndvi") for y in _YEARS) + " from series group by id")
def joined_indices(spark, sf):
    return chains.joined_indices({v: _wide(spark, sf, v) for v in ("ar", "as1", "ndvi")}, "id")


@query(f"""with {MARKERS}, sums as (select id, """ + ", ".join(f"cast(cast(sum(case when year(ts) = {y} then ndvi end) as bigint) as varchar) y{y}" for y in _YEARS) + f""" from series group by id)
select c.id, n_regionkey province, "cycle", flag, status, concat_ws(',', {', '.join(f'y{y}' for y in _YEARS)}) ndvi, 0 ar from classes c join nation on n_nationkey = c.id join sums s on s.id = c.id""")
def province_markers(spark, sf):
    units = st.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("province"))
    wide = chains.joined_indices({"ndvi": _wide(spark, sf, "ndvi")}, "id")
    return chains.province_markers(st.series(spark, sf), units, wide, thresholds=THRESHOLDS, final=["ndvi", "ar"]).drop("angles")
