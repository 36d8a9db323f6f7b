"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, spectral
from ..operators import markers as m
from ..operators import series as ser
from ..operators import spatial as sp
from ..operators import timegrid as tg
from ..operators import validity as val
from . import standins as st
from .standins import rounded, rounded_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VALUES = ["ndvi", "ar", "as1"]
#: The stand-in series are noisy and low; these thresholds give all three classes.
THRESHOLDS = m.Thresholds(angle=0.57, days=60, productivity=5200)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def long_series(s: DataFrame) -> DataFrame:
    return s.select("id", "pos", "ts", *(rounded(F.col(v).cast("double")).alias(v) for v in VALUES))


# series

GRID = st.SERIES + """,
ends_ as (select id, min(ts) lo, max(ts) hi from series group by id),
grid_ as (select id, cast(unnest(range(0, (hi - lo) // 5 + 1)) as integer) pos, lo from ends_),
grid as (select g.id, pos, lo + 5 * pos ts, coalesce(s.ndvi, 0)::double ndvi, case when coalesce(s.ar, 0) < 7000 then 0 else s.ar end::double ar,
         case when coalesce(s.as1, 0) < 7000 then 0 else s.as1 end::double as1 from grid_ g left join series s on g.id = s.id and s.ts = lo + 5 * pos)"""

LONG = GRID + """,
long_ as (unpivot (select id, pos, ts, ndvi, ar, as1 from grid) on ndvi, ar, as1 into name v value y),
knots as (select id, v, pos x, y, row_number() over (partition by id, v order by pos) k, count(*) over (partition by id, v) n,
          lead(pos) over (partition by id, v order by pos) x1, lead(y) over (partition by id, v order by pos) y1 from long_ where y <> 0),
placed as (select id, v, pos, ts, y, sum(case when y <> 0 then 1 else 0 end) over (partition by id, v order by pos rows between unbounded preceding and 1 preceding) c,
           sum(case when y <> 0 then 1 else 0 end) over (partition by id, v) n from long_),
filled as (select p.id, p.v, p.pos, p.ts, case when p.y <> 0 then p.y else k.y + (p.pos - k.x) * (k.y1 - k.y) / (k.x1 - k.x) end y
           from placed p left join knots k on p.id = k.id and p.v = k.v and k.k = least(greatest(coalesce(p.c, 0), 1), p.n - 1))"""


def _sg() -> str:
    def term(weights, first):
        names = []
        for k, w in enumerate(weights):
            at = first + k
            col = "y" if at == 0 else f"lead(y, {at}) over w" if at > 0 else f"lag(y, {-at}) over w"
            names.append(f"({w}) * {col}")
        return "(" + " + ".join(names) + ") / 35"

    return f"""
smooth as (select id, v, pos, ts, case when n < 5 then y when a = 1 then {term(ser.SMOOTH_EDGE, 0)} when a = 2 then {term(ser.SMOOTH_NEXT, -1)}
           when a = n then {term(ser.SMOOTH_EDGE[::-1], -4)} when a = n - 1 then {term(ser.SMOOTH_NEXT[::-1], -3)} else {term(ser.SMOOTH_INNER, -2)} end y
           from (select *, row_number() over (partition by id, v order by pos) a, count(*) over (partition by id, v) n from filled)
           window w as (partition by id, v order by pos)),
wide as (select id, pos, ts, max(case when v = 'ndvi' then y end) ndvi, max(case when v = 'ar' then y end) ar, max(case when v = 'as1' then y end) as1 from smooth group by id, pos, ts)"""


SMOOTH = LONG + "," + _sg()
PAIRS = SMOOTH + f""",
blocks as (select id, pos // 73 blk, pos % 73 step, ndvi v from (select *, count(*) over (partition by id) n from wide) where pos // 73 < n // 73),
pairs as (select l.id, cast(l.blk as integer) i, cast(r.blk as integer) j, sum(l.v * r.v) dot, sqrt(sum(l.v * l.v)) * sqrt(sum(r.v * r.v)) norm
          from blocks l join blocks r on l.id = r.id and l.step = r.step and l.blk < r.blk group by 1, 2, 3),
angles as (select id, i, j, case when norm = 0 then pi() / 2 else acos(dot / norm) end angle from pairs)"""
INTERVALS = SMOOTH + """,
sig as (select id, pos, ts, greatest(ar - as1, 0) s from wide),
known as (select *, row_number() over w - 1 k, pos - lag(pos) over w gap from sig where s > 0 window w as (partition by id order by pos)),
marked as (select *, sum(case when k >= 2 and gap <> 1 then 1 else 0 end) over (partition by id order by pos) grp from known),
runs as (select id, grp, min(pos) p0, coalesce(max(case when k <> 1 then pos end), min(pos)) p1, min(ts) t0 from marked group by id, grp),
intervals as (select r.id, cast(r.grp as integer) grp, t0 as "start", t0 + cast(5 * (p1 - p0) as integer) as "end", cast(5 * (p1 - p0) as integer) as days,
              (select max(s) from marked q where q.id = r.id and q.grp = r.grp and q.pos <= p1) amplitude from runs r)"""
CYCLE = INTERVALS + f""",
years as (select id, cast(unnest(range(year(min(ts)), year(max(ts)) + 1)) as bigint) y from wide group by id),
good as (select * from intervals where days > {THRESHOLDS.days} and days < 365 and amplitude > {THRESHOLDS.productivity}),
counts as (select y.id, y.y, count(g.id) n from years y left join good g on g.id = y.id and (year(g."start") = y.y or year(g."end") = y.y) group by 1, 2),
cycle as (select id, 'c' || string_agg(cast(n as varchar), '' order by y) as "cycle" from counts group by id)"""
MARKERS = CYCLE + "," + PAIRS.split(",\nblocks as")[1].join(["\nblocks as", ""]) + f""",
tam as (select id, list(angle order by i, j) angles, max(case when not isnan(angle) and angle > {THRESHOLDS.angle} then 1 else 0 end) f from angles group by id),
flags as (select c.id, "cycle", coalesce(angles, []) angles, coalesce(f, -1) flag, length(regexp_replace("cycle", '[^0]', '', 'g')) n0, length("cycle") - 1 n from cycle c left join tam using (id)),
classes as (select id, "cycle", angles, cast(flag as integer) flag, case when flag = -1 or n0 = n or (n0 >= n // 2 and flag = 1) then 'ROJO' when n0 > 0 then 'NARANJA' else 'VERDE' end status from flags)"""


def smooth(spark: SparkSession, sf: str) -> DataFrame:
    return m.smooth_series(st.series(spark, sf))


@query(f"with {GRID} select id, pos, ts, ndvi, ar, as1 from grid")
def grid_align_fill0(spark, sf):
    return tg.aligned(st.series(spark, sf), "id", VALUES, floors={"ar": 7000, "as1": 7000})


@query(f"with {LONG} select id, pos, ts, max(case when v = 'ndvi' then {rounded_sql('y')} end) ndvi, max(case when v = 'ar' then {rounded_sql('y')} end) ar, max(case when v = 'as1' then {rounded_sql('y')} end) as1 from filled group by 1, 2, 3")
def interp_linear(spark, sf):
    return long_series(ser.interpolated(grid_align_fill0(spark, sf), "id", VALUES))


@query(f"with {SMOOTH} select id, pos, ts, {rounded_sql('ndvi')} ndvi, {rounded_sql('ar')} ar, {rounded_sql('as1')} as1 from wide")
def series_smooth(spark, sf):
    return long_series(smooth(spark, sf))


_SG_ONLY = GRID + ", filled as (unpivot (select id, pos, ts, ndvi, ar, as1 from grid) on ndvi, ar, as1 into name v value y)," + _sg()


@query(f"with {_SG_ONLY} select id, pos, ts, {rounded_sql('ndvi')} ndvi, {rounded_sql('ar')} ar, {rounded_sql('as1')} as1 from wide")
def savgol_5_2(spark, sf):
    return long_series(ser.smoothed(grid_align_fill0(spark, sf), "id", VALUES))


@query(f"with {PAIRS} select id, i, j, {rounded_sql('angle')} angle from angles")
def temporal_angle_pairs(spark, sf):
    return m.angle_pairs(smooth(spark, sf)).select("id", "i", "j", rounded("angle").alias("angle"))


@query(f'with {INTERVALS} select id, grp, "start", "end", days, {rounded_sql("amplitude")} amplitude from intervals')
def growth_intervals(spark, sf):
    return m.growth_intervals(smooth(spark, sf)).select("id", "grp", "start", "end", "days", rounded("amplitude").alias("amplitude"))


@query(f'with {CYCLE} select id, "cycle" from cycle')
def annual_cycle(spark, sf):
    grid = smooth(spark, sf)
    years = grid.groupBy("id").agg(F.year(F.min("ts")).alias("y0"), F.year(F.max("ts")).alias("y1"))
    return m.annual_cycle(m.growth_intervals(grid), years, thresholds=THRESHOLDS)


def marked(spark, sf):
    return m.markers(st.series(spark, sf), thresholds=THRESHOLDS)


@query(f"with {MARKERS} select id, flag, len(angles) n_pairs from classes")
def tam_flag(spark, sf):
    return marked(spark, sf).select("id", "flag", F.size("angles").cast("long").alias("n_pairs"))


@query(f"with {MARKERS} select status, count(*) n from classes group by status")
def stability_class(spark, sf):
    return marked(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f'with {MARKERS} select id, "cycle", flag, status, {rounded_sql("list_max(angles)")} top_angle from classes')
def markers_full(spark, sf):
    return marked(spark, sf).select("id", "cycle", "flag", "status", rounded(F.array_max("angles")).alias("top_angle"))


def _clip(source: str, column: str, sigma: float, rounds: int = 12) -> str:
    sql = f"v0 as (select {column} v from {source})"
    for k in range(rounds):
        sql += f", b{k} as (select avg(v) mu, stddev_pop(v) sd from v{k}), v{k + 1} as (select v from v{k}, b{k} where v > mu - {sigma} * sd and v < mu + {sigma} * sd)"
    return sql + f", last_ as (select avg(v) mu, stddev_pop(v) sd from v{rounds})"


@query(f"with prices as (select cast(l_extendedprice as double) p from lineitem), {_clip('prices', 'p', 2.0, 40)} select {rounded_sql('mu', 2)} mean, {rounded_sql('sd', 2)} deviation from last_")
def sigma_clip(spark, sf):
    mean, dev, _ = m.sigma_clip(st.table(spark, sf, "lineitem"), "l_extendedprice", 2.0)
    return spark.createDataFrame([(mean, dev)], "mean double, deviation double").select(rounded("mean", 2).alias("mean"), rounded("deviation", 2).alias("deviation"))


@query(f"with {PAIRS}, {_clip('angles', 'angle', 2, 40)} select {rounded_sql('mu + 2 * sd', 2)} angle from last_")
def threshold_angle(spark, sf):
    mean, dev, _ = m.sigma_clip(m.angle_pairs(smooth(spark, sf)), "angle", 2)
    return spark.createDataFrame([(mean + 2 * dev,)], "angle double").select(rounded("angle", 2).alias("angle"))


@query(f"with {INTERVALS}, {_clip('intervals', 'days', 2.5, 40)} select {rounded_sql('mu', 2)} as days from last_")
def threshold_days(spark, sf):
    mean, _, _ = m.sigma_clip(m.growth_intervals(smooth(spark, sf)), "days", 2.5)
    return spark.createDataFrame([(mean,)], "days double").select(rounded("days", 2).alias("days"))


@query(f"with {INTERVALS}, {_clip('intervals', 'amplitude', 2, 40)} select {rounded_sql('mu', 2)} productivity from last_")
def threshold_productivity(spark, sf):
    mean, _, _ = m.sigma_clip(m.growth_intervals(smooth(spark, sf)), "amplitude", 2)
    return spark.createDataFrame([(mean,)], "productivity double").select(rounded("productivity", 2).alias("productivity"))


# time axis

@query("select cast(unnest(range(date '1995-01-03', date '2001-08-02', interval 5 day)) as date) ts")
def date_grid(spark, sf):
    return tg.date_grid(spark, "1995-01-03", "2001-08-01")


ITEMS = "items as (select o_orderpriority tile, cast(o_custkey % 3 as integer) orbit, cast(o_orderdate as date) ts from orders)"


def items(spark, sf):
    return st.table(spark, sf, "orders").selectExpr("o_orderpriority as tile", "cast(o_custkey % 3 as int) as orbit", "to_date(o_orderdate) as ts")


_CUSTOMER_DAYS = "items as (select o_custkey tile, cast(o_orderdate as date) ts from orders), f as (select tile, min(ts) f0 from items where ts between date '1996-01-01' and date '1997-12-31' group by tile), g0 as (select tile, f0, case when f0 - date '1996-01-01' > 5 then f0 - cast(5 * ((f0 - date '1996-01-01') // 5) as integer) else f0 end g from f)"


def customer_days(spark, sf):
    return st.table(spark, sf, "orders").selectExpr("o_custkey as tile", "to_date(o_orderdate) as ts")


@query(f"with {_CUSTOMER_DAYS} select tile, f0 as first, g as grid_start from g0")
def customer_grid_phase(spark, sf):
    first = customer_days(spark, sf).filter("ts between date'1996-01-01' and date'1997-12-31'").groupBy("tile").agg(F.min("ts").alias("first"))
    return first.select("tile", "first", tg.grid_start(F.col("first"), F.lit("1996-01-01").cast("date")).alias("grid_start"))


@query(f"with {_CUSTOMER_DAYS}, d as (select tile, cast(unnest(range(g, date '1998-01-01', interval 5 day)) as date) ts from g0) select tile, ts from d where not exists (select 1 from items i where i.tile = d.tile and i.ts = d.ts)")
def customer_missing_dates(spark, sf):
    return tg.missing_dates(customer_days(spark, sf), "tile", "1996-01-01", "1997-12-31")


@query("with p as (select date '2020-01-01' lo, date '2022-01-23' hi union all select date '2022-01-24', date '2023-12-31'), s as (select hi, cast(unnest(range(lo, hi + 1, interval 41 day)) as date) \"first\" from p) select \"first\", least(\"first\" + 40, hi) as \"last\" from s")
def batch_ranges(spark, sf):
    return tg.batches(spark, "2020-01-01", "2023-12-31", 40, "2022-01-24")


@query("with r as (select user_id id, cast(ts as date) d, floor(value * 100) v from events), f as (select id, min(d) lo, max(d) hi from r group by id), s as (select id, lo, cast(unnest(range(0, (hi - lo) // 5 + 1)) as integer) pos from f), a as (select r.id, cast((d - lo) // 5 as integer) pos, avg(v) v from r join f using (id) group by 1, 2) select s.id, s.pos, lo + 5 * s.pos ts, floor(v * 10000.0::double + 0.5) / 10000.0::double v from s left join a on a.id = s.id and a.pos = s.pos")
def resample_users_5d(spark, sf):
    rows = st.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.to_date("ts").alias("ts"), F.floor(F.col("value") * 100).alias("v"))
    return tg.resampled(rows, "id", ["v"]).select("id", "pos", "ts", rounded("v").alias("v"))


_WIDE_YEARS = range(1995, 2002)


@query("select c_nationkey id, " + ", ".join(f"cast(count(case when year(o_orderdate) = {y} then 1 end) as bigint) y{y}" for y in _WIDE_YEARS) + " from orders join customer on o_custkey = c_custkey group by 1")
def long_to_wide(spark, sf):
    rows = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = rows.select(F.col("c_nationkey").alias("id"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("y")).groupBy("id").pivot("y", [f"y{y}" for y in _WIDE_YEARS]).count()
    return wide.na.fill(0)


@query("select id, y, n from (unpivot (" + ORACLES["long_to_wide"] + ") on " + ", ".join(f"y{y}" for y in _WIDE_YEARS) + " into name y value n)")
def wide_to_long(spark, sf):
    return long_to_wide(spark, sf).unpivot("id", [f"y{y}" for y in _WIDE_YEARS], "y", "n")


# pixels

def _sql_int(x: str, bits: int, signed: bool) -> str:
    low = f"(((cast(trunc({x}) as bigint) % {1 << bits}) + {1 << bits}) % {1 << bits})"
    low = f"(case when {low} >= {1 << (bits - 1)} then {low} - {1 << bits} else {low} end)" if signed else low
    return f"coalesce({low}, 0)"


def _sql_angle(l1, y1, l2, y2, l3, y3) -> str:
    side = lambda p, q, d: f"sqrt({float(d * d)!r}::double + ({q} - {p}) * ({q} - {p}))"
    a, b, c = side(y1, y2, l2 - l1), side(y2, y3, l3 - l2), side(y1, y3, l3 - l1)
    return f"acos(least(greatest(({a} * {a} + {b} * {b} - {c} * {c}) / (2 * {a} * {b}), -1), 1)) * 10000"


def _r(a, b):
    return f"(({a} - {b}) / nullif({a} + {b}, 0))"


_E = "(b08 - b04) / nullif(b08 + 6 * b04 - 7.5::double * b02 + 1, 0)"
_AS1 = _sql_angle(835, "b08", 1613.7, "b11", 2202, "b12")
INDEX_SQL = {
    "ndvi": _sql_int(f"{_r('b08', 'b04')} * 10000", 16, True), "gndvi": _sql_int(f"{_r('b08', 'b03')} * 10000", 16, True),
    "lai": _sql_int(f"0.57::double * exp(2.33::double * {_r('b08', 'b04')}) * 1000", 16, False), "sr": _sql_int("b08 / nullif(b04, 0) * 10000", 16, True),
    "savi": _sql_int("(b08 - b04) / (b08 + b04 + 0.5::double) * 1000", 16, True), "fapar": _sql_int(f"0.026::double * exp(4.083::double * {_r('b08', 'b03')}) * 100", 16, True),
    "nbr": _sql_int(f"{_r('b08', 'b12')} * 10000", 16, True), "evi": _sql_int(f"2.5::double * (b08 - b04) / nullif(b08 + 6 * b04 - 7.5::double * b02 + 1, 0) * 1000", 16, True),
    "lai_evi": _sql_int("((3.618::double * (b08 - b04) / nullif(b08 + 6 * b04 - 7.5::double * b02 + 1, 0)) - 0.118::double) * 1000", 16, True),
    "ar": _sql_int(_sql_angle(560, "b03", 664.0, "b04", 835, "b08"), 16, False), "as1": _sql_int(_AS1, 16, True),
    "anir": _sql_int(_sql_angle(664, "b04", 835, "b08", 1613.7, "b11"), 16, False), "are1": _sql_int(_sql_angle(665, "b04", 705, "b05", 740, "b06"), 16, False),
    "are2": _sql_int(_sql_angle(705, "b05", 740, "b06", 783, "b07"), 16, False), "are3": _sql_int(_sql_angle(740, "b06", 783, "b07", 842, "b08"), 16, False),
    "sasi": _sql_int(f"{_sql_int(_AS1, 16, True)}::double / nullif(b11 - b08, 0) * 10000", 32, False),
    "conc": _sql_int(f"b11 - ({_r('b08', 'b11')} * 768 + {_r('b08', 'b12')} * 1348)", 16, True),
}


def _indices(names: list[str]):
    def run(spark, sf):
        p = st.pixels(spark, sf)
        bands = {c: F.col(c) for c in p.columns if c.startswith("b")}
        return p.select("px", "ln", *(spectral.index(n, bands).alias(n) for n in names))

    return run


for _name, _members in {"spectral_ndvi_family": ["ndvi", "gndvi", "lai", "sr", "savi", "fapar", "nbr"], "spectral_evi_family": ["evi", "lai_evi"], "spectral_angles": ["ar", "as1", "anir", "are1", "are2", "are3"], "spectral_sasi_conc": ["sasi", "conc"]}.items():
    QUERIES[_name] = _indices(_members)
    ORACLES[_name] = f"with {st.PIXELS} select px, ln, " + ", ".join(f"{INDEX_SQL[n]} {n}" for n in _members) + " from pixels"

_CLOUDS = ", ".join(map(str, spectral.CLOUD_CLASSES))


@query(f"with {st.PIXELS} select px, ln, nir, nullif(b08, nir) x from (select px, ln, b08 nir, b08 from pixels)")
def band_passthrough(spark, sf):
    p = st.pixels(spark, sf)
    return p.select("px", "ln", spectral.index("NIR", {"b08": F.col("b08")}).alias("nir"), F.lit(None).cast("double").alias("x"))


@query(f"with {st.PIXELS} select px, ln, case when scl not in ({_CLOUDS}) then b08 end b08, case when scl not in ({_CLOUDS}) then b04 end b04 from pixels")
def cloud_mask_null(spark, sf):
    return st.pixels(spark, sf).select("px", "ln", *(spectral.masked(F.col(c), F.col("scl")).alias(c) for c in ("b08", "b04")))


@query(f"with {st.PIXELS} select px, ln, case when scl not in ({_CLOUDS}) then b08 else 0 end b08, case when scl not in ({_CLOUDS}) then b04 else 0 end b04 from pixels")
def cloud_mask_zero(spark, sf):
    return st.pixels(spark, sf).select("px", "ln", *(spectral.masked(F.col(c), F.col("scl"), cloud="zero").alias(c) for c in ("b08", "b04")))


@query(f"""with {st.PIXELS}, o as (select px, ln, greatest(case when "day" >= date '1998-01-24' then b08 - 1000 else b08 end, 0) b08 from pixels) select px, ln, b08, case when b08 - 2500 >= -1000 then b08 - 2500 else 0 end clipped from o""")
def offset_clip(spark, sf):
    o = st.pixels(spark, sf).select("px", "ln", spectral.without_offset(F.col("b08"), F.col("day"), "1998-01-24").alias("b08"))
    return o.select("px", "ln", "b08", spectral.clipped(F.col("b08") - 2500).alias("clipped"))


@query(f"""with {st.PIXELS} select cx, cy, "day", {rounded_sql(f"avg(case when scl not in ({_CLOUDS}) then b08 else 0 end)")} b08, {rounded_sql(f"avg(case when scl not in ({_CLOUDS}) then b04 end)")} b04 from pixels group by 1, 2, 3""")
def zonal_mean(spark, sf):
    p = st.pixels(spark, sf)
    zones = p.select("cx", "cy").distinct()
    seen = p.select("cx", "cy", "day", spectral.masked(F.col("b08"), F.col("scl"), cloud="zero").alias("b08"), spectral.masked(F.col("b04"), F.col("scl")).alias("b04"))
    return sp.zonal_mean(seen, zones, ["cx", "cy", "day"], ["b08", "b04"]).select("cx", "cy", "day", rounded("b08").alias("b08"), rounded("b04").alias("b04"))


@query(f"""with {st.PIXELS}, r as (select *, row_number() over (partition by tile, cx, cy, "day" order by px, ln, b08, b04) r from pixels where scl not in ({_CLOUDS})) select tile, cx, cy, "day", b08, b04 from r where r = 1""")
def solar_day_mosaic(spark, sf):
    p = st.pixels(spark, sf).filter(spectral.clear(F.col("scl")))
    first = p.groupBy("tile", "cx", "cy", "day").agg(F.min(F.struct("px", "ln", "b08", "b04")).alias("f"))
    return first.select("tile", "cx", "cy", "day", "f.b08", "f.b04")


# codes and validity

def _state_sql(mode: str) -> str:
    ranges = " or ".join(f"product between {a} and {b}" for a, b in codes.ORCHARD_RANGES)
    rest = "(\"use\" in ('PR', 'PS', 'PA') and product < 61) or product > 65" if mode == "frame" else "\"use\" in ('PR', 'PS', 'PA') and (product < 61 or product > 65)"
    return f"""case when product is null or product = 0 then 'SLD' when regexp_matches(coalesce(incidence, ''), '117|199') then 'A' when regexp_matches(coalesce(incidence, ''), '177|186') then 'M5'
        when "use" = 'OV' and product = 101 then 'NA' when "use" = 'OV' then 'PA' when "use" is null then 'SRC' when "use" = 'FY' and ({ranges}) then 'NA' when "use" = 'FY' and product = 150 then 'NA_150'
        when "use" in ('PR', 'PS', 'PA') and product between 61 and 65 then 'NA' when {rest} then 'PA' else 'Uso_alt' end"""


for _mode in ("frame", "sql"):
    QUERIES[f"state_case_{_mode}"] = (lambda mode: lambda spark, sf: st.declarations(spark, sf).select("px", "ln", codes.state(F.col("use"), F.col("product"), F.col("incidence"), mode=mode).alias("state")))(_mode)
    ORACLES[f"state_case_{_mode}"] = f"with {st.DECLARATIONS} select px, ln, {_state_sql(_mode)} state from declarations"

_YEARLY = f"""{st.DECLARATIONS}, one as (select *, row_number() over (partition by parcel, "year" order by px, ln, product nulls first, "use" nulls first, incidence nulls first) r from declarations),
spine as (select parcel, unnest([2020, 2021, 2022, 2023, 2024]) "year" from (select distinct parcel from declarations)),
yearly as (select s.parcel, s."year", "use", product, incidence, px, case when o.parcel is null then null else {_state_sql('frame')} end state from spine s left join one o on o.parcel = s.parcel and o."year" = s."year" and r = 1)"""
_STRINGS = """select parcel, string_agg(case state when 'A' then '0' when 'NA' then '1' when 'SLD' then '2' when 'SRC' then '3' when 'PA' then '4' else '5' end, '' order by "year") a_crono,
 string_agg(coalesce(cast(product as varchar), '0'), '_' order by "year") p_crono, string_agg(coalesce("use", 'NU'), '_' order by "year") u_crono, string_agg(coalesce(incidence, '0'), '_' order by "year") i_crono from yearly group by parcel"""


def yearly(spark, sf) -> DataFrame:
    """A row for each parcel, with arrays in order of the year."""
    d = st.declarations(spark, sf).withColumn("state", codes.state(F.col("use"), F.col("product"), F.col("incidence")))
    one = d.groupBy("parcel", "year").agg(F.min_by(F.struct("state", "product", "use", "incidence", "px"), F.struct("px", "ln", "product", "use", "incidence")).alias("v"))
    by_year = one.groupBy("parcel").agg(F.map_from_entries(F.collect_list(F.struct("year", "v"))).alias("m"))
    wanted = F.array(*[F.lit(y) for y in st.YEARS])
    return by_year.select("parcel", F.transform(wanted, lambda y: F.try_element_at("m", y)).alias("v"))


@query(f"with {_YEARLY} {_STRINGS}")
def crono_strings(spark, sf):
    y = yearly(spark, sf)
    return y.select("parcel", codes.state_chronology(F.col("v.state")).alias("a_crono"), codes.product_chronology(F.col("v.product")).alias("p_crono"), codes.use_chronology(F.col("v.use")).alias("u_crono"), codes.incidence_chronology(F.col("v.incidence")).alias("i_crono"))


@query(f"""with {_YEARLY} select parcel, string_agg(case when px is null then '0' else coalesce(incidence, 'None') end, '_' order by "year") i_crono from yearly group by parcel""")
def incidence_strings(spark, sf):
    y = yearly(spark, sf)
    return y.select("parcel", codes.incidence_chronology(F.col("v.incidence"), F.transform("v", lambda v: v["px"].isNotNull())).alias("i_crono"))


@query(f'with {_YEARLY} select parcel, first(px order by "year") filter (where px is not null) first_id from yearly group by parcel')
def first_nonnull_id(spark, sf):
    return yearly(spark, sf).select("parcel", F.get(F.filter("v.px", lambda x: x.isNotNull()), F.lit(0)).alias("first_id"))


@query(f"with {_YEARLY} select parcel, u_crono from ({_STRINGS}) where regexp_matches(u_crono, 'PS|TA')")
def use_filter(spark, sf):
    return crono_strings(spark, sf).filter(codes.matches_use(F.col("u_crono"), ("PS", "TA"))).select("parcel", "u_crono")


@query(f"with {_YEARLY} select parcel, uso from ({_STRINGS}), (select unnest(['PS', 'OV', 'TA']) uso) where contains(u_crono, uso)")
def use_multi_output(spark, sf):
    uses = F.explode(F.filter(F.array(*[F.lit(u) for u in ("PS", "OV", "TA")]), lambda u: F.contains(F.col("u_crono"), u)))
    return crono_strings(spark, sf).select("parcel", uses.alias("uso"))


@query(f"with {st.DECLARATIONS} select px, ln, coalesce(cast(parcel as varchar), '') || '-' || coalesce(cast(\"year\" as varchar), '') || '-' || coalesce(\"use\", '') || '-' || coalesce(cast(product as varchar), '') id from declarations")
def compound_id(spark, sf):
    return st.declarations(spark, sf).select("px", "ln", codes.compound_id(*(F.col(c) for c in ("parcel", "year", "use", "product"))).alias("id"))


@query(f'with {st.DECLARATIONS} select distinct parcel, "year", "use" from declarations')
def distinct_rows(spark, sf):
    return st.declarations(spark, sf).select("parcel", "year", "use").distinct()


_WINDOWS = f"""{st.CAMPAIGNS}, windows as (select c.region, c."year", c.start_date as "first", coalesce(n.start_date, make_date(c."year" + 1, 12, 31)) as "last"
 from campaigns c left join campaigns n on n.region = c.region and n."year" = c."year" + 1)"""


@query(f'with {_WINDOWS} select region, "year", "first", "last" from windows')
def campaign_window(spark, sf):
    return val.campaign_windows(st.campaigns(spark))


for _mode, _sql in {"frame": '(d0 <= "last" and d1 between "first" and "last") or d1 is null', "sql": 'd0 <= "last" and (d1 between "first" and "last" or d1 is null)'}.items():
    QUERIES[f"validity_{_mode}"] = (lambda mode: lambda spark, sf: st.versions(spark, sf).join(F.broadcast(val.campaign_windows(st.campaigns(spark))), "region").filter(val.valid_line(F.col("d0"), F.col("d1"), F.col("first"), F.col("last"), mode=mode)).select("id", "region", "year"))(_mode)
    ORACLES[f"validity_{_mode}"] = f'with {_WINDOWS}, {st.VERSIONS} select id, region, "year" from versions join windows using (region) where {_sql}'


# areas

_SIZED = f"{st.PARCELS}, sized as (select *, (x2 - x1) * (y2 - y1) area, 2 * ((x2 - x1) + (y2 - y1)) per from parcels)"
_COMMON = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"with {_SIZED} select id, area from sized where per / nullif(area, 0) <= 0.4")
def compact_shapes(spark, sf):
    return sp.compact(st.parcels(spark, sf)).filter(F.try_divide(sp.perimeter(), sp.area()) <= 0.4).select("id", sp.area().alias("area"))


@query(f"with {_SIZED} select id from sized a where not exists (select 1 from sized b where a.id <> b.id and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2 and {_COMMON} > 0.01 * least(a.area, b.area) and a.area <= b.area)")
def overlap_eliminate(spark, sf):
    return sp.without_overlaps(st.parcels(spark, sf)).select("id")


def _cells(source: str, key: str, more: str = "") -> str:
    return f"(select {key}{more}, cx, unnest(range(cast(y1 / 2 as bigint), cast(y2 / 2 as bigint))) cy from (select *, unnest(range(cast(x1 / 2 as bigint), cast(x2 / 2 as bigint))) cx from {source}))"


_CELLS = f"{st.PARCELS}, {st.PLOTS}, a as {_cells('parcels', 'id')}, b as {_cells('plots', 'lid')}"


@query(f"with {_CELLS} select id, lid, cast(4 * count(*) as bigint) area from a full join b on a.cx = b.cx and a.cy = b.cy group by 1, 2")
def overlay_union(spark, sf):
    return sp.overlay(st.parcels(spark, sf), st.plots(spark, sf), "id", "lid")


@query(f"with {_CELLS} select id, lid, cast(4 * count(*) as bigint) area from a join b on a.cx = b.cx and a.cy = b.cy group by 1, 2")
def overlay_inner(spark, sf):
    return sp.overlay(st.parcels(spark, sf), st.plots(spark, sf), "id", "lid", how="inner")


_YS = ", ".join(f'min(case when "year" = {y} then product end) y{y}' for y in st.YEARS)


@query(f"with {st.PARCELS}, c as {_cells('parcels', 'id', ', product, ' + chr(34) + 'year' + chr(34))}, t as (select cx, cy, {_YS} from c group by 1, 2) select y2020, y2021, y2022, y2023, y2024, cast(4 * count(*) as bigint) area from t group by 1, 2, 3, 4, 5")
def crono_overlay(spark, sf):
    return sp.chronology_overlay(st.parcels(spark, sf), st.YEARS, "product")


@query(f"with {st.PARCELS}, d as (select *, greatest(300 - x2, x1 - 400, 0) dx, greatest(300 - y2, y1 - 400, 0) dy from parcels) select id from d where dx * dx + dy * dy <= 2500")
def roi_dwithin(spark, sf):
    return sp.near(st.parcels(spark, sf), 300, 300, 400, 400, 50).select("id")


@query(f"with {st.PARCELS}, {st.PLOTS}, m as (select b.lid, a.id, {_COMMON} common from plots b join parcels a on a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2), r as (select *, row_number() over (partition by lid order by common desc, id) r from m where common > 0) select lid, id, common from r where r = 1")
def tile_argmax(spark, sf):
    return sp.largest_overlap(st.plots(spark, sf), st.parcels(spark, sf), "lid", "id")


@query(f"with {st.PARCELS} select min(id) id, x1, y1, x2, y2 from parcels group by x1, y1, x2, y2")
def geometry_dedup(spark, sf):
    return sp.first_by_geometry(st.parcels(spark, sf)).select("id", *sp.BOX)


@query(f"with {st.PARCELS} select min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from parcels")
def bbox(spark, sf):
    return sp.bounds(st.parcels(spark, sf))


# edges and set operations

@query("select row_number() over (order by p_brand, p_type, p_partkey) n, concat('{\"file\":\"', p_brand, '\",\"band_index\":', row_number() over (partition by p_brand order by p_type, p_partkey), '}') layout from part")
def part_layout_json(spark, sf):
    p = st.table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    # numbers within a file by a window, files' offsets from the few files' counts: no single-partition sort of rows
    inner = p.withColumn("band_index", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", "p_partkey")))
    counts = p.groupBy("p_brand").count()
    before = counts.select("p_brand", (F.sum("count").over(Window.orderBy("p_brand")) - F.col("count")).alias("before"))
    return inner.join(before, "p_brand").select((F.col("before") + F.col("band_index")).alias("n"), F.to_json(F.struct(F.col("p_brand").alias("file"), "band_index")).alias("layout"))


@query("select c_nationkey id, '[' || string_agg(cast(y as varchar), ',' order by y) || ']' as years from (select distinct c_nationkey, year(o_orderdate) y from orders join customer on o_custkey = c_custkey) group by 1")
def arrays_json(spark, sf):
    rows = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("id")).agg(F.to_json(F.sort_array(F.collect_set(F.year("o_orderdate")))).alias("years"))


@query("select o_custkey id, cast(o_orderdate as date) ts from orders where o_orderstatus = 'F' union all select o_custkey, cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT'")
def union_all_concat(spark, sf):
    o = st.table(spark, sf, "orders").withColumn("ts", F.to_date("o_orderdate")).withColumnRenamed("o_custkey", "id")
    return o.filter("o_orderstatus = 'F'").select("id", "ts").unionByName(o.filter("o_orderpriority = '1-URGENT'").select("id", "ts"))


def _status_days(spark, sf, *statuses):
    o = st.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("ts"), "o_orderstatus")
    return [o.filter(F.col("o_orderstatus") == s).select("ts") for s in statuses]


@query("select cast(o_orderdate as date) ts from orders where o_orderstatus = 'F' except select cast(o_orderdate as date) from orders where o_orderstatus = 'P'")
def except_status_dates(spark, sf):
    a, b = _status_days(spark, sf, "F", "P")
    return a.subtract(b)


@query("select cast(o_orderdate as date) ts from orders where o_orderstatus = 'F' intersect select cast(o_orderdate as date) from orders where o_orderstatus = 'P'")
def intersect_status_dates(spark, sf):
    a, b = _status_days(spark, sf, "F", "P")
    return a.intersect(b)


@query(f"with {ITEMS}, f as (select tile, orbit from (select *, row_number() over (partition by tile order by ts, orbit) r from items) where r = 1) select tile, orbit, ts, count(*) n from items semi join f using (tile, orbit) group by 1, 2, 3")
def semi_items(spark, sf):
    i = items(spark, sf)
    first = i.groupBy("tile").agg(F.min(F.struct("ts", "orbit")).alias("f")).select("tile", F.col("f.orbit").alias("orbit"))
    return i.join(F.broadcast(first), ["tile", "orbit"], "left_semi").groupBy("tile", "orbit", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey id from customer where c_custkey not in (select o_custkey from orders)")
def anti_items(spark, sf):
    c, o = st.table(spark, sf, "customer"), st.table(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("select a.o_orderkey id, a.o_totalprice ar, c.c_acctbal as1, n.n_name ndvi from orders a join customer c on a.o_custkey = c.c_custkey join nation n on n.n_nationkey = c.c_nationkey")
def three_way_join(spark, sf):
    o, c, n = (st.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("ar"), F.col("c_acctbal").alias("as1"), F.col("n_name").alias("ndvi"))


@query("select c_mktsegment segment, year(o_orderdate) as \"year\", count(*) n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) cents from orders join customer on o_custkey = c_custkey group by rollup (c_mktsegment, year(o_orderdate))")
def rollup_counts(spark, sf):
    o, c = st.table(spark, sf, "orders"), st.table(spark, sf, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return j.rollup("segment", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("select event_type, cast(floor(value / 10) as bigint) bin, count(*) n from events group by 1, 2")
def histogram_counts(spark, sf):
    e = st.table(spark, sf, "events")
    return e.groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
