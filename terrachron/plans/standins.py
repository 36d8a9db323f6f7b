"""Canonical inputs made from the star-schema tables, as DataFrames and as the same SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USES = ("OV", "FY", "PR", "PS", "PA", "TA", "AG")
YEARS = [2020, 2021, 2022, 2023, 2024]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (a nation), ts, ndvi, ar, as1; some steps are missing, some angles too low."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    rows = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("id")), F.col("o_custkey") == F.col("c_custkey"))
    first = rows.groupBy("id").agg(F.min("d").alias("lo"))
    at = rows.join(first, "id").select("id", "cents", F.expr("date_add(lo, cast(5 * (datediff(d, lo) div 5) as int))").alias("ts"))
    return at.groupBy("id", "ts").agg(F.sum("cents").alias("s"), F.count(F.lit(1)).alias("n")).select(
        "id", "ts", F.expr("(s div n) div 100").alias("ndvi"), F.expr("6000 + (s div 1000) % 9000").alias("ar"), F.expr("6000 + (n * 1371 + s div 7777) % 5000").alias("as1"),
    )


SERIES = """
rows_ as (select cast(c_nationkey as bigint) id, cast(o_orderdate as date) d, cast(round(o_totalprice * 100) as bigint) cents
          from orders join customer on o_custkey = c_custkey),
first_ as (select id, min(d) lo from rows_ group by id),
at_ as (select id, cents, lo + cast(5 * ((d - lo) // 5) as integer) ts from rows_ join first_ using (id)),
sums_ as (select id, ts, cast(sum(cents) as bigint) s, count(*) n from at_ group by id, ts),
series as (select id, ts, (s // n) // 100 ndvi, 6000 + (s // 1000) % 9000 ar, 6000 + (n * 1371 + s // 7777) % 5000 as1 from sums_)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    band = lambda k: F.expr(f"cast((l_partkey * {7 * k + 3} + l_suppkey * {13 * k + 5} + l_linenumber * {101 * k + 17}) % 5000 + 1 as double)")
    return item.select(
        F.col("l_orderkey").alias("px"), F.col("l_linenumber").cast("long").alias("ln"), F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("tile"),
        F.expr("l_partkey % 50").alias("cx"), F.expr("l_suppkey % 20").alias("cy"), F.expr("(l_orderkey + l_linenumber) % 12").alias("scl"), *(band(k).alias(f"b{k:02d}") for k in range(1, 13)),
    )


PIXELS = (
    "pixels as (select l_orderkey px, cast(l_linenumber as bigint) ln, cast(l_shipdate as date) \"day\", l_returnflag tile, l_partkey % 50 cx, l_suppkey % 20 cy, (l_orderkey + l_linenumber) % 12 scl, "
    + ", ".join(f"cast((l_partkey * {7 * k + 3} + l_suppkey * {13 * k + 5} + l_linenumber * {101 * k + 17}) % 5000 + 1 as double) b{k:02d}" for k in range(1, 13))
    + " from lineitem)"
)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "2020 + p_partkey % 5 as year", "cast(2 * ((p_partkey * 37) % 500) as double) as x1", "cast(2 * ((p_partkey * 91) % 500) as double) as y1",
        "cast(2 * ((p_partkey * 37) % 500) + 2 * (5 + p_size % 10) as double) as x2", "cast(2 * ((p_partkey * 91) % 500) + 2 * (5 + (p_size + p_partkey) % 10) as double) as y2",
        "p_partkey % 351 as product",
    )


PARCELS = """
parcels as (select p_partkey id, 2020 + p_partkey % 5 "year", cast(2 * ((p_partkey * 37) % 500) as double) x1, cast(2 * ((p_partkey * 91) % 500) as double) y1,
            cast(2 * ((p_partkey * 37) % 500) + 2 * (5 + p_size % 10) as double) x2, cast(2 * ((p_partkey * 91) % 500) + 2 * (5 + (p_size + p_partkey) % 10) as double) y2,
            p_partkey % 351 product from part)"""


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as lid", "cast(2 * ((s_suppkey * 53) % 500) as double) as x1", "cast(2 * ((s_suppkey * 29) % 500) as double) as y1",
        "cast(2 * ((s_suppkey * 53) % 500) + 2 * (10 + s_suppkey % 15) as double) as x2", "cast(2 * ((s_suppkey * 29) % 500) + 2 * (10 + s_suppkey % 15) as double) as y2",
    )


PLOTS = """
plots as (select s_suppkey lid, cast(2 * ((s_suppkey * 53) % 500) as double) x1, cast(2 * ((s_suppkey * 29) % 500) as double) y1,
          cast(2 * ((s_suppkey * 53) % 500) + 2 * (10 + s_suppkey % 15) as double) x2, cast(2 * ((s_suppkey * 29) % 500) + 2 * (10 + s_suppkey % 15) as double) y2 from supplier)"""

_LINE_USE = "case s_suppkey % 8 " + " ".join(f"when {k} then '{u}'" for k, u in enumerate(USES)) + " end"
_LINE = (f"{_LINE_USE} as use_", "case when s_suppkey % 17 <> 0 then s_suppkey * 7 % 351 end as product", "case when s_suppkey % 7 <> 0 then cast(s_suppkey % 200 as varchar(9)) end as incidence")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plots with the use, product and incidence of their declaration."""
    told = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as lid", *_LINE)
    return plots(spark, sf_dir).join(told.withColumnRenamed("use_", "use"), "lid")


LINES = PLOTS + f""",
lines as (select plots.*, use_ "use", product, incidence from plots join (select s_suppkey lid, {', '.join(_LINE)} from supplier) using (lid))"""

_USE = "case (l_partkey + l_linenumber) % 8 " + " ".join(f"when {k} then '{u}'" for k, u in enumerate(USES)) + " end"
_PRODUCT = "case when l_suppkey % 17 <> 0 then l_partkey % 351 end"
_INCIDENCE = "case when l_orderkey % 7 <> 0 then concat(cast(l_orderkey % 200 as varchar(9)), ',', cast(l_partkey % 11 as varchar(9))) end"


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: parcel, year, use, product, incidences; some are missing."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as px", "cast(l_linenumber as bigint) as ln", "l_suppkey as parcel", "2020 + (year(l_shipdate) - 1995) % 5 as year",
        f"{_USE} as use", f"{_PRODUCT} as product", f"{_INCIDENCE} as incidence",
    )


DECLARATIONS = f"""
declarations as (select l_orderkey px, cast(l_linenumber as bigint) ln, l_suppkey parcel, 2020 + (year(l_shipdate) - 1995) % 5 "year",
                 {_USE} "use", {_PRODUCT} product, {_INCIDENCE} incidence from lineitem)"""


def campaigns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, y, f"{y}-{m:02d}-{d:02d}") for r, m, d in (("north", 1, 16), ("south", 2, 1), ("east", 1, 5)) for y in YEARS if (r, y) != ("east", 2022)], "region string, year int, s string").selectExpr("region", "year", "to_date(s) as start_date")


CAMPAIGNS = "campaigns as (select * from (values " + ", ".join(f"('{r}', {y}, date '{y}-{m:02d}-{d:02d}')" for r, m, d in (("north", 1, 16), ("south", 2, 1), ("east", 1, 5)) for y in YEARS if (r, y) != ("east", 2022)) + ') t(region, "year", start_date))'


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of orders in the campaign years; a fifth are still open."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "element_at(array('north', 'south', 'east'), cast(o_custkey % 3 as int) + 1) as region",
        "date_add(to_date(o_orderdate), 9131) as d0", "case when o_orderkey % 5 <> 0 then date_add(to_date(o_orderdate), cast(9131 + (o_custkey * 7) % 900 as int)) end as d1",
    )


VERSIONS = """
versions as (select o_orderkey id, case o_custkey % 3 when 0 then 'north' when 1 then 'south' else 'east' end region, cast(o_orderdate as date) + 9131 d0,
             case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + cast(9131 + (o_custkey * 7) % 900 as integer) end d1 from orders)"""


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Half up, the same in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def rounded_sql(c: str, digits: int = 4) -> str:
    return f"floor(({c}) * {10**digits}.0::double + 0.5) / {10**digits}.0::double"
