"""Readers. Paths may be of any file system that Spark reads; nothing is opened on the driver."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.markers import Thresholds
from ..schemas import DECLARATION_LINE, PARCEL_VERSION

YEARS = range(2020, 2025)


def separator(spark: SparkSession, path: str, choices: str = ",;") -> str:
    """The separator that the first line has most of; the first choice on a tie."""
    first = spark.read.text(path).head(1)
    line = first[0][0] if first else ""
    return max(choices, key=line.count)


def delimited(spark: SparkSession, path: str, *, sep: str | None = None, infer: bool = True) -> DataFrame:
    """A CSV file with a header; the separator is found where none is given."""
    return spark.read.csv(path, sep=sep or separator(spark, path), header=True, inferSchema=infer)


def campaigns(spark: SparkSession, path: str, years: Iterable[int] = YEARS) -> DataFrame:
    """region, year, start_date, db from the wide file; a year without a date has no row. Junk columns are ignored."""
    wide = spark.read.csv(path, sep=";", header=True)
    named = wide.toDF(*(c.lstrip("\ufeff") for c in wide.columns))
    region = named.columns[0]
    long = named.unpivot([region, "Nombre_base_datos"], [F.col(f"`{y}`") for y in years], "year", "start")
    out = long.select(F.col(region).alias("region"), F.col("year").cast("int"), F.expr("try_to_date(start, 'yyyy-MM-dd')").alias("start_date"), F.col("Nombre_base_datos").alias("db"))
    return out.filter("start_date is not null")


def connection(environment: Mapping[str, str] = os.environ, *, prefix: str = "DB_") -> dict[str, str]:
    """JDBC options from {prefix}USER, PASSWORD, HOST, PORT and NAME. Never log them."""
    need = {k: environment.get(prefix + k) for k in ("USER", "PASSWORD", "HOST", "PORT", "NAME")}
    if lacking := [prefix + k for k, v in need.items() if not v]:
        raise ValueError(f"not set: {', '.join(lacking)}")
    return {"url": f"jdbc:postgresql://{need['HOST']}:{need['PORT']}/{need['NAME']}", "user": need["USER"], "password": need["PASSWORD"], "driver": "org.postgresql.Driver"}


def province_predicates(provinces: Iterable[int], *, slices: int = 1) -> list[str]:
    """Disjoint WHERE clauses, one for each JDBC partition: `slices` a province, by municipality. A null municipality is in slice 0."""
    return [f"provincia = {int(p)} and coalesce(municipio, 0) % {int(slices)} = {k}" for p in provinces for k in range(slices)]


def _jdbc(spark: SparkSession, table: str, options: Mapping[str, str], predicates: list[str]) -> DataFrame:
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates, properties=rest)


def parcel_versions(spark: SparkSession, where: str | Mapping[str, str], *, provinces: Iterable[int], slices: int = 8, table: str = "parcel_versions") -> DataFrame:
    """Versions of parcels from Parquet (where: a path) or a database (where: JDBC options)."""
    numbers = list(provinces)
    if isinstance(where, str):
        return spark.read.schema(PARCEL_VERSION).parquet(where).filter(F.col("provincia").isin(numbers))
    return _jdbc(spark, table, where, province_predicates(numbers, slices=slices))


def declaration_lines(spark: SparkSession, where: str | Mapping[str, str], *, provinces: Iterable[int], slices: int = 8, table: str = "declaration_lines") -> DataFrame:
    """Declaration lines, as parcel_versions()."""
    numbers = list(provinces)
    if isinstance(where, str):
        return spark.read.schema(DECLARATION_LINE).parquet(where).filter(F.col("provincia").isin(numbers))
    return _jdbc(spark, table, where, province_predicates(numbers, slices=slices))


def search(catalog: DataFrame, start: str, end: str, *, tile: str | None = None, orbit: int | None = None) -> DataFrame:
    """Items acquired from start to end, both days included. All conditions reach the scan."""
    found = catalog.filter((F.col("ts") >= F.lit(start).cast("date")) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1)))
    if tile is not None:
        found = found.filter(F.col("tile") == tile)
    return found if orbit is None else found.filter(F.col("orbit") == orbit)


def with_orbit(tiles: DataFrame, orbits: DataFrame) -> DataFrame:
    """tiles with the orbit of each from a (tile, orbit) catalog; tiles that it lacks stay, with a null orbit."""
    return tiles.join(orbits.dropDuplicates(["tile"]), "tile", "left")


def acquisition_days(spark: SparkSession, path: str, *, form: str = "dd/MM/yyyy") -> DataFrame:
    """n (place in the file, from 0), fecha: a file of one column, whatever its header. What isn't a day is null."""
    raw = spark.read.csv(path, header=True, schema="fecha string", enforceSchema=True)
    # places within the file need its rows in order: one small file, one value a day
    placed = raw.coalesce(1).withColumn("n", F.monotonically_increasing_id())
    return placed.select("n", F.expr(f"cast(try_to_timestamp(fecha, '{form}') as date)").alias("fecha"))


def renamed_by_days(wide: DataFrame, days: DataFrame, index: str) -> DataFrame:
    """The data columns after the first, named by the days: yyyyMMddT_INDEX. As many days as data columns are needed."""
    found = [r[0] for r in days.orderBy("n").select(F.date_format("fecha", "yyyyMMdd")).collect()]  # one a column
    if len(found) != len(wide.columns) - 1:
        raise ValueError(f"{len(found)} days for {len(wide.columns) - 1} columns")
    return wide.toDF(wide.columns[0], *(f"{d}T_{index}" for d in found))


def long_from_wide(wide: DataFrame, key: str, index: str) -> DataFrame:
    """id, ts, value of the columns whose name ends in _INDEX."""
    cols = [c for c in wide.columns if c != key and c.upper().endswith(f"_{index.upper()}")]
    long = wide.select(F.col(key).cast("string").alias("id"), *(F.col(f"`{c}`").cast("double").alias(c[:8]) for c in cols)).unpivot("id", [f"`{c[:8]}`" for c in cols], "day", "value")
    return long.select("id", F.to_date("day", "yyyyMMdd").alias("ts"), "value")


def csv_folder(spark: SparkSession, path: str, *, without: str = "marcadores", sep: str = ",") -> DataFrame:
    """All .csv files of a folder but those with a word in their name, with their file_name."""
    found = spark.read.option("pathGlobFilter", "*.csv").csv(path, sep=sep, header=True).withColumn("file_name", F.col("_metadata.file_name"))
    return found.filter(~F.col("file_name").contains(without))


def raster_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length of data files that have a header file (name.hdr) beside them. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    headers = files.filter(F.col("name").endswith(".hdr")).select(F.expr("substring(name, 1, length(name) - 4)").alias("name"))
    return files.filter(~F.col("name").endswith(".hdr")).join(headers, "name", "left_semi").select("path", "name", "length")


def thresholds(spark: SparkSession, path: str) -> Thresholds:
    """The first row of a thresholds file; the defaults where there is no such file, or none of its values can be used."""
    try:
        row = spark.read.csv(path, header=True).selectExpr("try_cast(UMBRAL_TAM as double) a", "try_cast(UMBRAL_DAYS as double) d", "try_cast(UMBRAL_PRODUCTIVITY as double) p").head()
    except AnalysisException:
        row = None
    return Thresholds(row["a"], row["d"], row["p"]) if row is not None and None not in row else Thresholds()


def same_day_merged(pixels: DataFrame, keys: list[str], bands: list[str], *, ts: Column | str = "ts") -> DataFrame:
    """One row for each place and day; a band's value is the first that is not null by time."""
    day = F.to_date(ts).alias("day")
    first = [F.min_by(b, F.when(F.col(b).isNotNull(), F.col("ts"))).alias(b) for b in bands]
    return pixels.groupBy(*keys, day).agg(*first)
