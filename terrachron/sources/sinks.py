"""Writers. Each writes its partitions in parallel; none gathers rows on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.markers import Thresholds


def areas(df: DataFrame, path: str, *, by: tuple[str, ...] = ("year",), mode: str = "overwrite") -> None:
    """Areas (WKB or boxes) as Parquet, one folder for each layer. Rows of a layer are spread over tasks, not gathered in one."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def replaced_table(df: DataFrame, name: str) -> None:
    """DROP TABLE IF EXISTS, then CREATE TABLE AS SELECT."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def product_name(index: str, tile: str, orbit: int, start: str, end: str, metres: int) -> str:
    return f"{index.upper()}_{tile}_{orbit}_{start}_{end}_{metres}m"


def raster(df: DataFrame, root: str, *, index: str, tile: str, orbit: int, start: str, end: str, metres: int) -> str:
    """A product's pixels under its name; an existing product stays as it is."""
    path = f"{root}/{product_name(index, tile, orbit, start, end, metres)}"
    df.write.mode("ignore").parquet(path)
    return path


def stacked(bands: DataFrame) -> DataFrame:
    """bands(file, band_index) -> with stack_index, from 1, by file and band. Offsets come from counts of files: no sort of all rows in one task."""
    within = Window.partitionBy("file").orderBy("band_index")
    counts = bands.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # one row a file
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return bands.withColumn("_k", F.row_number().over(within)).join(before, "file").withColumn("stack_index", F.col("before") + F.col("_k")).drop("_k", "before")


def layout(bands: DataFrame) -> DataFrame:
    """band (Band_n), layout (JSON of file, band_index and stack_index)."""
    return stacked(bands).select(F.concat(F.lit("Band_"), F.col("stack_index")).alias("band"), F.to_json(F.struct("file", "band_index", "stack_index")).alias("layout"))


def days(dates: DataFrame, path: str, *, batches: int = 1, distinct: bool = False) -> None:
    """One column of days. The full list is written once for each batch, as the plain form appends it; distinct writes each day once."""
    rows = dates.select("fecha").distinct() if distinct else dates.select("fecha").withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(batches)))).drop("_b")
    rows.orderBy("fecha").write.mode("overwrite").csv(path, header=True, dateFormat="dd/MM/yyyy")


def by_province(df: DataFrame, path: str, *, key: str = "id") -> None:
    """CSV with ';', a folder for each province, rows sorted by id in each file; ids are dealt by ranges, so a large province is many files."""
    plain = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    dealt = plain.repartitionByRange(F.col("provincia"), F.col(key)).sortWithinPartitions("provincia", key)
    dealt.write.mode("overwrite").partitionBy("provincia").csv(path, sep=";", header=True)


def marker_name(thresholds: Thresholds) -> str:
    return f"marcadores_{thresholds.angle:g}_{thresholds.days:g}_{thresholds.productivity:g}"


def arrays_as_json(df: DataFrame) -> DataFrame:
    """Array columns that end in _ts, and time_stamps, as JSON text."""
    chosen = {c for c, t in df.dtypes if t.startswith("array") and (c.endswith("_ts") or c == "time_stamps")}
    return df.select(*(F.to_json(c).alias(c) if c in chosen else F.col(c) for c in df.columns))


def json_cells(df: DataFrame, path: str) -> None:
    arrays_as_json(df).write.mode("overwrite").csv(path, header=True, escape='"')


def markers(df: DataFrame, root: str, thresholds: Thresholds) -> str:
    """Markers as CSV under a name that tells the thresholds; nested values as JSON."""
    path = f"{root}/{marker_name(thresholds)}"
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def thresholds_file(spark, found: Thresholds, path: str) -> None:
    """One row that thresholds() reads back."""
    row = spark.createDataFrame([(found.angle, found.days, found.productivity)], "UMBRAL_TAM double, UMBRAL_DAYS double, UMBRAL_PRODUCTIVITY double")
    row.coalesce(1).write.mode("overwrite").csv(path, header=True)
