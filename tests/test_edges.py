"""Readers, writers, polygons and streams."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.operators import polygons as pg
from terrachron.operators.markers import Thresholds
from terrachron.sources import provinces, readers, sinks
from terrachron.streaming import windows

SQUARE = [[np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float), np.array([(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], float)]]


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_campaigns(spark, tmp_path):
    path = put(tmp_path / "c.csv", "﻿Comunidad_autonoma;2020;2021;2022;2023;2024;Nombre_base_datos;;;;\nMADRID;2020-01-02;;2022-01-13;2023-01-16;2024-01-15;db_a;;;;,\nMURCIA;2020-01-02;2021-01-04;2022-01-13;2023-01-16;junk;db_b;;;;\n")
    got = readers.campaigns(spark, path)
    assert got.columns == ["region", "year", "start_date", "db"]
    assert got.count() == 8
    assert {r["province"] for r in provinces.with_campaigns(got).collect()} == {"Madrid", "Murcia"}
    assert provinces.provinces(spark).count() == 50


def test_separator_days_and_wide(spark, tmp_path):
    path = put(tmp_path / "w.csv", "ID;a;b\nx;1;2\ny;3;4\n")
    days = readers.acquisition_days(spark, put(tmp_path / "d.csv", "whatever\n02/01/2020\n07/01/2020\n"))
    assert [r["fecha"] for r in days.orderBy("n").collect()] == [dt.date(2020, 1, 2), dt.date(2020, 1, 7)]
    wide = readers.renamed_by_days(readers.delimited(spark, path), days, "NDVI")
    assert wide.columns == ["ID", "20200102T_NDVI", "20200107T_NDVI"]
    assert sorted(map(tuple, readers.long_from_wide(wide, "ID", "ndvi").collect())) == [("x", dt.date(2020, 1, 2), 1.0), ("x", dt.date(2020, 1, 7), 2.0), ("y", dt.date(2020, 1, 2), 3.0), ("y", dt.date(2020, 1, 7), 4.0)]
    with pytest.raises(ValueError):
        readers.renamed_by_days(wide, days.limit(1), "NDVI")
    bad = readers.acquisition_days(spark, put(tmp_path / "e.csv", "h\n31/02/2020\n"))
    assert bad.first()["fecha"] is None


def test_folder_and_rasters(spark, tmp_path):
    for name in ("a.csv", "a_marcadores.csv", "b.txt"):
        put(tmp_path / name, "k\n1\n")
    assert {r["file_name"] for r in readers.csv_folder(spark, str(tmp_path)).collect()} == {"a.csv"}
    rasters = tmp_path / "r"
    rasters.mkdir()
    for name in ("one", "one.hdr", "two", "three.hdr"):
        put(rasters / name, "x")
    assert [r["name"] for r in readers.raster_files(spark, str(rasters)).collect()] == ["one"]


def test_thresholds(spark, tmp_path):
    assert readers.thresholds(spark, str(tmp_path / "none")) == Thresholds()
    sinks.thresholds_file(spark, Thresholds(0.32, 147.38, 22018.1), str(tmp_path / "t"))
    assert readers.thresholds(spark, str(tmp_path / "t")) == Thresholds(0.32, 147.38, 22018.1)
    assert readers.thresholds(spark, put(tmp_path / "bad.csv", "a,b\n1,2\n")) == Thresholds()
    assert sinks.marker_name(Thresholds()) == "marcadores_0.4_60_10000"


def test_connection():
    with pytest.raises(ValueError, match="DB_PASSWORD"):
        readers.connection({"DB_USER": "u"})
    found = readers.connection({"DB_USER": "u", "DB_PASSWORD": "p", "DB_HOST": "h", "DB_PORT": "1", "DB_NAME": "n"})
    assert found["url"] == "jdbc:postgresql://h:1/n"
    assert len(readers.province_predicates([1, 2], slices=4)) == 8


def test_search(spark):
    df = spark.sql("select * from values ('a', 'T1', 1, timestamp'2020-01-05 23:00:00'), ('b', 'T1', 2, timestamp'2020-01-06 00:00:00'), ('c', 'T2', 1, timestamp'2020-01-05 01:00:00') t(item_id, tile, orbit, ts)")
    assert [r[0] for r in readers.search(df, "2020-01-01", "2020-01-05", tile="T1").collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1, 2]), (1, "a", None), (2, "a", [])], "provincia int, id string, ndvi_ts array<int>")
    sinks.by_province(df, str(tmp_path / "p"))
    back = spark.read.csv(str(tmp_path / "p"), sep=";", header=True)
    assert sorted((r["provincia"], r["id"]) for r in back.collect()) == [(1, "a"), (2, "a"), (2, "b")]
    sinks.json_cells(df, str(tmp_path / "j"))
    assert {r["ndvi_ts"] for r in spark.read.csv(str(tmp_path / "j"), header=True, escape='"').collect()} == {"[1,2]", "[]", None}
    told = dict(index="ndvi", tile="30T", orbit=1, start="a", end="b", metres=10)
    path = sinks.raster(df.limit(1), str(tmp_path), **told)
    assert path.endswith("/NDVI_30T_1_a_b_10m")
    sinks.raster(df, str(tmp_path), **told)
    assert spark.read.parquet(path).count() == 1
    sinks.areas(df.withColumn("year", F.lit(2020)), str(tmp_path / "areas"))
    assert spark.read.parquet(str(tmp_path / "areas")).filter("year = 2020").count() == 3
    days = spark.sql("select explode(array(date'2020-01-02', date'2020-01-07')) as fecha")
    sinks.days(days, str(tmp_path / "f"), batches=2)
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()) == ["02/01/2020"] * 2 + ["07/01/2020"] * 2
    sinks.replaced_table(df, "edges_table")
    sinks.replaced_table(df.limit(1), "edges_table")
    assert spark.table("edges_table").count() == 1
    bands = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "file string, band_index int")
    assert dict(sinks.layout(bands).collect())["Band_3"] == '{"file":"b","band_index":1,"stack_index":3}'


def test_polygons(spark):
    wide = struct.pack(">BIII", 0, 1003, 1, 4) + struct.pack(">12d", 0, 0, 9, 4, 0, 9, 4, 4, 9, 0, 0, 9)
    sliver = pg.dump([[np.array([(0, 0), (10, 0), (10, 0.3), (0, 0)], float)]])
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    df = spark.createDataFrame([(0, pg.dump(SQUARE)), (1, wide), (2, sliver), (3, point), (4, None)], "k int, geom binary")
    got = {r["k"]: (r["m"]["area"], r["m"]["perimeter"]) for r in df.select("k", pg.measures("geom").alias("m")).collect()}
    assert got[0] == (96, 48) and got[1][0] == 8 and got[3] == got[4] == (0, 0)
    kept = {r["k"]: r["g"] for r in df.select("k", pg.cleaned(F.col("geom")).alias("g")).collect()}
    assert kept[2] is None and kept[3] is None and kept[4] is None and kept[0] == pg.dump(SQUARE)
    cut = {r["k"]: r["a"] for r in df.select("k", pg.measures(pg.clipped(F.col("geom"), 3, 3, 20, 20))["area"].alias("a")).collect()}
    assert cut[0] == 48 and cut[2] == 0
    assert sorted(map(tuple, pg.region(df).collect())) == [(0, 0), (0, 10), (10, 0), (10, 10)]


def test_utm(spark):
    east, north = spark.range(1).select(*pg.utm(F.lit(-3.0), F.lit(40.0))).first()
    assert east == pytest.approx(500000, abs=1e-6) and north == pytest.approx(4427757.219, abs=0.01)


def test_streams_agree_with_tables(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=7 * k + k % 3), k % 2, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, id int, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    for name, f in {"binned": windows.binned, "sliding": windows.sliding, "runs": lambda *a: windows.runs(*a, gap="14 hours", late="1 day")}.items():
        want = sorted(map(tuple, f(df, ["id"], "value").collect()))
        q = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["id"], "value").writeStream.outputMode("complete" if name != "runs" else "append")
        q = q.format("memory").queryName(f"edges_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(map(tuple, spark.table(f"edges_{name}").collect()))
        # appended runs are those that the watermark has closed
        assert got == want if name != "runs" else set(got) < set(want) and got
