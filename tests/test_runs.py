"""Composed runs on small hand-made tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrachron.operators import chains, spatial, timegrid
from terrachron.sources import readers


def test_tables_of_unequal_length_are_an_error(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id long, d1 long")
    assert chains.joined_indices({"ar": a, "ndvi": a}, "id").columns == ["id", "d1_ar", "d1_ndvi"]
    with pytest.raises(ValueError, match="unequal"):
        chains.joined_indices({"ar": a, "ndvi": a.limit(1)}, "id")


def test_final_columns(spark):
    found = spark.createDataFrame([(1, "x"), (2, "y")], "id long, ar string")
    wide = spark.createDataFrame([(1, 3, None, 9)], "id long, a_ndvi long, b_ndvi long, a_ar long")
    got = {r["id"]: tuple(r) for r in chains.with_final_columns(found, wide, "id", ["ar", "ndvi", "as1"]).collect()}
    assert got == {1: (1, "x", "3", 0), 2: (2, "y", None, 0)}


def test_points_on_edges_belong_to_one_box(spark):
    points = spark.createDataFrame([(0.0, 0.0), (10.0, 5.0), (49.9, 0.0), (50.0, 60.0), (-3.0, 1.0)], "x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 10.0, 0.0, 120.0, 120.0), (3, -5.0, 0.0, 0.0, 5.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["x"], r["id"]) for r in spatial.holding(points, boxes, "id").collect()}
    assert got == {(0.0, 1), (10.0, 2), (49.9, 2), (50.0, 2), (-3.0, 3)}


def test_missing_frames_are_zero(spark):
    frames = spark.createDataFrame([("a", datetime.date(2020, 1, 6), 7.0, 4)], "tile string, ts date, b08 double, scl int")
    got = sorted(tuple(r) for r in timegrid.with_missing_frames(frames, ["tile"], "2020-01-01", "2020-01-12", ["b08"]).collect())
    assert got == [("a", datetime.date(2020, 1, 1), 0.0, 0), ("a", datetime.date(2020, 1, 6), 7.0, 4), ("a", datetime.date(2020, 1, 11), 0.0, 0)]
    assert timegrid.with_missing_frames(frames.limit(0), ["tile"], "2020-01-01", "2020-01-12", ["b08"]).count() == 0


def test_folder_of_tables_to_markers(spark, tmp_path):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(5 * k) for k in range(150)]
    names = [f"{d:%Y%m%d}T_{i}" for i in ("NDVI", "AR", "AS1") for d in days]
    for file in ("one", "two", "marcadores_old"):
        rows = [f"{u}," + ",".join(str(1000 + 7 * k % 90 if n.endswith("NDVI") else 9000 - 1500 * n.endswith("AS1")) for k, n in enumerate(names)) for u in (1, 2)]
        (tmp_path / f"{file}.csv").write_text("\n".join(["FID," + ",".join(names), *rows]))
    got = chains.folder_markers(readers.csv_folder(spark, str(tmp_path)), "FID").collect()
    assert {r["id"] for r in got} == {f"{f}.csv-{u}" for f in ("one", "two") for u in (1, 2)}
    assert all(len(r["angles"]) == 1 and r["cycle"].startswith("c") and r["status"] in ("ROJO", "NARANJA", "VERDE") for r in got)
