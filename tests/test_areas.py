"""Areas with copies, repeated and missing keys, against plain loops."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrachron.operators import chains
from terrachron.operators import spatial as sp


def _box_pairs(spark):
    """Boxes of which many are equal, some keys have several and some rows have no key."""
    left = [(k % 60 if k % 50 else None, 2.0 * (k * 7 % 20), 2.0 * (k * 3 % 20), 2.0 * (k * 7 % 20 + 2 + k % 3), 2.0 * (k * 3 % 20 + 3)) for k in range(1, 90)]
    right = [(k % 25 if k % 13 else None, 2.0 * (k * 5 % 20), 2.0 * (k * 9 % 20), 2.0 * (k * 5 % 20 + 3), 2.0 * (k * 9 % 20 + 2 + k % 2)) for k in range(1, 40)]
    columns = "x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(left * 2, f"id int, {columns}"), spark.createDataFrame(right, f"lid int, {columns}"), left * 2, right


@pytest.mark.parametrize("how", ["full", "inner"])
def test_overlay_by_cells(spark, how):
    a, b, left, right = _box_pairs(spark)
    cells = lambda rows: Counter((k, x, y) for k, x1, y1, x2, y2 in rows for x in range(int(x1 // 2), int(x2 // 2)) for y in range(int(y1 // 2), int(y2 // 2)))
    ca, cb, want = cells(left), cells(right), Counter()
    for (k, x, y), n in ca.items():
        met = [(j, m) for (j, u, v), m in cb.items() if (u, v) == (x, y)]
        for j, m in met or [(None, 1)] * (how == "full"):
            want[k, j] += 4 * n * m
    if how == "full":
        there = {(x, y) for _, x, y in ca}
        for (j, x, y), m in cb.items():
            if (x, y) not in there:
                want[None, j] += 4 * m
    got = sp.overlay(a, b, "id", "lid", how=how).collect()
    assert len(got) == len(want) and {(r[0], r[1]): r[2] for r in got} == want


def test_overlay_lists_no_cells_of_pairs(spark):
    """300 equal boxes over 200 equal ones: a pair of classes is worked out once."""
    a = spark.range(300).selectExpr("id", "0d x1", "0d y1", "400d x2", "400d y2")
    b = spark.range(200).selectExpr("id lid", "0d x1", "200d y1", "400d x2", "600d y2")
    rows = sp.overlay(a, b, "id", "lid").groupBy(F.col("id").isNull(), F.col("lid").isNull()).agg(F.count(F.lit(1)), F.min("area"), F.max("area")).collect()
    assert {tuple(r) for r in rows} == {(False, False, 60000, 80000, 80000), (False, True, 300, 80000, 80000), (True, False, 200, 80000, 80000)}


def test_overlay_broadcasts_no_cells(spark):
    """Lists of cells are longer than Spark expects, so a small table's cells must not go through the driver."""
    a = spark.range(50).selectExpr("id", "0d x1", "0d y1", "40d x2", "40d y2")
    b = spark.range(50).selectExpr("id lid", "2d * id x1", "0d y1", "2d * id + 900 x2", "900d y2")
    found = sp.overlay(a, b, "id", "lid", how="inner")
    assert found.count() == 50 * 20
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [c" in line]


def test_without_overlaps_of_copies_and_repeated_keys(spark):
    rows = [(k % 37 if k % 9 else None, float(k * 11 % 60), float(k * 17 % 60), float(k * 11 % 60 + 4 + k % 5), float(k * 17 % 60 + 5 + k % 3)) for k in range(60)]
    rows += rows[5:15] + [(100, 500.0, 500.0, 510.0, 510.0)] * 2 + [(101 + k, 700.0, 700.0, 710.0, 710.0) for k in range(2)]
    size = lambda r: (r[3] - r[1]) * (r[4] - r[2])
    side = lambda a, b, lo: max(0, min(a[lo + 2], b[lo + 2]) - max(a[lo], b[lo]))
    gone = {a[0] for a in rows for b in rows if None not in (a[0], b[0]) and a[0] != b[0] and size(a) <= size(b) and side(a, b, 1) * side(a, b, 2) > 0.01 * size(a)}
    got = sp.without_overlaps(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double")).collect()
    assert gone and sorted(map(tuple, got), key=repr) == sorted((r for r in rows if r[0] not in gone), key=repr)


def test_without_overlaps_of_many_copies(spark):
    """No row for each pair of 200,000 equal boxes."""
    boxes = spark.range(200_000).selectExpr("id", "0d x1", "0d y1", "10d x2", "10d y2")
    assert sp.without_overlaps(boxes).count() == 0


def test_feature_indices_of_copies(spark):
    """Features of equal boxes, with two boxes, of overlapping boxes and without a key: means by plain loops."""
    boxes = [(k, 0, 0, 10, 10) for k in range(5)] + [(7, 0, 0, 10, 10), (7, 5, 5, 15, 15), (8, 5, 5, 15, 15), (8, 0, 0, 10, 10), (None, 5, 5, 60, 60), (None, 0, 0, 10, 10), (9, 500, 500, 510, 510)]
    points = [(float(k * 7 % 20), float(k * 3 % 20), f"2020-01-0{1 + k % 3}", 4, 1000.0 + 37 * k % 900, 2000.0 + 11 * k) for k in range(80)]
    zones = spark.createDataFrame(boxes, "lid int, x1 double, y1 double, x2 double, y2 double".replace("double", "int"))
    bands = [f"b{k:02d}" for k in range(1, 13)]
    pixels = spark.createDataFrame(points, "x double, y double, d string, scl int, red double, nir double").withColumn("day", F.to_date("d"))
    pixels = pixels.select("x", "y", "day", "scl", *(F.col("nir" if b == "b08" else "red").alias(b) for b in bands))
    got = chains.feature_indices(pixels, zones, "lid", "2020-01-01", "2020-01-03").collect()
    one = {(r["x"], r["y"], str(r["day"])): r for r in pixels.collect()}
    days = {}
    for lid, x1, y1, x2, y2 in boxes:
        for x, y, day, *_ in points:
            if x1 <= x < x2 and y1 <= y < y2 and day < "2020-01-03":
                days.setdefault((lid, day), []).append((x, y, day))
    assert len(got) == len(days) and {(r["lid"], str(r["day"])) for r in got} == set(days) and one
    same = {}
    for r in got:
        same.setdefault((str(r["day"]), tuple(sorted(days[r["lid"], str(r["day"])]))), set()).add((r["ndvi"], r["ar"], r["as1"]))
    assert all(len(v) == 1 for v in same.values())


def test_feature_indices_of_many_copies(spark):
    """40,000 equal features over 40,000 pixels: no row for each pair of the two."""
    zones = spark.range(40_000).selectExpr("id lid", "0 x1", "0 y1", "10 x2", "10 y2")
    pixels = spark.range(40_000).selectExpr("5 x", "5 y", "date'2020-01-01' day", "4 scl", *(f"cast(1000 + id % 7 as double) b{k:02d}" for k in range(1, 13)))
    rows = chains.feature_indices(pixels, zones, "lid", "2020-01-01", "2020-01-03")
    assert rows.groupBy("day", "ndvi", "ar", "as1").count().collect()[0]["count"] == 40_000


def test_declared_pieces_of_many_copies(spark):
    """100,000 equal parcels go without a row for each pair of them; what stands alone stays."""
    parcels = spark.range(100_000).selectExpr("id", *(f"cast(if(id < 99999, {lo}, {lo} + 100) as double) {c}" for c, lo in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 10))))
    lines = spark.createDataFrame([(1, 104.0, 100.0, 124.0, 110.0, "OV", 101, "186")], "lid long, x1 double, y1 double, x2 double, y2 double, use string, product long, incidence string")
    got = {tuple(r) for r in chains.declared_pieces(parcels, lines).select("id", "lid", "area").collect()}
    assert got == {(99_999, 1, 60), (99_999, None, 40), (None, 1, 140)}


def test_overlay_broadcasts_no_members(spark):
    """Keys of classes grow with the input, so they don't go through the driver, however small they are here."""
    a = spark.range(50).selectExpr("id", "0d x1", "0d y1", "40d x2", "40d y2")
    b = spark.range(50).selectExpr("id lid", "0d x1", "0d y1", "20d x2", "20d y2")
    found = sp.overlay(a, b, "id", "lid", how="inner")
    assert {tuple(r) for r in found.groupBy("area").count().collect()} == {(400, 2500)}
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lid" in plan and not [line for line in plan.split("Initial Plan")[0].splitlines() if "BroadcastHashJoin" in line and ("[_a" in line or "[_b" in line or "__first" in line)]


def test_declared_pieces_has_a_short_plan(spark):
    """The plan is held by the driver and worked on before the first task: few scans of each table."""
    parcels = spark.range(20).selectExpr("id", "cast(40 * id as double) x1", "0d y1", "cast(40 * id + 20 as double) x2", "20d y2")
    lines = parcels.selectExpr("id lid", "x1", "y1", "x2", "y2", "'OV' use", "id product", "'186' incidence")
    found = chains.declared_pieces(parcels, lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 20") <= 45
    assert {(r["id"], r["lid"], r["area"]) for r in found.collect()} == {(k, k, 400) for k in range(20)}
