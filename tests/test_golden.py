"""Hand-derived cases of the trickier operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from terrachron.functions import codes, spectral
from terrachron.operators import markers, series, spatial, timegrid, validity

DAY = dt.date(2020, 1, 2)


def grid(spark, values):
    return spark.createDataFrame([(1, k, DAY + dt.timedelta(5 * k), float(v), float(v), 0.0) for k, v in enumerate(values)], "id int, pos int, ts date, ndvi double, ar double, as1 double")


@pytest.mark.parametrize(
    ("signal", "want"),
    [
        ("0,0,0", []),
        ("0,5,0", [("07/01", "07/01", 0, 5)]),
        ("5,6", [("02/01", "02/01", 0, 5)]),
        ("5,6,7", [("02/01", "12/01", 10, 7)]),
        ("5,0,6,7", [("02/01", "17/01", 15, 7)]),
        ("5,0,6,0,7", [("02/01", "02/01", 0, 5), ("22/01", "22/01", 0, 7)]),
        ("5,6,0,7,8", [("02/01", "02/01", 0, 5), ("17/01", "22/01", 5, 8)]),
    ],
)
def test_interval_splitting(spark, signal, want):
    rows = markers.growth_intervals(grid(spark, signal.split(","))).orderBy("grp").collect()
    assert [(r["start"].strftime("%d/%m"), r["end"].strftime("%d/%m"), r["days"], r["amplitude"]) for r in rows] == want


def test_smoothing(spark):
    got = [r[0] for r in series.smoothed(grid(spark, [1, 2, 4, 8, 16]), "id", ["ndvi"]).orderBy("pos").select("ndvi").collect()]
    assert got == pytest.approx([45 / 35, 51 / 35, 137 / 35, 303 / 35, 549 / 35])
    square = [k * k for k in range(9)]
    assert [r[0] for r in series.smoothed(grid(spark, square), "id", ["ndvi"]).orderBy("pos").select("ndvi").collect()] == pytest.approx(square)
    assert [r[0] for r in series.smoothed(grid(spark, [3, 1, 2]), "id", ["ndvi"]).orderBy("pos").select("ndvi").collect()] == [3, 1, 2]


def test_interpolation(spark):
    got = [r[0] for r in series.interpolated(grid(spark, [0, 10, 0, 0, 40, 0]), "id", ["ndvi"]).orderBy("pos").select("ndvi").collect()]
    assert got == [0, 10, 20, 30, 40, 50]
    assert [r[0] for r in series.interpolated(grid(spark, [0, 7, 0]), "id", ["ndvi"]).orderBy("pos").select("ndvi").collect()] == [None, 7, None]


@pytest.mark.parametrize(("cycle", "flag", "want"), [("c1111", 0, "VERDE"), ("c1111", 1, "VERDE"), ("c1111", -1, "ROJO"), ("c0000", 0, "ROJO"), ("c1010", 1, "ROJO"), ("c1010", 0, "NARANJA"), ("c1110", 1, "NARANJA"), ("c1", 1, "ROJO")])
def test_stability_class(spark, cycle, flag, want):
    assert spark.range(1).select(codes.stability_class(F.lit(cycle), F.lit(flag))).first()[0] == want


def test_angle_flag(spark):
    df = spark.createDataFrame([([],), ([0.3, math.nan],), ([0.3, 0.5],)], "a array<double>")
    assert [r[0] for r in df.select(codes.angle_flag(F.col("a"))).collect()] == [-1, 0, 1]


STATES = [
    ("OV", None, "", "SLD", "SLD"), ("OV", 0, "117", "SLD", "SLD"), ("OV", 101, "12,117", "A", "A"), ("OV", 101, "186", "M5", "M5"), ("OV", 101, "", "NA", "NA"),
    ("OV", 150, "", "PA", "PA"), (None, 30, "", "SRC", "SRC"), ("FY", 105, "", "NA", "NA"), ("FY", 150, "", "NA_150", "NA_150"), ("FY", 120, "", "PA", "Uso_alt"),
    ("PS", 63, "", "NA", "NA"), ("PS", 10, "", "PA", "PA"), ("PS", 150, "", "PA", "PA"), ("TA", 100, "", "PA", "Uso_alt"), ("TA", 20, "", "Uso_alt", "Uso_alt"),
]


def test_states(spark):
    df = spark.createDataFrame([s[:3] for s in STATES], "u string, p int, i string")
    got = df.select(codes.state(F.col("u"), F.col("p"), F.col("i")), codes.state(F.col("u"), F.col("p"), F.col("i"), mode="sql")).collect()
    assert [tuple(r) for r in got] == [s[3:] for s in STATES]


def test_chronology_strings(spark):
    df = spark.createDataFrame([(["A", "NA", None, "PA", "M5"], [101.0, None, 63.0], ["OV", None, "PS"])], "s array<string>, p array<double>, u array<string>")
    assert tuple(df.select(codes.state_chronology(F.col("s")), codes.product_chronology(F.col("p")), codes.use_chronology(F.col("u"))).first()) == ("01545", "101_0_63", "OV_NU_PS")


def test_overlaps_go(spark):
    def kept(boxes):
        df = spark.createDataFrame([(n, *map(float, b)) for n, b in boxes.items()], "id string, x1 double, y1 double, x2 double, y2 double")
        return {r[0] for r in spatial.without_overlaps(df).select("id").collect()}

    a, b, c = (0, 0, 10, 10), (5, 0, 15, 10), (0, 0, 30, 30)
    assert kept({"A": a, "B": b, "C": c}) == {"C"}
    assert kept({"A": a, "B": b}) == set()
    assert kept({"D": (0, 0, 10, 10), "E": (9.95, 0, 13, 10)}) == {"D"}


def test_campaign_window(spark):
    df = spark.createDataFrame([("r", 2023, dt.date(2023, 1, 16)), ("r", 2024, dt.date(2024, 1, 15))], "region string, year int, start_date date")
    got = {r["year"]: (str(r["first"]), str(r["last"])) for r in validity.campaign_windows(df).collect()}
    assert got == {2023: ("2023-01-16", "2024-01-15"), 2024: ("2024-01-15", "2025-12-31")}


def test_sigma_clip_empties_equal_values(spark):
    assert markers.sigma_clip(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 2)[0] is None
    assert markers.sigma_clip(spark.createDataFrame([(float(v),) for v in [1, 2, 3, 2, 1, 2, 3, 2, 1000]], "v double"), "v", 2)[0] == pytest.approx(2.0)


def test_wrapping_casts(spark):
    values = [40000.0, -1.9, math.nan, None, 65536.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(spectral.int16(F.col("v"))).collect()] == [-25536, -1, 0, 0, 0]
    assert [r[0] for r in df.select(spectral.uint16(F.col("v"))).collect()] == [40000, 65535, 0, 0, 0]


def test_unknown_index():
    with pytest.raises(ValueError):
        spectral.index("nothing", {})
    assert spectral.INDEXES["savi"] is spectral.INDEXES["saavi"]


def test_grid_keeps_phase(spark):
    got = spark.range(1).select(timegrid.grid_start(F.lit("2020-01-20").cast("date"), F.lit("2020-01-01").cast("date"))).first()[0]
    assert got == dt.date(2020, 1, 5)


def test_repeated_days_count_once(spark):
    import datetime

    from terrachron.operators import timegrid

    day = datetime.date(2020, 1, 1)
    rows = spark.createDataFrame([("a", day, 5.0), ("a", day, 3.0), ("a", datetime.date(2020, 1, 6), 7.0)], "id string, ts date, v double")
    assert [(r["pos"], r["v"]) for r in timegrid.aligned(rows, "id", ["v"]).orderBy("pos").collect()] == [(0, 3.0), (1, 7.0)]


def test_all_land_uses():
    from terrachron.functions import codes

    assert len(set(codes.USES)) == 34 and codes.chosen_uses(("TODOS",)) == codes.USES and codes.chosen_uses(("OV",)) == ("OV",)
