"""Areas as boxes and as grid cells.

Joins go through an equality on coarse cells, so Spark deals them by hash; the
exact predicate follows. A pair is kept in the cell of its lower left common
corner only, so it appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def perimeter() -> Column:
    return 2 * ((F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")))


def compact(boxes: DataFrame) -> DataFrame:
    """Without slivers: perimeter at most equal to the area."""
    return boxes.filter(F.try_divide(perimeter(), area()) <= 1)


def snapped(c: Column, grid: float = 2.0) -> Column:
    return F.rint(c / grid) * grid


def in_cells(boxes: DataFrame, size: int, *, margin: float = 0) -> DataFrame:
    """Boxes, once for each coarse cell (cx, cy) that they, grown by margin, touch."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - margin) / size), F.floor((F.col(hi) + margin) / size)))
    return boxes.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))


def common_area(a: str = "a", b: str = "b") -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}_{hi}"), F.col(f"{b}_{hi}")) - F.greatest(F.col(f"{a}_{lo}"), F.col(f"{b}_{lo}")), F.lit(0))
    return side("x1", "x2") * side("y1", "y2")


def overlapping(left: DataFrame, right: DataFrame, size: int = 50) -> DataFrame:
    """a_*, b_*, common for each pair of boxes with a common area."""
    a = in_cells(left, size).select("cx", "cy", *(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = in_cells(right, size).select("cx", "cy", *(F.col(c).alias(f"b_{c}") for c in right.columns))
    here = (F.floor(F.greatest("a_x1", "b_x1") / size) == F.col("cx")) & (F.floor(F.greatest("a_y1", "b_y1") / size) == F.col("cy"))
    # a list of cells is longer than its boxes let Spark expect, so it is never broadcast
    return a.join(b.hint("merge"), ["cx", "cy"]).filter(here).withColumn("common", common_area()).filter("common > 0").drop("cx", "cy")


def without_overlaps(boxes: DataFrame, key: str = "id", *, share: float = 0.01, size: int = 50) -> DataFrame:
    """Less every box that a box of at least its size covers by more than `share` of the smaller; of two equal ones both go. Boxes of equal geometry are compared once, with the least and the greatest of their keys."""
    sized = boxes.groupBy(*BOX).agg(F.min(key).alias("least"), F.max(key).alias("greatest")).withColumn("area", area())
    met = overlapping(sized, sized, size).filter((F.col("common") > share * F.least("a_area", "b_area")) & (F.col("a_area") <= F.col("b_area")))
    over = met.groupBy(*(F.col(f"a_{c}").alias(c) for c in BOX)).agg(F.min("b_least").alias("_least"), F.max("b_greatest").alias("_greatest"))
    # some box over this one has another key
    gone = boxes.select(key, *BOX).join(over, list(BOX)).filter((F.col(key) != F.col("_least")) | (F.col(key) != F.col("_greatest")))
    return boxes.join(gone.select(key).distinct(), key, "left_anti")


def near(boxes: DataFrame, x1: float, y1: float, x2: float, y2: float, distance: float) -> DataFrame:
    """Boxes within the distance of a region's box. The plain bounds reach the scan; the exact distance follows."""
    dx = F.greatest(x1 - F.col("x2"), F.col("x1") - x2, F.lit(0))
    dy = F.greatest(y1 - F.col("y2"), F.col("y1") - y2, F.lit(0))
    bounds = (F.col("x2") >= x1 - distance) & (F.col("x1") <= x2 + distance) & (F.col("y2") >= y1 - distance) & (F.col("y1") <= y2 + distance)
    return boxes.filter(bounds & (dx * dx + dy * dy <= distance * distance))


def bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def covered_cells(boxes: DataFrame, size: int = 2) -> DataFrame:
    """One row for each fine cell that a box aligned to the grid covers."""
    span = lambda lo, hi: F.explode(F.sequence((F.col(lo) / size).cast("long"), (F.col(hi) / size).cast("long") - 1))
    return boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))


def shape_classes(boxes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """members(key, _first) and shapes(_first, box): keys of the same boxes, each as often, are a class, named by its first key. Rows without a key are passed over."""
    of_key = boxes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*BOX))).alias("_shape"))
    of_shape = of_key.groupBy("_shape").agg(F.min(key).alias("_first"))
    return of_key.join(of_shape, "_shape").select(key, "_first"), of_shape.select("_first", F.inline("_shape"))


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, how: str = "full", size: int = 2) -> DataFrame:
    """Pieces of a union ('full') or intersection ('inner') overlay of boxes aligned to the grid, with their areas; a side that a piece lacks is null.

    Keys of equal boxes are overlaid once, as a class; common cells are counted from the corners, and the pairs of classes get their keys by joins, so no cell of a pair is ever listed.
    """
    left, right = (on_grid(x, key, size) for x, key in ((left, left_key), (right, right_key)))
    (a_members, a), (b_members, b) = shape_classes(left, left_key), shape_classes(right, right_key)
    # rows without a key are a class without a name, as what one side lacks is
    a, b = (shapes.unionByName(boxes.filter(F.col(key).isNull()).select(F.col(key).alias("_first"), *BOX)) for shapes, boxes, key in ((a, left, left_key), (b, right, right_key)))
    pieces = overlapping(a, b, 32).groupBy(F.col("a__first").alias("_a"), F.col("b__first").alias("_b")).agg(F.sum("common").alias("_n"))
    if how == "full":
        no = {side: F.lit(None).cast(x.schema["_first"].dataType).alias(side) for side, x in (("_a", a), ("_b", b))}
        bare = bare_cells(a, "_first", b).select(F.col("_first").alias("_a"), no["_b"], "_n").unionByName(bare_cells(b, "_first", a).select(no["_a"], F.col("_first").alias("_b"), "_n"))
        pieces = pieces.unionByName(bare).groupBy("_a", "_b").agg(F.sum("_n").alias("_n"))
    found = with_members(with_members(pieces, "_b", "_a", b_members), "_a", right_key, a_members)
    return found.select(left_key, right_key, (F.col("_n") * size * size).alias("area"))


def with_members(pieces: DataFrame, name: str, other: str, members: DataFrame) -> DataFrame:
    """A row for each piece and key of the class that it names; null for a piece that names none. Those are dealt out by `other`. Members grow with the input, so they are never broadcast."""
    named = members.select(F.col("_first").alias(name), F.expr("pmod(hash(_first), 1)").alias("_deal"), *(c for c in members.columns if c != "_first"))
    dealt = pieces.withColumn("_deal", F.when(F.col(name).isNull(), F.pmod(F.hash(other), F.lit(1024))).otherwise(0))
    return dealt.join(named.hint("merge"), [name, "_deal"], "left").drop("_deal")


def on_grid(boxes: DataFrame, key: str, size: int) -> DataFrame:
    """key and box in whole cells, the upper bounds exclusive, of boxes that cover some."""
    return boxes.select(key, *((F.col(c) / size).cast("long").alias(c) for c in BOX)).filter("x2 > x1 and y2 > y1")


def bare_cells(boxes: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """key, _n: how many cells of the key's boxes (in whole cells) no other box covers."""
    taken = covered_cells(others.select(*BOX).distinct(), 1).select("cx", "cy").distinct()
    free = covered_cells(boxes, 1).select(key, "cx", "cy").join(taken.hint("merge"), ["cx", "cy"], "left_anti")
    return free.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))


def chronology_overlay(boxes: DataFrame, years: list[int], value: str, *, size: int = 2) -> DataFrame:
    """Pieces with one value for each year (the least where boxes of a year overlap), and their areas: one grouping by cell instead of a join a year."""
    cells = covered_cells(boxes, size).groupBy("cx", "cy").agg(*(F.min(F.when(F.col("year") == y, F.col(value))).alias(f"y{y}") for y in years))
    return cells.groupBy(*(f"y{y}" for y in years)).agg((F.count(F.lit(1)) * size * size).alias("area"))


def chronology_inner(boxes: DataFrame, years: list[int], value: str, *, size: int = 2) -> DataFrame:
    """crono (the years' values joined by _), area of the pieces that have a value in every year: one grouping by cell in place of a chain of joins."""
    found = chronology_overlay(boxes, years, value, size=size)
    columns = [f"y{y}" for y in years]
    whole = found.dropna(subset=columns)
    return whole.select(F.concat_ws("_", *columns).alias("crono"), "area")


def holding(points: DataFrame, boxes: DataFrame, key: str, *, size: int = 50) -> DataFrame:
    """Points (x, y) with the key of each box that holds them, its lower and left edges included. They meet on coarse cells."""
    cells = in_cells(boxes.select(key, *BOX), size).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    at = points.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size))
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    return at.join(cells, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy", *BOX)


def cleaned(boxes: DataFrame, key: str) -> DataFrame:
    """Without slivers, overlaps and repeated geometries."""
    return first_by_geometry(without_overlaps(compact(boxes), key), key)


def largest_overlap(regions: DataFrame, tiles: DataFrame, key: str, tile: str, size: int = 50) -> DataFrame:
    """Each region's tile with the largest common area; the first by name on a tie."""
    met = overlapping(regions, tiles, size)
    return met.groupBy(F.col(f"a_{key}").alias(key)).agg(F.max_by(F.struct(F.col(f"b_{tile}").alias("t"), F.col("common")), F.struct(F.col("common"), -F.col(f"b_{tile}"))).alias("m")).select(key, F.col("m.t").alias(tile), "m.common")


def first_by_geometry(boxes: DataFrame, key: str = "id") -> DataFrame:
    """One row a geometry: the one of the least key."""
    order = Window.partitionBy(*BOX).orderBy(key)
    return boxes.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def zonal_mean(pixels: DataFrame, zones: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means of pixel values by zone, day and so on; pixels and zones meet on their cell."""
    return pixels.join(zones, ["cx", "cy"]).groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))
