"""Pixels under polygons: a polygon becomes runs of pixels, row by row, and pixels meet the runs of their row.

Row 0 of a raster is its northern edge; a pixel is under a polygon if its centre is, by the same even-odd rule as
geo.in_ring, with the same arithmetic, so that both say the same of every pixel. The sides of a ring are spread over the
rows that they cross; what a row's crossings mean follows from their order. No pixel is tested against a ring.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewise import config as C

#: Runs and pixels of a row meet within pieces of so many columns.
PIECE = 256


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: its north-western corner and the size of a pixel, in degrees."""

    north: float
    west: float
    pixel: float

    def lat(self, py: Column) -> Column:
        return F.lit(self.north) - (py + 0.5) * F.lit(self.pixel)

    def lon(self, px: Column) -> Column:
        return F.lit(self.west) + (px + 0.5) * F.lit(self.pixel)

    def area_m2(self, py: Column) -> Column:
        """Of a pixel of this row."""
        side = self.pixel * C.METRES_PER_DEGREE
        return F.lit(side * side) * F.cos(F.radians(self.lat(py)))


def runs(polygons: DataFrame, key: str, grid: Grid) -> DataFrame:
    """key, py, px_from, px_to (both inside) of each polygon (key, polygons: array of polygons, each an outer ring and its holes).

    Polygons of one key that overlap count once; a hole that sticks out of its outer ring takes nothing away elsewhere.
    Columns may lie outside of any raster. Rings are closed or not; empty ones have no runs.
    """
    rings = polygons.select(F.col(key).alias("_key"), F.posexplode("polygons").alias("_part", "_rings")).select("_key", "_part", F.posexplode("_rings").alias("_ring", "r"))
    rings = rings.where(F.size("r") > 0)
    sides = rings.select("_key", "_part", "_ring", F.explode(F.arrays_zip(F.col("r").alias("a"), F.concat(F.slice("r", -1, 1), F.slice("r", 1, F.size("r") - 1)).alias("b"))).alias("s"))
    sides = sides.select("_key", "_part", "_ring", *[F.col(f"s.{p}")[i].alias(f"{p}{c}") for p in "ab" for i, c in enumerate("xy")])
    row = lambda y: (F.lit(grid.north) - y) / grid.pixel
    rows = F.sequence(F.floor(row(F.greatest("ay", "by"))) - 1, F.ceil(row(F.least("ay", "by"))) + 1)
    crossed = sides.where("ay <> by").withColumn("py", F.explode(rows)).withColumn("_lat", grid.lat(F.col("py")))
    crossed = crossed.where((F.col("ay") > F.col("_lat")) != (F.col("by") > F.col("_lat")))
    x = (F.col("bx") - F.col("ax")) * (F.col("_lat") - F.col("ay")) / (F.col("by") - F.col("ay") + F.lit(1e-12)) + F.col("ax")
    crossed = crossed.select("_key", "_part", "_ring", "py", x.alias("x"))
    # the first column whose centre isn't west of the crossing
    guess = F.ceil((F.col("x") - grid.west) / grid.pixel - 0.5)
    first = F.when(grid.lon(guess - 1) >= F.col("x"), guess - 1).when(grid.lon(guess) >= F.col("x"), guess).otherwise(guess + 1)
    order = Window.partitionBy("_key", "_part", "_ring", "py").orderBy("x")
    enters = F.when(F.row_number().over(order) % 2 == 1, 1).otherwise(-1)
    events = crossed.withColumn("c", first.cast("long")).withColumn("d", enters)
    outer = F.col("_ring") == 0
    events = events.groupBy("_key", "_part", "py", "c").agg(F.sum(F.when(outer, F.col("d")).otherwise(0)).alias("o"), F.sum(F.when(outer, 0).otherwise(F.col("d"))).alias("h"))
    by_column = Window.partitionBy("_key", "_part", "py").orderBy("c")
    spans = events.withColumns({"_o": F.sum("o").over(by_column), "_h": F.sum("h").over(by_column), "_next": F.lead("c").over(by_column)})
    spans = spans.where("_o > 0 and _h = 0 and _next is not null").select("_key", "py", F.col("c").alias("a"), (F.col("_next") - 1).alias("b"))
    # spans of the parts of one polygon that touch or overlap become one run
    along = Window.partitionBy("_key", "py").orderBy("a", "b")
    reach = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0))
    numbered = apart.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_key", "py", "_run").agg(F.min("a").alias("px_from"), F.max("b").alias("px_to")).select(F.col("_key").alias(key), "py", "px_from", "px_to")


def under(pixels: DataFrame, found: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """pixels (py, px, ...) with the key of each polygon whose runs hold them; width: columns of the raster, to cut runs that go beyond."""
    if width is not None:
        found = found.withColumns({"px_from": F.greatest("px_from", F.lit(0)), "px_to": F.least("px_to", F.lit(width - 1))}).where("px_from <= px_to")
    piece = lambda c: F.floor(c / PIECE).cast("long")
    cut = found.withColumn("_piece", F.explode(F.sequence(piece(F.col("px_from")), piece(F.col("px_to")))))
    met = pixels.withColumn("_piece", piece(F.col("px"))).join(cut, ["py", "_piece"])
    return met.where(F.col("px").between(F.col("px_from"), F.col("px_to"))).drop("_piece", "px_from", "px_to")


def zonal(pixels: DataFrame, polygons: DataFrame, key: str, grid: Grid, value: str = "value", cls: str = "cls", of_class: int = C.BUILT_UP_CLASS, width: int | None = None) -> DataFrame:
    """key, n, mean, share, km2 of every polygon: pixels under it, their mean value, the share and the area of those of a class.

    A polygon without pixels has n = 0, no area, and neither mean nor share. Values are summed as decimals, areas by row of
    pixels, so that results don't depend on the order of tasks.
    """
    hit = F.col(cls) == of_class
    met = under(pixels, runs(polygons, key, grid), key, width)
    by_row = met.groupBy(key, "py").agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).alias("v"), F.count(value).alias("nv"), F.count_if(hit).alias("hits"))
    sums = by_row.groupBy(key).agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("v"), F.sum("nv").alias("nv"), F.sum("hits").alias("hits"), F.sum((F.col("hits") * grid.area_m2(F.col("py"))).cast("decimal(28,6)")).cast("double").alias("m2"))
    some = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = polygons.select(key).distinct().join(sums, key, "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), some("v", "nv").alias("mean"), some("hits", "n").alias("share"), (F.coalesce("m2", F.lit(0.0)) / 1e6).alias("km2"))
