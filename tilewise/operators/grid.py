"""Tile grids, and what is left of them to be scanned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo


def _steps(start: float, end: float, stride: float) -> int:
    return max(0, math.ceil((end - (start + stride / 2)) / stride))


def grid(spark: SparkSession, bbox=C.METRO_BBOX, stride_lat: float = C.STRIDE_LAT, stride_lon: float = C.STRIDE_LON) -> DataFrame:
    """iy, ix, lat, lon, tile_id of the centres in bbox (south, west, north, east): one range, split up by arithmetic."""
    s, w, n, e = bbox
    ny, nx = _steps(s, n, stride_lat), _steps(w, e, stride_lon)
    rows = spark.range(ny * nx).select((F.floor(F.col("id") / max(1, nx))).cast("long").alias("iy"), (F.col("id") % max(1, nx)).cast("long").alias("ix"))
    rows = rows.withColumn("lat", F.lit(s + stride_lat / 2) + F.col("iy") * F.lit(stride_lat)).withColumn("lon", F.lit(w + stride_lon / 2) + F.col("ix") * F.lit(stride_lon))
    return rows.withColumn("tile_id", geo.tile_id(F.col("lat"), F.col("lon")))


def grid_metres(spark: SparkSession, bbox, tile_metres: float = 240.0) -> DataFrame:
    """A grid with a stride in metres, the longitude's at the middle latitude."""
    s, w, n, e = bbox
    if not (s < n and w < e and tile_metres > 0):
        raise ValueError("bbox is south, west, north, east, and not empty")
    lat = tile_metres / C.METRES_PER_DEGREE
    return grid(spark, bbox, lat, lat / math.cos(math.radians((s + n) / 2)))


def grids(boxes: DataFrame, key: str, stride_lat: float = C.STRIDE_LAT, stride_lon=C.STRIDE_LON) -> DataFrame:
    """key, iy, ix, lat, lon, tile_id of the centres in every box (key, south, west, north, east), as grid() gives them for one.

    stride_lon may be a column. A box that is empty or has a null side has no cells.
    """
    half = stride_lon / 2
    steps = lambda a, b, stride, off: F.ceil((F.col(b) - (F.col(a) + off)) / stride).cast("long")
    ny, nx = steps("south", "north", F.lit(stride_lat), F.lit(stride_lat / 2)), steps("west", "east", stride_lon if isinstance(stride_lon, Column) else F.lit(stride_lon), half if isinstance(stride_lon, Column) else F.lit(half))
    rows = boxes.withColumns({"_ny": ny, "_nx": nx}).where("_ny > 0 and _nx > 0")
    rows = rows.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx") - 1)))
    rows = rows.withColumn("lat", F.col("south") + F.lit(stride_lat / 2) + F.col("iy") * F.lit(stride_lat)).withColumn("lon", F.col("west") + half + F.col("ix") * stride_lon)
    return rows.select(key, "iy", "ix", "lat", "lon", geo.tile_id(F.col("lat"), F.col("lon")).alias("tile_id"))


def grids_metres(boxes: DataFrame, key: str, tile_metres: float = 240.0) -> DataFrame:
    """grids() with a stride in metres, the longitude's at each box's middle latitude."""
    lat = tile_metres / C.METRES_PER_DEGREE
    return grids(boxes, key, lat, F.lit(lat) / F.cos(F.radians((F.col("south") + F.col("north")) / 2)))


def todo(tiles: DataFrame, log: DataFrame) -> DataFrame:
    """Tiles that the log has no record of, failed ones included."""
    return tiles.join(log.select("tile_id").where("tile_id is not null").distinct(), "tile_id", "left_anti")


def drop_overlap(tiles: DataFrame, bbox=C.METRO_BBOX) -> DataFrame:
    """Tiles outside bbox, and inside it those of the grid that starts there."""
    lat, lon = F.col("lat"), F.col("lon")
    return tiles.where(~geo.in_bbox(lat, lon, bbox) | geo.on_grid(lat, lon, bbox))


def raster_tiles(spark: SparkSession, bbox) -> DataFrame:
    """Names of the 3-degree raster tiles that cover bbox."""
    s, w, n, e = bbox
    corner = lambda a, b: list(range(math.floor(a / 3) * 3, math.ceil(b / 3) * 3, 3))
    rows = [(float(y), float(x)) for y in corner(s, n) for x in corner(w, e)]
    return spark.createDataFrame(rows, "lat double, lon double").select(geo.raster_tile(F.col("lat"), F.col("lon")).alias("raster_tile"))


def first_cells(cells: DataFrame, n: int) -> DataFrame:
    """The first n cells of a grid, row by row from the south-west."""
    return cells.orderBy("iy", "ix").limit(n)
