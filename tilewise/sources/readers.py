"""Readers: scan logs, GeoJSON, grouped JSON, markdown tables, images and tariffs, as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewise.functions import geo, text

SCAN = "tile_id string, lat double, lon double, fetch_ok boolean, score double, error string, region string"
FEATURE = "type string, geometry struct<type: string, coordinates: string>, properties string"


def scan_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON Lines of a scan with ord (file and place in it); malformed lines are left out, or are an error if strict.

    Lines are parsed one by one, so ord follows the file and a record is never split over rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("file", "ord", F.from_json("value", SCAN if strict else SCAN + ", _bad string", mode).alias("r")).select("file", "ord", "r.*")
    return parsed if strict else parsed.where("_bad is null and tile_id is not null").drop("_bad")


def done(log: DataFrame) -> DataFrame:
    """Ids of every record, failed ones as well."""
    return log.select("tile_id").where("tile_id is not null").distinct()


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of feature collections: kind, point (lon, lat) or polygons, and typed properties."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "features array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>").alias("fc"))
    f = raw.select("file", F.posexplode("fc.features").alias("ord", "f"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(coords, "array<double>"))
    polygon = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    return f.select("file", "ord", kind.alias("kind"), point[0].alias("lon"), point[1].alias("lat"), F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", F.array(polygon)).alias("polygons"), F.from_json("f.properties", properties).alias("p"), F.json_object_keys("f.properties").alias("keys")).select("file", "ord", "kind", "lon", "lat", "polygons", "keys", "p.*")


def grouped_json(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a JSON object of lists, with the group's name; groups whose name starts with _ are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, array<struct<{item}>>>").alias("m"))
    return raw.select(F.explode("m").alias("group", "items")).where(~F.col("group").startswith("_")).select("group", F.posexplode("items").alias("ord", "i")).select("group", "ord", "i.*")


def config_row(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a small configuration table; an error that lists the known keys if there is none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"{value}: known are {', '.join(sorted(r[0] for r in rows.select(key).distinct().collect()))}")
    return found


def markdown_tables(lines: DataFrame) -> DataFrame:
    """Rows of markdown tables as maps from header to cell; lines: file, line (number), value.

    A header is the row above a separator; it holds until the next one.
    """
    w = Window.partitionBy("file").orderBy("line")
    rows = lines.where(F.trim("value").startswith("|")).withColumn("cells", text.table_cells(F.col("value"))).withColumn("sep", text.is_separator(F.col("value")))
    header = F.when(F.lead("sep").over(w), F.col("cells"))
    rows = rows.withColumn("is_header", F.coalesce(F.lead("sep").over(w), F.lit(False))).withColumn("header", F.last(header, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where(~F.col("sep") & ~F.col("is_header") & F.col("header").isNotNull() & (F.size("cells") == F.size("header")))
    return kept.select("file", "line", F.map_from_arrays("header", "cells").alias("row"))


def image_tiles(spark: SparkSession, path: str, at_least: int = 1000) -> DataFrame:
    """Cached tile images of a size that can hold one: path, length, lat, lon from names like 14.40108_120.92112.jpg. Content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)\.jpg$", 1)
    return files.where(F.col("length") > at_least).select("path", "length", F.split_part(name, F.lit("_"), F.lit(1)).try_cast("double").alias("lat"), F.split_part(name, F.lit("_"), F.lit(2)).try_cast("double").alias("lon")).where("lat is not null and lon is not null")


def fetch_plan(tiles: DataFrame, base: str, pixels: int = 400) -> DataFrame:
    """tiles with the URL a connector would fetch; fetching itself is left to the caller's mapInPandas."""
    return tiles.withColumn("url", geo.export_url(base, F.col("lat"), F.col("lon"), pixels))
