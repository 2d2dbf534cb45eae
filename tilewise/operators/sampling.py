"""Negatives: rows of a scan and random points, both away from what is known, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewise import config as C

from .shared import cut_lineage, numbered, sized
from .spatial import exclude_near


def bottom_k(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group in a total order, with their rank; a task sends at most k rows of a group, however large it is."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def region_negatives(scan: DataFrame, known: DataFrame, k: int = 300, metres: float = C.EXCLUDE_M, seed: int = 4244, region: str = "region", key: str = "tile_id") -> DataFrame:
    """region, tile_id, lat, lon, rank: up to k fetched tiles of each region, none nearer than so many metres to a known point (lat, lon).

    Tiles come in the order of a hash of seed and id, so the choice depends on nothing else; of a tile's records one counts.
    Tiles without a region, id or place take no part.
    """
    fetched = scan.where(F.col("fetch_ok") & F.col("score").isNotNull() & F.col(region).isNotNull() & F.col(key).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    tiles = fetched.groupBy(region, key).agg(F.min(F.struct("lat", "lon")).alias("at")).select(region, key, "at.lat", "at.lon").withColumn("_key", F.struct(region, key))
    away = exclude_near(tiles, known.select("lat", "lon"), "_key", metres).drop("_key")
    return bottom_k(away, region, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)], k).select(region, key, "lat", "lon", "rank")


def random_points(known: DataFrame, n: int, bbox=C.METRO_BBOX, metres: float = C.EXCLUDE_M, seed: int = 42, attempts: int = 3) -> DataFrame:
    """attempt, lat, lon, wanted, reason: n points in bbox (south, west, north, east), none nearer than so many metres to a known one.

    Points are drawn by a hash of seed and attempt; of attempts * n draws the first n that aren't refused stay. Where that many
    draws don't give n points there are fewer, and `reason` says so; else it is null.
    """
    s, w, north, e = bbox
    spark = known.sparkSession
    # the first 48 bits of a hash as a number from 0 to 1
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") * F.lit(2.0**-48)
    drawn = spark.range(attempts * n).select(F.col("id").alias("attempt"), (F.lit(s) + draw(0) * F.lit(north - s)).alias("lat"), (F.lit(w) + draw(1) * F.lit(e - w)).alias("lon"))
    free = cut_lineage(exclude_near(drawn, known.select("lat", "lon"), "attempt", metres))
    first = cut_lineage(numbered(free, [F.col("attempt")], "_n").where(F.col("_n") <= n).drop("_n"))
    short = sized(first.agg(F.when(F.count("*") < n, F.concat(F.lit(f"{attempts * n} draws left "), F.count("*").cast("string"), F.lit(f" of {n}"))).alias("reason")))
    return first.crossJoin(short).select("attempt", "lat", "lon", F.lit(n).alias("wanted"), "reason")  # one row of statistics
