"""The domain's tables, derived by arithmetic from the star schema's keys, once for Spark and once as SQL.

Doubles are written with an exponent in the SQL, for decimal literals would be added up as decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.functions import geo, scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, a: int, b: int):
    """(lat, lon) of a key, within the metropolitan box."""
    k = F.col(key).cast("long")
    return (F.lit(14.40) + (k * a % 38000) / F.lit(100000.0)).alias("lat"), (F.lit(120.92) + (k * b % 21000) / F.lit(100000.0)).alias("lon")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan log: ord, user_id, lat, lon, score, score2 (of another run), fetch_ok, iy, ix, tile_id (a tile may recur)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value", *_place("event_id", 7919, 104729))
    k = F.col("event_id")
    rows = e.select(
        k.alias("ord"), "user_id", "event_type", "ts", "value", "lat", "lon", ((k * 31 % 1000) / F.lit(1000.0)).alias("score"), ((k * 37 % 1000) / F.lit(1000.0)).alias("score2"),
        (F.col("event_type") != "error").alias("fetch_ok"), (k * 7919 % 176).alias("iy"), (k * 104729 % 94).alias("ix"),
    )
    return rows.withColumn("tile_id", geo.tile_id(F.lit(14.40 + 0.00216 / 2) + F.col("iy") * F.lit(0.00216), F.lit(120.92 + 0.00224 / 2) + F.col("ix") * F.lit(0.00224)))


LOG = """log AS (SELECT event_id AS ord, user_id, event_type, ts, value, 1440e-2 + ((event_id * 7919) % 38000) / 100000e0 AS lat, 12092e-2 + ((event_id * 104729) % 21000) / 100000e0 AS lon,
 ((event_id * 31) % 1000) / 1000e0 AS score, ((event_id * 37) % 1000) / 1000e0 AS score2, event_type <> 'error' AS fetch_ok, (event_id * 7919) % 176 AS iy, (event_id * 104729) % 94 AS ix,
 printf('%.5f_%.5f', (1440e-2 + 216e-5 / 2e0) + ((event_id * 7919) % 176) * 216e-5, (12092e-2 + 224e-5 / 2e0) + ((event_id * 104729) % 94) * 224e-5) AS tile_id FROM events)"""


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: fetched records of 0.70 or more, with their tier."""
    rows = log(spark, sf_dir).where("fetch_ok").withColumn("tier", scoring.tier(F.col("score")))
    return rows.where("tier is not null")


DET = LOG + """, det AS (SELECT *, CASE WHEN score >= 0.85e0 THEN 'high' ELSE 'candidate' END AS tier FROM log WHERE fetch_ok AND score >= 0.70e0)"""


def osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map tags: osm_id, lat, lon, location."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("osm_id"), *_place("c_custkey", 6007, 7001), F.lower("c_mktsegment").alias("location"), "c_acctbal", "c_nationkey")


OSM = """osm AS (SELECT c_custkey AS osm_id, 1440e-2 + ((c_custkey * 6007) % 38000) / 100000e0 AS lat, 12092e-2 + ((c_custkey * 7001) % 21000) / 100000e0 AS lon, lower(c_mktsegment) AS location, c_acctbal, c_nationkey FROM customer)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas to scan: area, south, west, north, east, two to four cells wide and up to ten high."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"), *_place("s_suppkey", 6007, 7001))
    return s.select("area", F.col("lat").alias("south"), F.col("lon").alias("west"), (F.col("lat") + (F.col("area") % 11) * F.lit(0.002)).alias("north"), (F.col("lon") + F.lit(0.004) + (F.col("area") % 3) * F.lit(0.0025)).alias("east"))


BOXES = """boxes AS (SELECT area, lat AS south, lon AS west, lat + (area % 11) * 2e-3 AS north, lon + 4e-3 + (area % 3) * 25e-4 AS east
 FROM (SELECT s_suppkey AS area, 1440e-2 + ((s_suppkey * 6007) % 38000) / 100000e0 AS lat, 12092e-2 + ((s_suppkey * 7001) % 21000) / 100000e0 AS lon FROM supplier)),
cells AS (SELECT area, i AS iy, j AS ix, south + 216e-5 / 2e0 + i * 216e-5 AS lat, west + 224e-5 / 2e0 + j * 224e-5 AS lon FROM boxes, range(20) a(i), range(20) b(j)
 WHERE i < ceil((north - (south + 216e-5 / 2e0)) / 216e-5) AND j < ceil((east - (west + 224e-5 / 2e0)) / 224e-5))"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles: osm_id, ord, lat, lon (centre), ring, footprint_m2, building_type, kwp."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_retailprice", *_place("p_partkey", 5003, 9001))
    h = F.col("p_size") / F.lit(200000.0)
    corner = lambda sx, sy: F.array(F.col("lon") + sx * h, F.col("lat") + sy * h)
    kinds = F.array(*[F.lit(x) for x in ("house", "retail", "warehouse", "apartments", "office", "school")])
    return p.select(
        F.col("p_partkey").alias("osm_id"), F.col("p_partkey").alias("ord"), "lat", "lon", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"),
        (F.col("p_size") * F.col("p_size") * F.lit(1.2)).alias("footprint_m2"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("building_type"), (F.col("p_size") * F.lit(0.5)).alias("kwp"), h.alias("half"),
    )


BUILDINGS = """buildings AS (SELECT p_partkey AS osm_id, p_partkey AS ord, lat, lon, half, p_size * p_size * 12e-1 AS footprint_m2, ['house', 'retail', 'warehouse', 'apartments', 'office', 'school'][(p_partkey % 6 + 1)::INT] AS building_type, p_size * 5e-1 AS kwp
 FROM (SELECT p_partkey, p_size, 1440e-2 + ((p_partkey * 5003) % 38000) / 100000e0 AS lat, 12092e-2 + ((p_partkey * 9001) % 21000) / 100000e0 AS lon, p_size / 200000e0 AS half FROM part)),
building_points AS (SELECT osm_id, i, lon + [-1, 1, 1, -1, -1][i] * half AS x, lat + [-1, -1, 1, 1, -1][i] * half AS y FROM buildings, unnest(range(1, 6)) AS t(i))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel segments beside buildings: seg_id, ord, lat, lon, ring, area_m2, confidence, tile_id."""
    li = table(spark, sf_dir, "lineitem").select("*", *_place("l_partkey", 5003, 9001))
    shift = lambda a: ((F.col("l_orderkey") * a + F.col("l_linenumber") * 17) % 41 - 20) / F.lit(100000.0)
    rows = li.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), F.col("l_partkey").alias("osm_id"), (F.col("lat") + shift(13)).alias("lat"), (F.col("lon") + shift(7)).alias("lon"),
        (F.col("l_quantity") * F.lit(0.5)).alias("area_m2"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"), F.concat(F.lit("t"), (F.col("l_orderkey") % 97).cast("string")).alias("tile_id"), (F.col("l_quantity") / F.lit(1000000.0)).alias("half"),
    )
    h = F.col("half")
    corner = lambda sx, sy: F.array(F.col("lon") + sx * h, F.col("lat") + sy * h)
    return rows.withColumn("seg_id", (F.col("ok") * 8 + F.col("ln")) * 100000 + F.col("osm_id")).withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)))


SEGMENTS = """segments AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS seg_id, l_partkey AS osm_id, 1440e-2 + ((l_partkey * 5003) % 38000) / 100000e0 + ((l_orderkey * 13 + l_linenumber * 17) % 41 - 20) / 100000e0 AS lat,
 12092e-2 + ((l_partkey * 9001) % 21000) / 100000e0 + ((l_orderkey * 7 + l_linenumber * 17) % 41 - 20) / 100000e0 AS lon, l_quantity * 5e-1 AS area_m2, 1e0 - l_discount AS confidence, 't' || (l_orderkey % 97) AS tile_id, l_quantity / 1000000e0 AS half FROM lineitem)"""


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 octagons in five rows and columns, every other one with a hole: city, ord, polygons."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), F.col("n_nationkey").cast("long").alias("ord"))
    s, w = F.lit(14.40) + (F.col("ord") % 5) * F.lit(0.076), F.lit(120.92) + F.floor(F.col("ord") / 5) * F.lit(0.042)
    at = lambda fx, fy: F.array(w + F.lit(fx * 0.042), s + F.lit(fy * 0.076))
    outer = F.array(*[at(x, y) for x, y in OCTAGON])
    hole = F.array(*[at(x, y) for x, y in HOLE])
    return n.select("city", "ord", F.array(F.when(F.col("ord") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))).alias("polygons"))


OCTAGON = [(0.25, 0.0), (0.75, 0.0), (1.0, 0.25), (1.0, 0.75), (0.75, 1.0), (0.25, 1.0), (0.0, 0.75), (0.0, 0.25), (0.25, 0.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]
_points = ", ".join(f"({ring}, {i}, {(x * 0.042)!r}::DOUBLE, {(y * 0.076)!r}::DOUBLE)" for ring, pts in ((0, OCTAGON), (1, HOLE)) for i, (x, y) in enumerate(pts))
CITIES = f"""shape(ring, i, dx, dy) AS (VALUES {_points}),
city_points AS (SELECT n_name AS city, n_nationkey::BIGINT AS ord, ring, i, 12092e-2 + floor(n_nationkey / 5e0) * 42e-3 + dx AS x, 1440e-2 + (n_nationkey % 5) * 76e-3 + dy AS y FROM nation, shape WHERE ring = 0 OR n_nationkey % 2 = 0),
city_edges AS (SELECT a.city, a.ord, a.ring, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM city_points a JOIN city_points b ON a.city = b.city AND a.ring = b.ring AND a.i = b.i + 1)"""


def in_city(points: str, key: str, holes: str, name: str = "inside") -> str:
    """SQL of the CTE `name` (key, city, ord): the cities that hold each point."""
    having = {"ignore": "count(*) FILTER (ring = 0) % 2 = 1", "exclude": "count(*) FILTER (ring = 0) % 2 = 1 AND count(*) FILTER (ring = 1) % 2 = 0", "any_ring": "(count(*) FILTER (ring = 0) % 2 = 1 OR count(*) FILTER (ring = 1) % 2 = 1)"}[holes]
    return f"""{name} AS (SELECT p.{key}, e.city, e.ord FROM {points} p JOIN city_edges e ON (e.yi > p.lat) <> (e.yj > p.lat) AND p.lon < (e.xj - e.xi) * (p.lat - e.yi) / (e.yj - e.yi + 1e-12) + e.xi GROUP BY p.{key}, e.city, e.ord HAVING {having})"""


def haversine(a: str, b: str) -> str:
    return f"2e0 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def clear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that tell the classes apart for the most part, of the same examples: ord, src, y, score."""
    rows = scores(spark, sf_dir)
    return rows.withColumn("score", ((F.col("ord") * 7 + F.col("y")) % 560 + F.col("y") * 440) / F.lit(1000.0))


CLEAR_SCORES = """scores AS (SELECT d.doc_id AS ord, d.source AS src, l.quality AS y, ((d.doc_id * 7 + l.quality) % 560 + l.quality * 440) / 1000e0 AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored examples: ord, src, y, score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src"), "n_chars").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    return d.select(F.col("doc_id").alias("ord"), "src", F.col("quality").alias("y"), ((F.col("doc_id") * 7 + F.col("quality") * 150 + F.col("n_chars")) % 1000 / F.lit(1000.0)).alias("score"))


SCORES = """scores AS (SELECT d.doc_id AS ord, d.source AS src, l.quality AS y, ((d.doc_id * 7 + l.quality * 150 + d.n_chars) % 1000) / 1000e0 AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)"""
