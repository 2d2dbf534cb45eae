"""Queries over tiles, cities, map tags and buildings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo, scoring, text
from tilewise.operators import dedupe, gates, grid, lookup, rollup, spatial

from . import geography as G

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in_city(points: DataFrame, cities: DataFrame, holes: str) -> DataFrame:
    return spatial.first_containing(points, cities.withColumnRenamed("ord", "city_ord"), "ord", "city_ord", "city", holes, "outside")


DET_CITY = f"WITH {G.DET}, {G.CITIES}, {G.in_city('det', 'ord', 'ignore').replace('p.ord, e.city', 'p.ord AS pk, e.city', 1)}, first_city AS (SELECT pk, arg_min(city, ord) AS city FROM inside GROUP BY pk), placed AS (SELECT d.*, coalesce(f.city, 'outside') AS city FROM det d LEFT JOIN first_city f ON d.ord = f.pk)"
DET_CITY_HOLES = DET_CITY.replace(G.in_city("det", "ord", "ignore").split("HAVING ")[1], G.in_city("det", "ord", "exclude").split("HAVING ")[1])


@query(f"WITH {G.DET} SELECT ord, tier, score, lon - 11e-4 AS west, lat - 11e-4 AS south, lon + 11e-4 AS east, lat + 11e-4 AS north FROM det")
def q_tier_filter(spark: SparkSession, d: str) -> DataFrame:
    box = geo.tile_bbox(F.col("lat"), F.col("lon"))
    return G.det(spark, d).select("ord", "tier", "score", *[box[i].alias(n) for i, n in enumerate(("west", "south", "east", "north"))])


@query(f"WITH {G.DET} SELECT coalesce(count(*) FILTER (tier = 'high'), 0) AS n_high, coalesce(count(*) FILTER (tier = 'candidate'), 0) AS n_candidate, count(*) AS n FROM det")
def q_tier_totals(spark, d):
    return rollup.tier_totals(G.det(spark, d))


@query(f"WITH {G.LOG} SELECT tile_id, arg_max(score, ord) AS score, max(ord) AS ord FROM log WHERE fetch_ok GROUP BY tile_id")
def q_scan_lastwins(spark, d):
    return dedupe.keep_last(dedupe.scored(G.log(spark, d)), "tile_id", "ord").select("tile_id", "score", "ord")


@query(f"WITH {G.LOG} SELECT tile_id, arg_min(score, ord) AS score, min(ord) AS ord FROM log GROUP BY tile_id")
def q_scan_firstwins(spark, d):
    return dedupe.keep_first(G.log(spark, d), "tile_id", "ord").select("tile_id", "score", "ord")


_METRO = "SELECT i AS iy, j AS ix, printf('%.5f_%.5f', (1440e-2 + 216e-5 / 2e0) + i * 216e-5, (12092e-2 + 224e-5 / 2e0) + j * 224e-5) AS tile_id FROM range(176) a(i), range(94) b(j)"


@query(f"WITH {G.BOXES} SELECT area, iy, ix, printf('%.5f_%.5f', lat, lon) AS tile_id FROM cells")
def q_grid(spark, d):
    """The grids of all areas at once."""
    return grid.grids(G.boxes(spark, d), "area").select("area", "iy", "ix", "tile_id")


@query(f"""WITH {G.BOXES}, s AS (SELECT *, 240e0 / 111320e0 AS dy, (240e0 / 111320e0) / cos(radians((south + north) / 2)) AS dx FROM boxes)
SELECT area, i AS iy, j AS ix FROM s, range(20) a(i), range(20) b(j) WHERE i < ceil((north - (south + dy / 2)) / dy) AND j < ceil((east - (west + dx / 2)) / dx)""")
def q_grid_metric(spark, d):
    return grid.grids_metres(G.boxes(spark, d), "area").select("area", "iy", "ix")


@query(f"WITH {G.LOG}, grid AS ({_METRO}) SELECT * FROM grid WHERE tile_id NOT IN (SELECT tile_id FROM log)")
def q_grid_todo(spark, d):
    return grid.todo(grid.grid(spark), G.log(spark, d)).select("iy", "ix", "tile_id")


@query(f"""WITH {G.LOG}, p AS (SELECT ord, CASE WHEN ord % 2 = 0 THEN (1440e-2 + 216e-5 / 2e0) + iy * 216e-5 WHEN ord % 3 = 0 THEN lat + 1 ELSE lat END AS lat, CASE WHEN ord % 2 = 0 THEN (12092e-2 + 224e-5 / 2e0) + ix * 224e-5 ELSE lon END AS lon FROM log),
o AS (SELECT ord, lat, lon, (lat - (1440e-2 + 216e-5 / 2e0)) / 216e-5 AS a, (lon - (12092e-2 + 224e-5 / 2e0)) / 224e-5 AS b FROM p)
SELECT ord FROM o WHERE NOT (lat BETWEEN 1440e-2 AND 1478e-2 AND lon BETWEEN 12092e-2 AND 12113e-2) OR (abs(a - round_even(a, 0)) < 5e-5 AND abs(b - round_even(b, 0)) < 5e-5)""")
def q_grid_overlap_dedupe(spark, d):
    even, lat, lon = F.col("ord") % 2 == 0, F.lit(14.40 + 0.00216 / 2) + F.col("iy") * F.lit(0.00216), F.lit(120.92 + 0.00224 / 2) + F.col("ix") * F.lit(0.00224)
    rows = G.log(spark, d).select("ord", F.when(even, lat).when(F.col("ord") % 3 == 0, F.col("lat") + 1).otherwise(F.col("lat")).alias("lat"), F.when(even, lon).otherwise(F.col("lon")).alias("lon"))
    return grid.drop_overlap(rows).select("ord")


@query(DET_CITY + " SELECT city, count(*) FILTER (tier = 'high') AS n_high, count(*) FILTER (tier = 'candidate') AS n_candidate FROM placed GROUP BY city")
def q_city_counts(spark, d):
    return rollup.city_counts(_in_city(G.det(spark, d), G.cities(spark, d), "ignore"))


_STATUS = f"""near AS (SELECT h.ord, min({G.haversine('h', 'o')}) AS distance_m FROM det h, osm o GROUP BY h.ord)"""


def _with_status(spark, d, points):
    near = spatial.nearest_within(points.select("ord", "lat", "lon"), G.osm(spark, d).select("osm_id", "lat", "lon"), "ord", "osm_id", C.CONFIRMED_M)
    return points.join(near, "ord", "left").withColumn("status", F.when(F.col("osm_id").isNotNull(), "confirmed").otherwise("new"))


@query(DET_CITY_HOLES + f""", {G.OSM}, {_STATUS}, x AS (SELECT p.*, CASE WHEN n.distance_m <= 200 THEN 'confirmed' ELSE 'new' END AS status, CAST(score * 40e0 AS DECIMAL(28,6)) AS kwp FROM placed p LEFT JOIN near n USING (ord)),
ring_pts AS (SELECT city, ring, i, x, y, avg(y) FILTER (ring = 0) OVER (PARTITION BY city) AS my FROM city_points),
area AS (SELECT city, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area_km2 FROM (SELECT p.city, p.ring, abs(sum(p.x * (63710088e-4 * radians(1e0) * cos(radians(p.my))) * (q.y * (63710088e-4 * radians(1e0))) - q.x * (63710088e-4 * radians(1e0) * cos(radians(p.my))) * (p.y * (63710088e-4 * radians(1e0))))) / 2 AS a FROM ring_pts p JOIN ring_pts q ON p.city = q.city AND p.ring = q.ring AND q.i = p.i + 1 GROUP BY p.city, p.ring) GROUP BY city)
SELECT x.city, count(*) FILTER (tier = 'high') AS n_high, count(*) FILTER (tier = 'candidate') AS n_candidate, count(*) FILTER (tier = 'high' AND status = 'new') AS n_new_high, count(*) FILTER (tier = 'high' AND status = 'confirmed') AS n_confirmed_high,
coalesce(sum(kwp) FILTER (tier = 'high'), 0)::DOUBLE AS kwp_high, round(any_value(area_km2), 2) AS area_km2, round(count(*) FILTER (tier = 'high') / any_value(area_km2), 4) AS per_km2 FROM x LEFT JOIN area USING (city) GROUP BY x.city""")
def q_city_counts_holes(spark, d):
    cities = G.cities(spark, d)
    rows = _with_status(spark, d, _in_city(G.det(spark, d), cities, "exclude")).withColumn("kwp", F.col("score") * 40.0)
    out = rollup.city_detail(rows, cities.select("city", geo.polygon_area_km2(F.col("polygons")[0]).alias("area_km2")))
    return out.withColumn("area_km2", F.round("area_km2", 2)).withColumn("per_km2", F.round("per_km2", 4))


@query(f"""WITH {G.DET}, {G.BUILDINGS}, {G.CITIES}, {G.in_city('det', 'ord', 'any_ring', 't').replace('p.ord, e.city, e.ord FROM', 'p.ord AS k, e.city, e.ord FROM', 1)}, {G.in_city('buildings', 'osm_id', 'any_ring', 'b')},
tc AS (SELECT t.city, count(*) FILTER (d.tier = 'high') AS n_high, count(*) FILTER (d.tier = 'candidate') AS n_candidate FROM t JOIN det d ON d.ord = t.k GROUP BY t.city), bc AS (SELECT b.city, count(*) AS n_buildings, sum(g.kwp::DECIMAL(28,6))::DOUBLE AS sum_kwp FROM b JOIN buildings g USING (osm_id) GROUP BY b.city)
SELECT n_name AS city, coalesce(n_high, 0) AS n_high, coalesce(n_candidate, 0) AS n_candidate, coalesce(n_buildings, 0) AS n_buildings, coalesce(sum_kwp, 0) AS sum_kwp, coalesce(round(sum_kwp / n_buildings, 6), 0) AS mean_kwp
FROM nation LEFT JOIN tc ON tc.city = n_name LEFT JOIN bc ON bc.city = n_name""")
def q_city_saturation(spark, d):
    out = rollup.city_saturation(G.cities(spark, d), G.det(spark, d).select("lat", "lon", "tier"), G.buildings(spark, d).select("lat", "lon", "kwp"))
    return out.withColumn("mean_kwp", F.round("mean_kwp", 6))


@query(f"WITH {G.DET}, {G.OSM}, near AS (SELECT h.ord, min({G.haversine('h', 'o')}) AS distance_m FROM det h, osm o WHERE h.tier = 'high' GROUP BY h.ord) SELECT ord, round(distance_m, 3) AS distance_m, CASE WHEN distance_m <= 200 THEN 'confirmed' ELSE 'new' END AS status FROM near")
def q_osm_nearest(spark, d):
    out = spatial.nearest(G.det(spark, d).where("tier = 'high'"), G.osm(spark, d), "ord", "osm_id")
    return out.select("ord", F.round("distance_m", 3).alias("distance_m"), F.when(F.col("distance_m") <= C.CONFIRMED_M, "confirmed").otherwise("new").alias("status"))


@query(f"WITH {G.DET}, {G.OSM}, {_STATUS}, x AS (SELECT tier, CASE WHEN distance_m <= 200 THEN 'confirmed' ELSE 'new' END AS status FROM det JOIN near USING (ord)) SELECT coalesce(status, 'all') AS status, coalesce(tier, 'all') AS tier, count(*) AS n FROM x GROUP BY CUBE (status, tier)")
def q_osm_status_matrix(spark, d):
    return rollup.status_matrix(_with_status(spark, d, G.det(spark, d)))


@query(f"""WITH {G.OSM}, hot AS (SELECT o_orderkey AS k, o_custkey % 25 AS grp, 1440e-2 + ((o_orderkey * 7919) % 38000) / 100000e0 AS lat, 12092e-2 + ((o_orderkey * 104729) % 21000) / 100000e0 AS lon FROM orders WHERE o_orderpriority = '1-URGENT'),
p AS (SELECT h.k, o.osm_id, o.location, {G.haversine('h', 'o')} AS m FROM hot h JOIN osm o ON o.c_nationkey = h.grp), b AS (SELECT k, min(m) AS m, arg_min(location, m) AS location FROM p GROUP BY k)
SELECT h.k, round(b.m, 3) AS distance_m, CASE WHEN b.m <= 500 THEN b.location END AS label FROM hot h LEFT JOIN b USING (k)""")
def q_nearest_in_city(spark, d):
    o = G.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 25).cast("int").alias("grp"), *G._place("o_orderkey", 7919, 104729))
    tags = G.osm(spark, d).withColumnRenamed("c_nationkey", "grp")
    near = spatial.nearest_same(o, tags, "grp", "k", "osm_id").join(tags.select("osm_id", "location"), "osm_id", "left")
    return near.select("k", F.round("distance_m", 3).alias("distance_m"), F.when(F.col("distance_m") <= C.LABEL_M, F.col("location")).alias("label"))


@query(f"WITH {G.LOG}, {G.OSM}, p AS (SELECT o.osm_id, t.ord, {G.haversine('o', 't')} AS m FROM osm o JOIN log t ON abs(o.lat - t.lat) <= 3e-3 AND abs(o.lon - t.lon) <= 3e-3) SELECT osm_id, arg_min(ord, (m, ord)) AS ord, round(min(m), 3) AS distance_m FROM p WHERE m <= 170 GROUP BY osm_id")
def q_snap(spark, d):
    out = spatial.nearest_within(G.osm(spark, d).select("osm_id", "lat", "lon"), G.log(spark, d).select("ord", "lat", "lon"), "osm_id", "ord", C.SNAP_M)
    return out.withColumn("distance_m", F.round("distance_m", 3))


_HALO = f"""WITH {G.DET}, {G.BUILDINGS}, cells AS (SELECT i AS iy, j AS ix, 1440e-2 + 216e-5 / 2e0 + i * 216e-5 AS lat, 12092e-2 + 224e-5 / 2e0 + j * 224e-5 AS lon FROM range(176) a(i), range(94) b(j)),
t AS (SELECT c.iy, c.ix, count(*) FILTER (p.tier = 'high') AS n_high, count(*) FILTER (p.tier = 'candidate') AS n_cand FROM cells c JOIN det p ON abs(c.lat - p.lat) < 3e-3 AND abs(c.lon - p.lon) < 3e-3 WHERE {G.haversine('c', 'p')} <= 300 GROUP BY c.iy, c.ix),
b AS (SELECT c.iy, c.ix, count(*) AS n_buildings, sum(p.kwp::DECIMAL(28,6))::DOUBLE AS sum_kwp FROM cells c JOIN buildings p ON abs(c.lat - p.lat) < 3e-3 AND abs(c.lon - p.lon) < 3e-3 WHERE {G.haversine('c', 'p')} <= 300 GROUP BY c.iy, c.ix),
h AS (SELECT iy, ix, coalesce(n_high, 0) AS n_high, coalesce(n_cand, 0) AS n_cand, coalesce(n_buildings, 0) AS n_buildings, coalesce(sum_kwp, 0) AS sum_kwp FROM t FULL JOIN b USING (iy, ix)),
s AS (SELECT *, CASE WHEN n_buildings >= 8 OR sum_kwp >= 300 THEN 'saturated' WHEN n_buildings >= 3 OR sum_kwp >= 50 THEN 'growing' ELSE 'early' END AS saturation FROM h)"""


def _halo(spark, d):
    return rollup.halo(grid.grid(spark).select("iy", "ix", "lat", "lon"), G.det(spark, d), G.buildings(spark, d))


@query(_HALO + " SELECT * FROM s")
def q_halo(spark, d):
    return _halo(spark, d)


@query(_HALO + " SELECT saturation, count(*) AS n FROM s GROUP BY saturation")
def q_halo_tiers(spark, d):
    return _halo(spark, d).groupBy("saturation").agg(F.count("*").alias("n"))


@query(f"WITH {G.DET}, {G.OSM} SELECT ord FROM det WHERE NOT EXISTS (SELECT 1 FROM osm o WHERE abs(o.lat - det.lat) < 3e-3 AND abs(o.lon - det.lon) < 3e-3 AND {G.haversine('det', 'o')} < 240)")
def q_exclude_near(spark, d):
    return spatial.exclude_near(G.det(spark, d), G.osm(spark, d), "ord", C.EXCLUDE_M).select("ord")


_SEGB = f"""{G.SEGMENTS}, {G.BUILDINGS}, one AS (SELECT seg_id, any_value(lat) AS lat, any_value(lon) AS lon, any_value(half) AS half FROM segments GROUP BY seg_id),
pair AS (SELECT s.seg_id, b.osm_id, b.ord, least(s.lon + s.half, b.lon + b.half) - greatest(s.lon + -1 * s.half, b.lon + -1 * b.half) AS w, least(s.lat + s.half, b.lat + b.half) - greatest(s.lat + -1 * s.half, b.lat + -1 * b.half) AS h,
(s.lon >= b.lon + -1 * b.half AND s.lon < b.lon + b.half AND s.lat >= b.lat + -1 * b.half AND s.lat < b.lat + b.half) AS inside FROM one s JOIN buildings b ON abs(s.lat - b.lat) <= s.half + b.half AND abs(s.lon - b.lon) <= s.half + b.half)"""


@query(f"WITH {_SEGB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY inside DESC, CASE WHEN inside THEN ord END NULLS FIRST, CASE WHEN NOT inside THEN w * h END DESC NULLS LAST, ord) AS rn FROM pair WHERE inside OR (w > 0 AND h > 0)) SELECT seg_id, osm_id, inside FROM ranked WHERE rn = 1")
def q_segment_building(spark, d):
    squares = G.segments(spark, d).select("seg_id", "lon", "lat", "half"), G.buildings(spark, d).select("osm_id", "ord", "lon", "lat", "half")
    return spatial.best_building(*squares).select("seg_id", "osm_id", "inside")


def _rollup(spark, d):
    return rollup.building_rollup(G.segments(spark, d), G.buildings(spark, d))


_ROLL = f"""WITH {G.SEGMENTS}, {G.BUILDINGS}, a AS (SELECT osm_id, sum(round(area_m2, 6)::DECIMAL(28,6))::DOUBLE AS panel_raw_m2, max(confidence) AS confidence, count(*) AS n_segments, arg_min(seg_id, (-confidence, seg_id)) AS best_seg, list_sort(list_distinct(list(tile_id))) AS tile_ids FROM segments GROUP BY osm_id),
r AS (SELECT a.*, b.building_type, b.footprint_m2, least(panel_raw_m2, footprint_m2) AS panel_m2, least(panel_raw_m2, footprint_m2) * (1 / 6e0) AS kwp, b.building_type IN ('house', 'apartments') AS is_residential FROM a JOIN buildings b USING (osm_id))"""


@query(_ROLL + " SELECT osm_id, panel_raw_m2, confidence, n_segments, best_seg, array_to_string(tile_ids, ',') AS tiles, building_type, panel_m2, round(kwp, 6) AS kwp, is_residential FROM r")
def q_building_rollup(spark, d):
    return _rollup(spark, d).select("osm_id", "panel_raw_m2", "confidence", "n_segments", "best_seg", F.array_join("tile_ids", ",").alias("tiles"), "building_type", "panel_m2", F.round("kwp", 6).alias("kwp"), "is_residential")


@query(_ROLL + " SELECT building_type, count(*) AS n, sum(round(kwp, 6)::DECIMAL(28,6))::DOUBLE AS kwp FROM r WHERE is_residential GROUP BY building_type")
def q_residential_rollup(spark, d):
    return rollup.residential_rollup(_rollup(spark, d))


@query(_ROLL + ", x AS (SELECT osm_id, panel_m2, unnest(tile_ids) AS tile_id FROM r) SELECT tile_id, arg_min(osm_id, (-panel_m2, osm_id)) AS osm_id, max(panel_m2) AS panel_m2 FROM x GROUP BY tile_id")
def q_tile_anchor(spark, d):
    return rollup.tile_anchors(_rollup(spark, d))


@query(_ROLL + ", x AS (SELECT kwp, unnest(tile_ids) AS tile_id FROM r) SELECT tile_id, sum(round(kwp, 6)::DECIMAL(28,6))::DOUBLE AS kwp, count(*) AS n_buildings FROM x GROUP BY tile_id")
def q_tile_kwp_fanout(spark, d):
    return rollup.tile_kwp(_rollup(spark, d))


_TWO = f"""WITH {G.LOG}, a AS (SELECT tile_id, arg_max(score, ord) AS score FROM log WHERE fetch_ok GROUP BY 1), b AS (SELECT tile_id, arg_max(score2, ord) AS score FROM log WHERE fetch_ok AND ord % 10 <> 0 GROUP BY 1)"""
_T3 = "CASE WHEN {0} >= 0.85e0 THEN 'high' WHEN {0} >= 0.70e0 THEN 'candidate' ELSE 'below' END"


def _versions(spark, d):
    rows = dedupe.scored(G.log(spark, d))
    new = rows.where("ord % 10 <> 0").select("tile_id", "ord", F.col("score2").alias("score"))
    return dedupe.keep_last(rows, "tile_id", "ord"), dedupe.keep_last(new, "tile_id", "ord")


@query(_TWO + f" SELECT tile_id, a.score AS old_score, b.score AS new_score, {_T3.format('a.score')} AS old_tier, {_T3.format('b.score')} AS new_tier, round(b.score - a.score, 6) AS gain FROM a JOIN b USING (tile_id) WHERE {_T3.format('a.score')} <> {_T3.format('b.score')}")
def q_version_delta(spark, d):
    return dedupe.version_delta(*_versions(spark, d), lambda x: scoring.tier(x, "below")).withColumn("gain", F.round("gain", 6))


@query(_TWO + " SELECT b.tile_id, b.score, a.score AS old_score FROM b LEFT JOIN a USING (tile_id) WHERE b.score >= 0.85e0 AND coalesce(a.score, 0) < 0.85e0")
def q_newly_promoted(spark, d):
    return dedupe.newly_promoted(*_versions(spark, d)).select("tile_id", "score", "old_score")


@query(_TWO + f", g AS (SELECT tile_id, round(b.score - a.score, 6) AS gain FROM a JOIN b USING (tile_id) WHERE {_T3.format('a.score')} <> {_T3.format('b.score')}) SELECT * FROM g ORDER BY gain DESC, tile_id LIMIT 60")
def q_top_gains(spark, d):
    rows = dedupe.version_delta(*_versions(spark, d), lambda x: scoring.tier(x, "below"))
    return rows.select("tile_id", F.round("gain", 6).alias("gain")).orderBy(F.desc("gain"), "tile_id").limit(60)


@query(f"WITH {G.DET} SELECT user_id % 12 AS area, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'candidate') AS candidate, count(*) AS total FROM det GROUP BY 1")
def q_area_tier_pivot(spark, d):
    return rollup.area_tiers(G.det(spark, d).withColumn("area", F.col("user_id") % 12))


@query(f"WITH {G.CITIES}, c AS (SELECT city, avg(x) AS lon, avg(y) AS lat, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM city_points WHERE ring = 0 GROUP BY city) SELECT city, round(lon, 9) AS lon, round(lat, 9) AS lat, west, south, east, north FROM c")
def q_geom_bbox(spark, d):
    c, b = geo.ring_centroid(F.col("polygons")[0][0]), geo.bbox_of(F.col("polygons"))
    return G.cities(spark, d).select("city", F.round(c["lon"], 9).alias("lon"), F.round(c["lat"], 9).alias("lat"), *[b[n].alias(n) for n in ("west", "south", "east", "north")])


@query(f"""WITH {G.BUILDINGS}, m AS (SELECT *, avg(y) OVER (PARTITION BY osm_id) AS my FROM building_points), a AS (SELECT p.osm_id, abs(sum(p.x * (111320e0 * cos(radians(p.my))) * (q.y * 111320e0) - q.x * (111320e0 * cos(radians(p.my))) * (p.y * 111320e0))) / 2 AS a FROM m p JOIN m q ON p.osm_id = q.osm_id AND q.i = p.i + 1 GROUP BY p.osm_id) SELECT osm_id, round(a, 0) AS area_m2 FROM a""")
def q_polygon_area(spark, d):
    return G.buildings(spark, d).select("osm_id", F.round(geo.ring_area_m2(F.col("ring")), 0).alias("area_m2"))


@query(f"WITH {G.LOG} SELECT coalesce(a.ord, b.ord) AS ord, CASE WHEN a.ord IS NOT NULL AND b.ord IS NOT NULL THEN 'kept' WHEN a.ord IS NOT NULL THEN 'dropped' ELSE 'added' END AS change FROM (SELECT ord FROM log WHERE score >= 0.85e0) a FULL JOIN (SELECT ord FROM log WHERE score2 >= 0.85e0) b ON a.ord = b.ord")
def q_set_partition(spark, d):
    rows = G.log(spark, d)
    return dedupe.set_partition(rows.where(F.col("score") >= C.HIGH), rows.where(F.col("score2") >= C.HIGH), "ord")


@query("""WITH a AS (SELECT 1 AS p, 'customer' AS source, c_custkey AS k, c_custkey AS ord FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 2, 'supplier', s_suppkey, s_suppkey FROM supplier UNION ALL SELECT 3, 'part', p_partkey, p_partkey FROM part)
SELECT k, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, ord) AS rn FROM a) WHERE rn = 1""")
def q_priority_dedupe(spark, d):
    part = lambda t, c: G.table(spark, d, t).select(F.col(c).alias("k"), F.col(c).alias("ord"))
    return dedupe.by_priority([("customer", part("customer", "c_custkey").where("k % 3 = 0")), ("supplier", part("supplier", "s_suppkey")), ("part", part("part", "p_partkey"))], "k", "ord").select("k", "source")


@query(f"WITH {G.OSM} SELECT min(osm_id) AS osm_id FROM osm GROUP BY floor(lat * 100 + 5e-1), floor(lon * 100 + 5e-1)")
def q_round_dedupe(spark, d):
    return dedupe.by_place(G.osm(spark, d), "osm_id", 2).select("osm_id")


@query(f"WITH {G.DET} SELECT ord, tier, floor((rn - 1) / 9)::BIGINT AS page, (rn - 1) % 9 AS cell FROM (SELECT ord, tier, row_number() OVER (ORDER BY score DESC, ord) AS rn FROM det)")
def q_pages(spark, d):
    return lookup.pages(G.det(spark, d), [F.desc("score"), "ord"]).select("ord", "tier", "page", "cell")


@query(f"WITH {G.BUILDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY building_type ORDER BY footprint_m2 DESC, osm_id) AS rank FROM buildings WHERE footprint_m2 > 20 AND footprint_m2 < 2000) SELECT building_type, osm_id, footprint_m2, rank FROM r WHERE rank <= 3")
def q_topk_per_group(spark, d):
    rows = G.buildings(spark, d).where("footprint_m2 > 20 and footprint_m2 < 2000")
    return lookup.top_per_group(rows, "building_type", [F.desc("footprint_m2"), "osm_id"], 3).select("building_type", "osm_id", "footprint_m2", "rank")


@query("""WITH p AS (SELECT c_custkey AS pid, 1440e-2 + ((c_custkey * 5003) % 38000) / 100000e0 + 1e-5 AS lat, 12092e-2 + ((c_custkey * 9001) % 21000) / 100000e0 + 2e-5 AS lon FROM customer), """ + G.BUILDINGS + f""",
x AS (SELECT p.pid, b.*, {G.haversine('p', 'b')} AS m, (p.lon < b.lon + b.half AND p.lon >= b.lon + -1 * b.half AND p.lat < b.lat + b.half AND p.lat >= b.lat + -1 * b.half) AS inside, building_type IN ('house', 'apartments') AS home FROM p JOIN buildings b ON abs(p.lat - b.lat) < 3e-3 AND abs(p.lon - b.lon) < 3e-3),
l AS (SELECT *, CASE WHEN inside AND home THEN 0 WHEN inside THEN 1 WHEN home AND m < 50 THEN 2 ELSE 3 END AS level FROM x WHERE m <= 200) SELECT pid, osm_id, inside, level FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY level, CASE WHEN level <= 1 THEN footprint_m2 ELSE m END, osm_id) AS rn FROM l) WHERE rn = 1""")
def q_pick_building(spark, d):
    p = G.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), *G._place("c_custkey", 5003, 9001)).withColumn("lat", F.col("lat") + 1e-5).withColumn("lon", F.col("lon") + 2e-5)
    b = G.buildings(spark, d).withColumn("is_residential", F.col("building_type").isin(*C.RESIDENTIAL)).withColumnRenamed("footprint_m2", "area_m2")
    return lookup.pick_building(p, b.select("osm_id", "lat", "lon", "ring", "area_m2", "is_residential"))


@query(f"WITH {G.DET}, {G.OSM}, x AS (SELECT o.osm_id AS pid, t.ord AS tile, t.tier, {G.haversine('o', 't')} AS m FROM osm o JOIN det t ON abs(o.lat - t.lat) < 2e-2 AND abs(o.lon - t.lon) < 2e-2), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY tier <> 'high', m, tile) AS rank FROM x WHERE m <= 1500) SELECT pid, rank, tile, tier, round(m, 3) AS distance_m FROM r WHERE rank <= 8")
def q_nearby(spark, d):
    points = G.osm(spark, d).select(F.col("osm_id").alias("pid"), "lat", "lon")
    return lookup.nearby(points, G.det(spark, d).select(F.col("ord").alias("tile"), "tier", "lat", "lon")).withColumn("distance_m", F.round("distance_m", 3))


@query("""WITH b AS (SELECT p_partkey AS osm_id, p_size * p_size * 12e-1 AS a, 1440e-2 + ((p_partkey * 5003) % 38000) / 100000e0 AS lat FROM part), e AS (SELECT osm_id, a * 8e-1 AS usable_m2, a * 8e-1 * 15e-2 AS kwp, a * 8e-1 * 15e-2 * 1350e0 * (1e0 + (1465e-2 - lat) * 15e-3) AS annual_kwh FROM b),
f AS (SELECT *, annual_kwh * 12e0 AS s, kwp * 55000e0 AS cost FROM e) SELECT osm_id, round(usable_m2, 6) AS usable_m2, round(kwp, 6) AS kwp, round(annual_kwh, 4) AS annual_kwh, round(s, 3) AS annual_savings, round(cost, 4) AS cost, round(cost / nullif(s, 0), 6) AS payback_years, round(least(1e0, annual_kwh / 7200e0), 6) AS offset_share, round(s * (1 - pow(995e-3, 25)) / 5e-3 - cost, 0) AS lifetime FROM f""")
def q_roof_economics(spark, d):
    e = scoring.roof_economics(F.col("footprint_m2"), F.col("lat"), F.lit(12.0), monthly_kwh=F.lit(600.0))
    digits = {"usable_m2": 6, "kwp": 6, "annual_kwh": 4, "annual_savings": 3, "cost": 4, "payback_years": 6, "offset": 6}
    cols = [F.round(e[k], n).alias("offset_share" if k == "offset" else k) for k, n in digits.items()]
    return G.buildings(spark, d).select("osm_id", *cols, F.round(scoring.lifetime_value(e["annual_savings"], e["cost"]), 0).alias("lifetime"))


@query("""WITH b AS (SELECT p_partkey AS osm_id, p_size * p_size * 12e-1 AS a, 1440e-2 + ((p_partkey * 5003) % 38000) / 100000e0 AS lat, 1e0 + (p_partkey % 9) / 2e0 AS r FROM part),
s AS (SELECT osm_id, greatest(0, least(100, floor(5e-1 * least(100e0, 30e0 + 35e0 * log10(greatest(20e0, a) / 50)) + 3e-1 * (70e0 + (1465e-2 - lat) * 15e-1) + 2e-1 * greatest(40e0, 90e0 - greatest(0e0, r - 3) * 5) + 5e-1))) AS score FROM b)
SELECT osm_id, score::BIGINT AS score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 35 THEN 'limited' ELSE 'poor fit' END AS band FROM s""")
def q_roof_score(spark, d):
    rows = G.buildings(spark, d).select("osm_id", scoring.roof_score(F.col("footprint_m2"), F.col("lat"), F.lit(1.0) + (F.col("osm_id") % 9) / F.lit(2.0)).cast("long").alias("score"))
    return rows.withColumn("band", scoring.score_band(F.col("score")))


@query(f"""WITH {G.SEGMENTS}, {G.BUILDINGS} SELECT osm_id, CASE WHEN osm_id IN (SELECT osm_id FROM segments WHERE confidence >= 0.95e0) THEN 'already-has' WHEN footprint_m2 > 500 THEN 'commercial' WHEN footprint_m2 * 8e-1 < 25 THEN 'too-small' WHEN NOT lat < 147e-1 THEN 'outside-franchise'
WHEN osm_id % 3 = 0 THEN 'saturated' WHEN osm_id % 3 = 1 THEN 'growing' ELSE 'early' END AS verdict FROM buildings""")
def q_verdict_tree(spark, d):
    has = G.segments(spark, d).where("confidence >= 0.95").select("osm_id").distinct().withColumn("has", F.lit(True))
    rows = G.buildings(spark, d).join(has, "osm_id", "left")
    tier = F.element_at(F.array(*map(F.lit, ("saturated", "growing", "early"))), (F.col("osm_id") % 3 + 1).cast("int"))
    return rows.select("osm_id", scoring.roof_verdict(F.coalesce("has", F.lit(False)), F.col("footprint_m2"), F.col("footprint_m2") * 0.8, F.col("lat") < 14.7, tier).alias("verdict"))


@query("""WITH q AS (SELECT DISTINCT 'nation ' || (s_suppkey % 30) AS q FROM supplier), n AS (SELECT n_name AS name, n_nationkey AS ord, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k FROM nation), a AS (SELECT q, regexp_replace(lower(q), '[^a-z0-9]', '', 'g') AS k FROM q),
p AS (SELECT a.q, n.name, n.ord, CASE WHEN n.k = a.k THEN 0 WHEN starts_with(n.k, a.k) THEN 1 ELSE 2 END AS kind FROM a JOIN n ON contains(n.k, a.k) OR contains(a.k, n.k)) SELECT q, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY kind, ord) AS rn FROM p) WHERE rn = 1""")
def q_city_lookup(spark, d):
    asked = G.table(spark, d, "supplier").select(F.concat(F.lit("nation "), (F.col("s_suppkey") % 30).cast("string")).alias("q")).distinct()
    return lookup.match_names(asked, G.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) / (1e0 + c_nationkey % 4) AS density FROM customer GROUP BY 1) SELECT k, density, row_number() OVER (ORDER BY density DESC, k) AS rank, count(*) OVER () AS total, round(100e0 - (row_number() OVER (ORDER BY density DESC, k) - 1) / count(*) OVER () * 100, 9) AS bar FROM c WHERE density > 0""")
def q_density_rank(spark, d):
    rows = G.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).select("k", (F.col("n") / (F.lit(1.0) + F.col("k") % 4)).alias("density"))
    return lookup.density_rank(rows, "k", "density").withColumn("bar", F.round("bar", 9))


@query(f"WITH {G.BUILDINGS} SELECT osm_id FROM buildings WHERE building_type IN ('house', 'apartments')")
def q_gate_residential(spark, d):
    return gates.residential_leaks(G.buildings(spark, d).withColumn("is_residential", F.lit(False))).select("osm_id")


@query("""WITH f AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN ['address'] WHEN event_id % 70 = 0 THEN ['owner', 'occupant'] ELSE [] END AS ks FROM events), g AS (SELECT event_id, CASE WHEN event_id % 50 = 0 AND event_id % 70 = 0 THEN ['address'] ELSE ks END AS ks FROM f) SELECT event_id, unnest(ks) AS private_key FROM g""")
def q_gate_private_keys(spark, d):
    k = F.col("event_id")
    props = F.when(k % 50 == 0, '{"k": 1, "address": "x"}').when(k % 70 == 0, '{"owner": "a", "k": 2, "occupant": "b"}').otherwise(F.col("props"))
    return gates.private_keys(G.table(spark, d, "events").withColumn("props", props), "event_id", "props")


@query(_ROLL + """, v AS (SELECT osm_id, panel_raw_m2 > footprint_m2 + 1 AS a, confidence > 0.99e0 AS b, n_segments < 20 AS c FROM r) SELECT osm_id, rule FROM (SELECT osm_id, 'panel over footprint' AS rule FROM v WHERE a UNION ALL SELECT osm_id, 'confidence' FROM v WHERE b UNION ALL SELECT osm_id, 'few segments' FROM v WHERE c)""")
def q_gate_buildings(spark, d):
    rules = {"panel over footprint": F.col("panel_raw_m2") > F.col("footprint_m2") + 1, "confidence": F.col("confidence") > 0.99, "few segments": F.col("n_segments") < 20}
    return gates.violations(_rollup(spark, d), "osm_id", rules)


@query("SELECT lower(event_type) AS event_type, (props->>'k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long") % 10
    return G.table(spark, d, "events").groupBy(F.lower("event_type").alias("event_type"), k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def q_json_keys(spark, d):
    return G.table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN contains(t, 'ground-mount') OR contains(t, 'ground mount') THEN 'ground_mount' WHEN contains(t, 'false positive') THEN 'blue_roof_fp' WHEN contains(t, 'real rooftop solar') OR contains(t, 'confirmed') THEN 'rooftop' WHEN contains(t, 'blue') AND contains(t, 'roof') AND NOT contains(t, 'real rooftop') THEN 'blue_roof_fp' ELSE 'unknown' END AS verdict FROM (SELECT conv_id, turn, lower(CASE WHEN turn % 4 = 0 THEN text || ' a Blue Roof' WHEN turn % 4 = 1 THEN 'Confirmed: ' || text ELSE text END) AS t FROM conversations)")
def q_verdict_class(spark, d):
    t = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" a Blue Roof"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("Confirmed: "), F.col("text"))).otherwise(F.col("text"))
    return G.table(spark, d, "conversations").select("conv_id", "turn", text.verdict_class(t).alias("verdict"))


@query(r"""WITH h AS (SELECT page_id, html || '<script>1 installations</script><p>In all <b>' || (page_id * 37) || ',456</b> installations and ' || (page_id % 90) || '.5 MW of power</p>' AS h FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM h)
SELECT page_id, replace(nullif(regexp_extract(t, '(?i)(\d{1,3}(?:[,]\d{3})*|\d+)\s*(?:net[- ]metering)?\s*installations?', 1), ''), ',', '')::DOUBLE AS installations, nullif(regexp_extract(t, '(?i)(\d{1,4}(?:\.\d+)?)\s*(?:MW|megawatts?)', 1), '')::DOUBLE AS megawatts, length(t) AS n_chars FROM t""")
def q_scrape_numbers(spark, d):
    """The figures in whole pages, each with a sentence of its own at the end."""
    html = F.concat("html", F.lit("<script>1 installations</script><p>In all <b>"), (F.col("page_id") * 37).cast("string"), F.lit(",456</b> installations and "), (F.col("page_id") % 90).cast("string"), F.lit(".5 MW of power</p>"))
    rows = G.table(spark, d, "pages").select("page_id", text.plain_text(html).alias("t"))
    return rows.select("page_id", text.first_number(F.col("t"), text.INSTALLATIONS).alias("installations"), text.first_number(F.col("t"), text.MEGAWATTS).alias("megawatts"), F.length("t").cast("long").alias("n_chars"))


@query("""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Santa ' || p_name WHEN 1 THEN 'Sto. ' || p_name WHEN 2 THEN p_name || ' City' ELSE p_name END AS name FROM part)
SELECT k, array_to_string(list_sort(list_distinct([name, CASE WHEN ends_with(name, ' City') THEN regexp_replace(name, ' City$', '') ELSE name || ' City' END, CASE WHEN starts_with(name, 'Santa ') THEN 'Sta. ' || substr(name, 7) WHEN starts_with(name, 'Sto. ') THEN 'Santo ' || substr(name, 6) ELSE name END])), '|') AS variants FROM n""")
def q_name_variants(spark, d):
    k, p = F.col("p_partkey") % 4, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("Santa "), p)).when(k == 1, F.concat(F.lit("Sto. "), p)).when(k == 2, F.concat(p, F.lit(" City"))).otherwise(p)
    return G.table(spark, d, "part").withColumn("name", name).select(F.col("p_partkey").alias("k"), F.array_join(text.name_variants(F.col("name")), "|").alias("variants"))


@query("""WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders) SELECT k, CASE WHEN regexp_full_match(month, '\\d{4}-(0[1-9]|1[0-2])') THEN strftime(strptime(month || '-01', '%Y-%m-%d'), '%B %Y') ELSE month END AS label FROM m""")
def q_month_label(spark, d):
    month = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return G.table(spark, d, "orders").withColumn("month", month).select(F.col("o_orderkey").alias("k"), text.month_label(F.col("month")).alias("label"))


@query("""SELECT o_orderkey AS k, date_trunc('quarter', o_orderdate)::DATE AS starts, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS ends FROM orders""")
def q_quarter_dates(spark, d):
    rows = G.table(spark, d, "orders").withColumn("quarter", F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    starts, ends = text.quarter_dates(F.col("quarter"))
    return rows.select(F.col("o_orderkey").alias("k"), starts.alias("starts"), ends.alias("ends"))
