"""Queries behind published layers and interactive pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo, scoring, text
from tilewise.operators import composite, grid, rollup, spatial

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


@query(f"WITH {G.DET} SELECT count(*) FILTER (tier = 'high') AS tiles, round(sum(round(score * 40e0, 6)::DECIMAL(28,6)) FILTER (tier = 'high')::DOUBLE, 4) AS kwp, count(DISTINCT user_id % 25) FILTER (tier = 'high') AS areas, max(score) AS best FROM det")
def q_hero_strip(spark, d):
    high = F.col("tier") == "high"
    kwp = rollup.exact_sum(F.when(high, F.col("score") * 40.0))
    return G.det(spark, d).agg(F.count_if(high).alias("tiles"), F.round(kwp, 4).alias("kwp"), F.count_distinct(F.when(high, F.col("user_id") % 25)).alias("areas"), F.max("score").alias("best"))


@query(f"WITH {G.DET} SELECT ord, round((score * 40e0)::DECIMAL(28,6), 1)::DECIMAL(28,1)::VARCHAR || ' kWp' AS label, CASE WHEN score * 40e0 >= 38 THEN 'large' WHEN score * 40e0 >= 32 THEN 'medium' ELSE 'small' END AS size FROM det")
def q_capacity_labels(spark, d):
    kwp = F.col("score") * 40.0
    shown = F.round(kwp.cast("decimal(28,6)"), 1).cast("string")
    return G.det(spark, d).select("ord", F.concat(shown, F.lit(" kWp")).alias("label"), F.when(kwp >= 38, "large").when(kwp >= 32, "medium").otherwise("small").alias("size"))


@query(f"WITH {G.SEGMENTS}, {G.LOG}, t AS (SELECT 't' || (ord % 97) AS tile_id, max(score) AS score, bool_or(ord % 5 = 0) AS confirmed FROM log GROUP BY 1), b AS (SELECT DISTINCT osm_id, tile_id FROM segments), j AS (SELECT osm_id, min(score) AS low, bool_or(confirmed AND score >= 0.99e0) AS conf FROM b JOIN t USING (tile_id) GROUP BY osm_id) SELECT osm_id, CASE WHEN low < 0.97e0 THEN 'candidate' WHEN conf THEN 'confirmed' ELSE 'new' END AS status FROM j")
def q_building_status(spark, d):
    t = G.log(spark, d).groupBy(F.concat(F.lit("t"), (F.col("ord") % 97).cast("string")).alias("tile_id")).agg(F.max("score").alias("score"), F.bool_or(F.col("ord") % 5 == 0).alias("confirmed"))
    j = G.segments(spark, d).select("osm_id", "tile_id").distinct().join(t, "tile_id").groupBy("osm_id").agg(F.min("score").alias("low"), F.bool_or(F.col("confirmed") & (F.col("score") >= 0.99)).alias("conf"))
    return j.select("osm_id", F.when(F.col("low") < 0.97, "candidate").when(F.col("conf"), "confirmed").otherwise("new").alias("status"))


@query(f"WITH {G.BUILDINGS} SELECT osm_id, round(1 / greatest(cos(radians(lat)), 1e-9), 4) AS aspect FROM buildings")
def q_aspect_ratio(spark, d):
    b = geo.bbox_of(F.array(F.array(F.col("ring"))))
    width, height = (b["east"] - b["west"]) * F.cos(F.radians(F.col("lat"))) * C.METRES_PER_DEGREE, (b["north"] - b["south"]) * C.METRES_PER_DEGREE
    return G.buildings(spark, d).select("osm_id", F.round(scoring.aspect_ratio(width, height), 4).alias("aspect"))


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT k, round(least(1e0, greatest(0e0, n / (SELECT max(n) * 1e0 FROM c))), 9) AS shade FROM c")
def q_density_shade(spark, d):
    rows = G.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    top = rows.agg(F.max("n").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("k", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n") / F.col("top"))), 9).alias("shade"))


@query("SELECT c_custkey AS k, CASE WHEN m < 100 THEN 'at a mapped panel' WHEN m < 200 THEN 'near a mapped panel (' || m || ' m)' ELSE 'no mapped panel' END AS hint FROM (SELECT c_custkey, (c_custkey * 37) % 400 AS m FROM customer)")
def q_distance_hint(spark, d):
    m = F.col("c_custkey") * 37 % 400
    return G.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(m < 100, "at a mapped panel").when(m < 200, F.concat(F.lit("near a mapped panel ("), m.cast("string"), F.lit(" m)"))).otherwise("no mapped panel").alias("hint"))


@query("SELECT doc_id, starts_with(sha256(coalesce(text, '')), '0') AS ok FROM documents")
def q_hash_prefix(spark, d):
    return G.table(spark, d, "documents").select("doc_id", text.hash_matches(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "0").alias("ok"))


@query(f"WITH {G.BOXES} SELECT area, iy, ix, round(lon - 112e-5, 7) AS west, round(lat + 108e-5, 7) AS north, 5 AS points FROM cells")
def q_cell_rings(spark, d):
    ring = geo.cell_ring(F.col("lat"), F.col("lon"))
    return grid.grids(G.boxes(spark, d), "area").select("area", "iy", "ix", F.round(ring[0][0], 7).alias("west"), F.round(ring[2][1], 7).alias("north"), F.size(ring).alias("points"))


@query(f"WITH {G.SEGMENTS} SELECT seg_id, round(lon - 11e-4 + (seg_id % 400) / 400e0 * 22e-4, 7) AS west, round(lat + 11e-4 - (seg_id % 300) / 400e0 * 22e-4, 7) AS north FROM segments")
def q_pixel_to_lonlat(spark, d):
    x, y = geo.pixel_to_lonlat(F.col("seg_id") % 400, F.col("seg_id") % 300, F.col("lat"), F.col("lon"), 400)
    return G.segments(spark, d).select("seg_id", F.round(x, 7).alias("west"), F.round(y, 7).alias("north"))


@query("SELECT c_custkey AS k, 200 + (c_custkey % 7) * 20 AS x, 200 - (c_custkey % 5) * 20 AS y FROM customer")
def q_lonlat_to_pixel(spark, d):
    """Points a little inside pixels that are known."""
    k, deg = F.col("c_custkey"), F.lit(2 * C.HALF_WINDOW / 400)
    lon, lat = F.lit(121.0), F.lit(14.5)
    x, y = geo.lonlat_to_pixel(lon + (k % 7 * 20 + F.lit(0.5)) * deg, lat + (k % 5 * 20 - F.lit(0.5)) * deg, lat, lon, 400)
    return G.table(spark, d, "customer").select(k.alias("k"), x.cast("long").alias("x"), y.cast("long").alias("y"))


@query(f"WITH {G.OSM} SELECT osm_id, floor((lat - 1440e-2) / 216e-5)::BIGINT AS iy, floor((lon - 12092e-2) / 224e-5)::BIGINT AS ix FROM osm WHERE floor((lat - 1440e-2) / 216e-5) BETWEEN 0 AND 175 AND floor((lon - 12092e-2) / 224e-5) BETWEEN 0 AND 93")
def q_cell_of_point(spark, d):
    """The grid cell that holds each map tag, by an equi-join on the cell's numbers."""
    at = G.osm(spark, d).select("osm_id", F.floor((F.col("lat") - 14.40) / C.STRIDE_LAT).alias("iy"), F.floor((F.col("lon") - 120.92) / C.STRIDE_LON).alias("ix"))
    return at.join(grid.grid(spark).select("iy", "ix"), ["iy", "ix"]).select("osm_id", "iy", "ix")


@query(f"WITH {G.SEGMENTS}, {G.LOG} SELECT DISTINCT osm_id FROM segments WHERE tile_id IN (SELECT 't' || (ord % 97) FROM log WHERE user_id % 25 = 3 AND score >= 0.99e0)")
def q_buildings_of_area(spark, d):
    tiles = G.log(spark, d).where("user_id % 25 = 3 and score >= 0.99").select(F.concat(F.lit("t"), (F.col("ord") % 97).cast("string")).alias("tile_id")).distinct()
    return G.segments(spark, d).join(tiles, "tile_id", "left_semi").select("osm_id").distinct()


@query(f"WITH {G.LOG}, {G.OSM} SELECT DISTINCT log.tile_id FROM log JOIN (SELECT printf('%.5f_%.5f', (1440e-2 + 216e-5 / 2e0) + (osm_id % 176) * 216e-5, (12092e-2 + 224e-5 / 2e0) + (osm_id % 94) * 224e-5) AS tile_id FROM osm) o ON o.tile_id = log.tile_id")
def q_key_join(spark, d):
    o = G.osm(spark, d).select(geo.tile_id(F.lit(14.40 + 0.00216 / 2) + (F.col("osm_id") % 176) * F.lit(0.00216), F.lit(120.92 + 0.00224 / 2) + (F.col("osm_id") % 94) * F.lit(0.00224)).alias("tile_id")).distinct()
    return G.log(spark, d).select("tile_id").distinct().join(o, "tile_id")


@query(f"WITH {G.OSM}, c AS (SELECT s_suppkey AS case_id, 1440e-2 + ((s_suppkey * 6007) % 38000) / 100000e0 AS lat, 12092e-2 + ((s_suppkey * 7001) % 21000) / 100000e0 AS lon FROM supplier), x AS (SELECT o.osm_id AS pid, c.case_id, {G.haversine('o', 'c')} AS m FROM osm o, c), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY m, case_id) AS rank FROM x) SELECT pid, case_id, rank, round(m, 3) AS distance_m FROM r WHERE rank <= 3")
def q_nearest_cases(spark, d):
    """The three nearest of all case studies to each map tag."""
    cases = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), *G._place("s_suppkey", 6007, 7001))
    points = G.osm(spark, d).select(F.col("osm_id").alias("pid"), "lat", "lon")
    return spatial.nearest_k(points, cases, "pid", "case_id", 3).select("pid", "case_id", "rank", F.round("distance_m", 3).alias("distance_m"))


@query("SELECT l_suppkey AS k, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS coverage, max(l_discount) AS top FROM lineitem GROUP BY 1")
def q_mask_coverage(spark, d):
    return G.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("coverage"), F.max("l_discount").alias("top"))


@query("WITH s AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS px, bool_or(l_linestatus = 'F' AND l_discount = 0) AS y FROM lineitem GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (px >= 100) AS flagged, round(count(*) FILTER (px >= 100 AND y) / nullif(count(*) FILTER (px >= 100), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (px >= 100 AND y) / nullif(count(*) FILTER (y), 0)::DOUBLE, 6) AS recall FROM s")
def q_flagged_rate(spark, d):
    s = G.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("px"), F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_discount") == 0)).alias("y"))
    flag = F.col("px") >= 100
    div = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return s.agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), div(F.count_if(flag & F.col("y")), F.count_if(flag)).alias("precision"), div(F.count_if(flag & F.col("y")), F.count_if(F.col("y"))).alias("recall"))


@query("SELECT s_suppkey AS k, s_acctbal AS x FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 10")
def q_bottom10(spark, d):
    rows = G.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    return composite.top(rows, 10, "x", "k", descending=False)


@query(f"WITH {G.DET} SELECT ord, tier, score FROM det WHERE score >= 0.9e0 ORDER BY score DESC, ord LIMIT 15")
def q_top_tiles(spark, d):
    return G.det(spark, d).where("score >= 0.9").select("ord", "tier", "score").orderBy(F.desc("score"), "ord").limit(15)


@query("SELECT event_id, list_sort(list_filter(['a', 'k', 'z'], lambda x: NOT list_contains(json_keys(props), x)))[1] AS missing FROM events")
def q_missing_keys(spark, d):
    gone = F.array_sort(F.array_except(F.array(*map(F.lit, ("a", "k", "z"))), F.json_object_keys("props")))
    return G.table(spark, d, "events").select("event_id", gone[0].alias("missing"))


@query(f"WITH {G.LOG} SELECT DISTINCT tile_id, split_part(tile_id, '_', 1)::DOUBLE AS lat, split_part(tile_id, '_', 2)::DOUBLE AS lon FROM log")
def q_parse_tile_ids(spark, d):
    part = lambda i: F.split_part("tile_id", F.lit("_"), F.lit(i)).try_cast("double")
    return G.log(spark, d).select("tile_id").distinct().select("tile_id", part(1).alias("lat"), part(2).alias("lon"))


@query("SELECT s_suppkey AS k, 'roof_' || printf('%04d', s_suppkey % 10000) AS id, regexp_replace(regexp_replace(s_name, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM supplier")
def q_ids_and_slugs(spark, d):
    return G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("roof_"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0")).alias("id"), text.slug(F.col("s_name")).alias("slug"))


@query("SELECT n_name AS city FROM nation ORDER BY n_name LIMIT 10")
def q_sorted_names(spark, d):
    return G.table(spark, d, "nation").select(F.col("n_name").alias("city")).orderBy(F.collate("city", "UNICODE")).limit(10)


@query("SELECT region, count(*) AS n, count(*) FILTER (kind = 'high') AS n_high FROM (SELECT 'r' || (s_suppkey % 3) AS region, 'high' AS kind FROM supplier UNION ALL SELECT 'c' || (c_custkey % 4), 'low' FROM customer) GROUP BY region")
def q_union_regions(spark, d):
    a = G.table(spark, d, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("region"), F.lit("high").alias("kind"))
    b = G.table(spark, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 4).cast("string")).alias("region"), F.lit("low").alias("kind"))
    return a.unionByName(b).groupBy("region").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "high").alias("n_high"))
