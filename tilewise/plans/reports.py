"""Queries behind reports, selections and gates of single runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewise.functions import scoring
from tilewise.operators import assembly, evaluate, gates, grid, raster, rollup, sampling

from . import geography as G
from .detection import DET_CITY, _in_city

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PRF = "tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall"
_COUNTS = "count(*) FILTER (y = 1 AND score >= t) AS tp, count(*) FILTER (y = 0 AND score >= t) AS fp, count(*) FILTER (y = 1 AND score < t) AS fn, count(*) FILTER (y = 0 AND score < t) AS tn"


@query(f"""WITH {G.CLEAR_SCORES}, t AS (SELECT DISTINCT 'high_precision' AS point, score AS t FROM scores UNION ALL SELECT 'target', i / 100e0 FROM range(101) r(i) UNION ALL SELECT 'deployed', 85e-2),
c AS (SELECT point, t, {_COUNTS} FROM t, scores GROUP BY point, t), p AS (SELECT *, {_PRF} FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY t) AS k FROM p WHERE point = 'deployed' OR precision >= CASE WHEN point = 'target' THEN 99e-2 ELSE 9e-1 END AND recall >= 5e-1)
SELECT point, round(t, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f WHERE k = 1""")
def q_operating_points(spark, d):
    rows = evaluate.operating_points(G.clear_scores(spark, d))
    return rows.select("point", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"""WITH {G.SCORES}, r AS (SELECT y, ord, score, row_number() OVER (PARTITION BY y ORDER BY CASE WHEN y = 0 THEN -score ELSE score END, ord) AS rank FROM scores) SELECT y, ord, score, rank FROM r WHERE rank <= 15""")
def q_worst(spark, d):
    return evaluate.worst(G.scores(spark, d), "ord")


@query(DET_CITY + ", c AS (SELECT city, coalesce(count(*) FILTER (tier = 'high'), 0) AS n_high, coalesce(count(*) FILTER (tier = 'candidate'), 0) AS n_candidate FROM placed GROUP BY city) SELECT *, n_high AS n_new_high, 0e0 AS sum_kwp_high, row_number() OVER (ORDER BY n_high DESC, city) AS place FROM c")
def q_city_report(spark, d):
    return rollup.city_report(_in_city(G.det(spark, d), G.cities(spark, d), "ignore"))


@query(f"WITH {G.BUILDINGS}, k AS (SELECT building_type, ord % 40 AS area, sum(round(CASE WHEN ord % 3 = 0 THEN kwp ELSE 0e0 END, 6)::DECIMAL(28,6))::DOUBLE AS sum_kwp FROM buildings GROUP BY 1, 2), n AS (SELECT building_type || '_' || area AS name, sum_kwp FROM k) SELECT name, sum_kwp FROM n WHERE sum_kwp > 0 ORDER BY sum_kwp DESC, name LIMIT 15")
def q_top_capacity(spark, d):
    kwp = F.when(F.col("ord") % 3 == 0, F.col("kwp")).otherwise(0.0)
    rows = G.buildings(spark, d).groupBy("building_type", (F.col("ord") % 40).alias("area")).agg(rollup.exact_sum(kwp).alias("sum_kwp"))
    return rollup.top_capacity(rows.select(F.concat_ws("_", "building_type", F.col("area").cast("string")).alias("name"), "sum_kwp"), "name", "sum_kwp")


@query(f"WITH {G.BUILDINGS} SELECT count(*) AS n, sum(round(kwp, 6)::DECIMAL(28,6))::DOUBLE AS sum_kwp, max(kwp) AS max_kwp FROM buildings")
def q_capacity_summary(spark, d):
    return rollup.capacity_summary(G.buildings(spark, d))


@query(f"WITH {G.BUILDINGS}, k AS (SELECT building_type, ord % 40 AS area, sum(round(kwp, 6)::DECIMAL(28,6))::DOUBLE AS kwp FROM buildings GROUP BY 1, 2) SELECT building_type, area, kwp, CASE WHEN kwp >= 500 THEN 'utility' WHEN kwp >= 100 THEN 'large' WHEN kwp >= 30 THEN 'medium' ELSE 'small' END AS size FROM k")
def q_size_words(spark, d):
    rows = G.buildings(spark, d).groupBy("building_type", (F.col("ord") % 40).alias("area")).agg(rollup.exact_sum(F.col("kwp")).alias("kwp"))
    return rows.withColumn("size", scoring.size_word(F.col("kwp")))


@query(f"""WITH {G.SEGMENTS}, {G.LOG}, t AS (SELECT 't' || (ord % 97) AS tile_id, bool_or(ord % 401 = 0) AS confirmed FROM log GROUP BY 1), b AS (SELECT osm_id, max(confidence) - (osm_id % 20) / 100e0 AS s FROM segments GROUP BY osm_id), j AS (SELECT s.osm_id, bool_or(confirmed) AS c FROM segments s LEFT JOIN t USING (tile_id) GROUP BY 1)
SELECT osm_id, CASE WHEN s < 85e-2 THEN 'candidate' WHEN c THEN 'confirmed' ELSE 'new' END AS status FROM b JOIN j USING (osm_id)""")
def q_status_at_cut(spark, d):
    tiles = G.log(spark, d).select(F.concat(F.lit("t"), (F.col("ord") % 97).cast("string")).alias("tile_id"), (F.col("ord") % 401 == 0).alias("confirmed"))
    of = G.segments(spark, d).groupBy("osm_id").agg((F.max("confidence") - F.col("osm_id") % 20 / F.lit(100.0)).alias("tile_score"), F.collect_set("tile_id").alias("tile_ids"))
    return rollup.building_status(of, tiles)


@query(f"WITH {G.BOXES} SELECT area, iy, ix FROM cells QUALIFY row_number() OVER (PARTITION BY area ORDER BY iy, ix) <= 5")
def q_grid_limit(spark, d):
    """The first five cells of each area's grid."""
    return sampling.bottom_k(grid.grids(G.boxes(spark, d), "area"), "area", [F.col("iy"), F.col("ix")], 5).select("area", "iy", "ix")


@query(f"""WITH {G.OSM}, e AS (SELECT osm_id, CASE WHEN osm_id % 5 = 0 THEN NULL WHEN osm_id % 5 = 1 THEN 0e0 ELSE lat END AS lat0, CASE WHEN osm_id % 5 = 0 THEN NULL WHEN osm_id % 5 = 1 THEN 0e0 ELSE lon END AS lon0, CASE WHEN osm_id % 7 = 0 THEN NULL ELSE lat END AS clat, CASE WHEN osm_id % 7 = 0 THEN NULL ELSE lon END AS clon FROM osm)
SELECT osm_id, coalesce(nullif(lat0, 0), clat) AS lat, coalesce(nullif(lon0, 0), clon) AS lon FROM e WHERE coalesce(nullif(lat0, 0), clat) IS NOT NULL""")
def q_placed(spark, d):
    k = F.col("osm_id")
    own = lambda c: F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, 0.0).otherwise(F.col(c)).alias(c)
    rows = G.osm(spark, d).select("osm_id", own("lat"), own("lon"), F.when(k % 7 != 0, F.struct("lat", "lon")).alias("center"))
    return assembly.placed(rows).select("osm_id", "lat", "lon")


@query(f"WITH {G.OSM}, b AS (SELECT location AS name, c_nationkey AS relation, (max(lat) - min(lat)) * (max(lon) - min(lon)) AS area FROM osm GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY area, relation) AS k FROM b) SELECT name, relation, round(area, 9) AS area FROM r WHERE k = 1")
def q_smallest_relation(spark, d):
    return assembly.smallest_relation(G.osm(spark, d).select(F.col("location").alias("name"), F.col("c_nationkey").alias("relation"), "lat", "lon")).withColumn("area", F.round("area", 9))


@query(f"WITH {G.LOG}, w AS (SELECT DISTINCT tile_id FROM log WHERE score >= 9e-1) SELECT tile_id, max(ord) AS ord FROM log WHERE tile_id IN (SELECT tile_id FROM w) GROUP BY tile_id")
def q_holdout_rows(spark, d):
    rows = G.log(spark, d)
    return assembly.holdout_rows(rows, rows.where("score >= 0.9"), "tile_id", "ord")


_POLYGONS = "p AS (SELECT s_nationkey AS code, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS geometry FROM supplier WHERE s_suppkey % 4 <> 1), l AS (SELECT code, last(geometry ORDER BY ord) AS geometry FROM p GROUP BY code)"


@query(f"WITH {_POLYGONS} SELECT n_nationkey AS code, n_name AS city, geometry FROM nation JOIN l ON code = n_nationkey WHERE geometry IS NOT NULL UNION ALL SELECT n_nationkey, NULL, NULL FROM nation LEFT JOIN l ON code = n_nationkey WHERE geometry IS NULL")
def q_city_geometry(spark, d):
    p = G.table(spark, d, "supplier").where("s_suppkey % 4 <> 1").select(F.col("s_nationkey").alias("code"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("geometry"))
    found, skipped = assembly.with_geometry(G.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("city")), p, "code")
    return found.select("code", "city", "geometry").unionByName(skipped.select("code", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("geometry")))


_RASTERS = "(VALUES ('a', 2, 12e0, 120e0, 145e-1, 123e0), ('b', 1, 145e-1, 120e0, 15e0, 1210e-1), ('c', 3, 14e0, 121e0, 147e-1, 122e0)) r(raster, ord, south, west, north, east)"


@query(f"WITH {G.OSM} SELECT osm_id, arg_min(raster, ord) AS raster FROM osm JOIN {_RASTERS} ON lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY osm_id")
def q_first_raster(spark, d):
    rasters = spark.createDataFrame([("a", 2, 12.0, 120.0, 14.5, 123.0), ("b", 1, 14.5, 120.0, 15.0, 121.0), ("c", 3, 14.0, 121.0, 14.7, 122.0)], "raster string, ord int, south double, west double, north double, east double")
    return assembly.first_raster(G.osm(spark, d).select("osm_id", "lat", "lon"), rasters, "osm_id")


@query("""WITH x AS (SELECT user_id AS px, CASE WHEN event_id % 2 = 0 THEN 'nir' ELSE 'swir' END AS band, avg(event_id % 1000 - 900) AS delta, bool_or(user_id % 3 <> 0) AS built FROM events GROUP BY 1, 2), w AS (SELECT px, max(delta) FILTER (band = 'nir') AS nir, max(delta) FILTER (band = 'swir') AS swir FROM x WHERE built GROUP BY px) SELECT px, round(nir, 6) AS nir, round(swir, 6) AS swir FROM w WHERE nir < -250 AND swir < -250""")
def q_fingerprint(spark, d):
    e = G.table(spark, d, "events").select(F.col("user_id").alias("px"), F.when(F.col("event_id") % 2 == 0, "nir").otherwise("swir").alias("band"), (F.col("event_id") % 1000 - 900).cast("double").alias("delta"))
    rows = e.groupBy("px", "band").agg(F.avg("delta").alias("delta")).withColumn("built", F.col("px") % 3 != 0)
    return raster.fingerprint(rows, ["px"]).select("px", F.round("nir", 6).alias("nir"), F.round("swir", 6).alias("swir"))


@query(f"""WITH {G.BUILDINGS}, {G.SEGMENTS}, s AS (SELECT osm_id, sum(area_m2) AS panel, max(confidence) AS confidence, count(*) AS n FROM segments GROUP BY osm_id), b AS (SELECT osm_id, footprint_m2, coalesce(panel, 0e0) AS panel, coalesce(confidence, 0e0) * CASE WHEN osm_id % 50 = 0 THEN 2 ELSE 1 END AS confidence, coalesce(n, 0) AS n, osm_id % 17 = 0 AS open, osm_id % 19 = 0 AS short FROM buildings LEFT JOIN s USING (osm_id))
SELECT osm_id, rule FROM (SELECT osm_id, unnest([CASE WHEN short THEN 'ring too short' END, CASE WHEN open AND NOT short THEN 'ring isn''t closed' END, CASE WHEN footprint_m2 <= 0 THEN 'no area' END, CASE WHEN panel > footprint_m2 + 1 THEN 'panel over footprint' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN n < 1 THEN 'no segment' END]) AS rule FROM b) WHERE rule IS NOT NULL""")
def q_gate_building_rules(spark, d):
    s = G.segments(spark, d).groupBy("osm_id").agg(F.sum("area_m2").alias("panel_m2"), F.max("confidence").alias("confidence"), F.count("*").alias("n_segments"))
    k = F.col("osm_id")
    ring = F.when(k % 19 == 0, F.array(F.element_at("ring", 1), F.element_at("ring", 2), F.element_at("ring", 1))).when(k % 17 == 0, F.slice("ring", 1, 4)).otherwise(F.col("ring"))
    rows = G.buildings(spark, d).select("osm_id", ring.alias("ring"), "footprint_m2").join(s, "osm_id", "left").na.fill(0.0, ["panel_m2", "confidence"]).na.fill(0, ["n_segments"])
    return gates.violations(rows.withColumn("confidence", F.col("confidence") * F.when(k % 50 == 0, 2).otherwise(1)), "osm_id", gates.building_rules())


@query("SELECT count(*) FILTER (quality = 0) AS n, greatest(0, 200 - count(*) FILTER (quality = 0)) AS more, greatest(0, 200 - count(*) FILTER (quality = 0)) * 5 AS made FROM labels")
def q_top_up(spark, d):
    n = G.table(spark, d, "labels").agg(F.count_if(F.col("quality") == 0)).first()[0]
    return spark.createDataFrame([(n, *assembly.top_up(n))], "n long, more long, made long")
