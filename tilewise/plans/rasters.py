"""Queries over outlines, zones, raster windows, calibration by group, folds, negatives, contexts and shifts, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.operators import contours, evaluate, heads, lookup, sampling, spatial, zonal
from tilewise.operators.shared import new_path
from tilewise.sources import tiled_raster

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


def _mask(spark, d):
    """Masks of a few tiles: the pixels that an odd number of line items falls on."""
    rows = G.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tile"), (F.col("l_orderkey") * 7 % 48).alias("py"), (F.col("l_partkey") % 48).alias("px"))
    return rows.groupBy("tile", "py", "px").agg(F.count("*").alias("n")).where("n % 2 = 1")


#: Sides by the way they go (east, south, west, north): the pixel ahead, the one across, and where the side begins.
_WAYS = "(VALUES (0, 0, 1, -1, 0, 0, 0), (1, 1, 0, 0, 1, 0, 1), (2, 0, -1, 1, 0, 1, 1), (3, -1, 0, 0, -1, 1, 0)) w(side, ay, ax, oy, ox, cy, cx)"
_RINGS = f"""WITH RECURSIVE m AS (SELECT l_returnflag AS tile, l_orderkey * 7 % 48 AS py, l_partkey % 48 AS px FROM lineitem GROUP BY ALL HAVING count(*) % 2 = 1),
e AS (SELECT m.*, w.* FROM m, {_WAYS} WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.tile = m.tile AND o.py = m.py + oy AND o.px = m.px + ox)),
f AS (SELECT e.*, EXISTS (SELECT 1 FROM m o WHERE o.tile = e.tile AND o.py = e.py + ay AND o.px = e.px + ax) AS ahead, EXISTS (SELECT 1 FROM m o WHERE o.tile = e.tile AND o.py = e.py + ay + oy AND o.px = e.px + ax + ox) AS corner FROM e),
s AS (SELECT tile, (py * 1000 + px) * 4 + side AS id, px + cx AS x, py + cy AS y, (px + cx) * (py + cy + ay) - (px + cx + ax) * (py + cy) AS doubled,
 CASE WHEN NOT ahead THEN (py * 1000 + px) * 4 + (side + 1) % 4 WHEN NOT corner THEN ((py + ay) * 1000 + px + ax) * 4 + side ELSE ((py + ay + oy) * 1000 + px + ax + ox) * 4 + (side + 3) % 4 END AS next FROM f),
walk AS (SELECT tile, id AS ring, next, x, y, doubled, 0 AS place FROM s UNION ALL SELECT k.tile, k.ring, s.next, s.x, s.y, s.doubled, k.place + 1 FROM walk k JOIN s ON s.tile = k.tile AND s.id = k.next WHERE k.next > k.ring),
r AS (SELECT tile, ring FROM walk WHERE next = ring), g AS (SELECT k.*, count(*) OVER (PARTITION BY tile, ring) AS n FROM walk k JOIN r USING (tile, ring)),
p AS (SELECT tile, n AS n_sides, ring, (sum(doubled) // 2)::BIGINT AS area, string_agg(x || ' ' || y, ',' ORDER BY place) FILTER (place % ceil(n / 64e0) = 0) AS open, count(*) FILTER (place % ceil(n / 64e0) = 0)::INT AS n_points FROM g GROUP BY ALL)
SELECT tile, ring // 4000 AS py, ring // 4 % 1000 AS px, n_sides, area, n_points, open || ',' || split_part(open, ',', 1) AS points"""


def _named(rings):
    at = F.shiftright("ring", 2)
    low = F.lit((1 << 30) - 1)
    point = F.transform("points", lambda p: F.concat_ws(" ", p[0].cast("long").cast("string"), p[1].cast("long").cast("string")))
    return rings.select("tile", (F.shiftright(at, 30) - (1 << 28)).alias("py"), (at.bitwiseAND(low) - (1 << 28)).alias("px"), "n_sides", "area", "n_points", F.array_join(point, ",").alias("points"))


@query(_RINGS + " FROM p")
def q_mask_rings(spark, d):
    """Outlines of all parts of masks, followed in squares of 16 pixels and joined across them."""
    return _named(contours.rings(_mask(spark, d), ("tile",), size=16))


@query(_RINGS + " FROM p QUALIFY row_number() OVER (PARTITION BY tile ORDER BY n_sides DESC, ring) = 1")
def q_largest_ring(spark, d):
    return _named(contours.largest(contours.rings(_mask(spark, d), ("tile",)), ("tile",)))


GRID = zonal.Grid(14.78, 120.92, 0.002)
_PIX = "pix AS (SELECT (l_orderkey * 7919) % 190 AS py, (l_partkey * 104729) % 105 AS px, l_quantity AS value, CASE WHEN l_linenumber % 3 = 0 THEN 50 ELSE 10 END AS cls FROM lineitem)"
_CELLS = "spots AS (SELECT DISTINCT py, px, py * 1000 + px AS spot, 1478e-2 - (py + 5e-1) * 2e-3 AS lat, 12092e-2 + (px + 5e-1) * 2e-3 AS lon FROM pix)"


@query(f"""WITH {G.CITIES}, {_PIX}, {_CELLS}, {G.in_city('spots', 'spot', 'exclude')}, m AS (SELECT i.city, p.*, s.lat FROM inside i JOIN spots s USING (spot) JOIN pix p ON p.py = s.py AND p.px = s.px),
z AS (SELECT city, count(*) AS n, sum(value::DECIMAL(28,6))::DOUBLE / count(*) AS mean, count(*) FILTER (cls = 50) / count(*)::DOUBLE AS share, sum(CASE WHEN cls = 50 THEN (2e-3 * 11132e1) * (2e-3 * 11132e1) * cos(radians(lat)) END) / 1e6 AS km2 FROM m GROUP BY city)
SELECT n_name AS city, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(share, 6) AS share, round(coalesce(km2, 0), 4) AS km2 FROM nation LEFT JOIN z ON city = n_name""")
def q_zonal(spark, d):
    """Pixels, mean value, built-up share and area of each city, by runs of pixels."""
    k = lambda c, a, n: (F.col(c) * a % n)
    pixels = G.table(spark, d, "lineitem").select(k("l_orderkey", 7919, 190).alias("py"), k("l_partkey", 104729, 105).alias("px"), F.col("l_quantity").alias("value"), F.when(F.col("l_linenumber") % 3 == 0, 50).otherwise(10).alias("cls"))
    out = zonal.zonal(pixels, G.cities(spark, d), "city", GRID)
    return out.select("city", "n", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"), F.round("km2", 4).alias("km2"))


_TILE = 64
_LAND = f"""land AS (SELECT (l_orderkey * 7919) % 704 AS py, (l_partkey * 104729) % 376 AS px, CASE WHEN min(l_linenumber) % 3 = 0 THEN 50 ELSE 10 END AS cls FROM lineitem GROUP BY 1, 2),
kept AS (SELECT * FROM land WHERE (py // {_TILE} + px // {_TILE}) % 5 <> 0), tiles AS (SELECT DISTINCT py // {_TILE} AS ty, px // {_TILE} AS tx FROM kept),
cells AS (SELECT DISTINCT iy, ix, iy * 4 - 2 AS y0, iy * 4 + 5 AS y1, ix * 4 - 2 AS x0, ix * 4 + 5 AS x1 FROM log)"""


@query(f"""WITH {G.LOG}, {_LAND}, c AS (SELECT iy, ix, count(*) AS n, count(*) FILTER (cls = 50) AS hits FROM cells JOIN kept ON py BETWEEN y0 AND y1 AND px BETWEEN x0 AND x1 GROUP BY iy, ix),
k AS (SELECT DISTINCT iy, ix, 1 AS found FROM cells JOIN tiles ON ty * {_TILE} <= y1 AND (ty + 1) * {_TILE} > y0 AND tx * {_TILE} <= x1 AND (tx + 1) * {_TILE} > x0)
SELECT iy, ix, coalesce(n, 0) AS n, CASE WHEN found = 1 THEN round(coalesce(hits / n::DOUBLE, 0), 6) END AS share FROM cells LEFT JOIN k USING (iy, ix) LEFT JOIN c USING (iy, ix)""")
def q_window_share(spark, d):
    """Built-up share of the window of each scanned cell, from a raster in files of tiles, a fifth of which aren't there."""
    li = G.table(spark, d, "lineitem").select((F.col("l_orderkey") * 7919 % 704).alias("py"), (F.col("l_partkey") * 104729 % 376).alias("px"), "l_linenumber")
    land = li.groupBy("py", "px").agg(F.when(F.min("l_linenumber") % 3 == 0, 50.0).otherwise(10.0).alias("value")).withColumn("band", F.lit("landcover"))
    there = (F.floor(F.col("py") / _TILE) + F.floor(F.col("px") / _TILE)) % 5 != 0
    path = new_path(spark, "tiles")
    tiled_raster.write_tiles(land.where(there), path, _TILE).agg(F.sum("n")).collect()  # one number
    at = lambda c, shift: (F.col(c) * 4 + shift).cast("long")
    cells = G.log(spark, d).select("iy", "ix").distinct().select("iy", "ix", at("iy", -2).alias("y0"), at("iy", 5).alias("y1"), at("ix", -2).alias("x0"), at("ix", 5).alias("x1"))
    tiles = tiled_raster.read_tiles(spark, path, _TILE, F.col("band") == "landcover")
    return tiled_raster.window_share(cells, tiles, ["iy", "ix"], float(C.BUILT_UP_CLASS), _TILE).select("iy", "ix", "n", F.round("share", 6).alias("share"))


@query()
def q_group_platt(spark, d):
    """Calibration of each source's scores, all sources in the same steps."""
    return heads.calibrate(G.scores(spark, d).withColumn("z", F.col("score") * 4 - 2), "src")


def _labelled(spark, d):
    return G.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("double").alias("y"), F.concat(F.lit("s"), (F.col("vec_id") % 23).cast("string")).alias("src"))


@query()
def q_source_folds(spark, d):
    """Scores of five folds of whole sources."""
    e = _labelled(spark, d)
    return heads.out_of_fold(e.withColumn("fold", F.pmod(F.crc32("src"), F.lit(5)).cast("int")), "fold", "embedding", "y").select("vec_id", "src", "fold", "y", F.round("score", 5).alias("score"))


@query()
def q_leave_one_source(spark, d):
    """Scores of each source by a head that was fitted on the others."""
    return heads.out_of_fold(heads.by_source(_labelled(spark, d), "src"), "fold", "embedding", "y").select("vec_id", "src", "y", F.round("score", 5).alias("score"))


_AWAY = "NOT EXISTS (SELECT 1 FROM osm o WHERE abs(o.lat - {p}.lat) < 3e-3 AND abs(o.lon - {p}.lon) < 3e-3 AND {m} < 240)"


@query(f"""WITH {G.LOG}, {G.OSM}, t AS (SELECT event_type AS region, tile_id, min((lat, lon)) AS spot FROM log WHERE fetch_ok GROUP BY 1, 2), p AS (SELECT region, tile_id, spot[1] AS lat, spot[2] AS lon FROM t),
a AS (SELECT * FROM p WHERE {_AWAY.format(p='p', m=G.haversine('p', 'o'))}), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5('4244:' || tile_id), tile_id)::INT AS rank FROM a) SELECT region, tile_id, lat, lon, rank FROM r WHERE rank <= 300""")
def q_region_negatives(spark, d):
    return sampling.region_negatives(G.log(spark, d).withColumnRenamed("event_type", "region"), G.osm(spark, d))


_DRAW = "('0x' || substr(md5('42:{i}:' || i), 1, 12))::BIGINT / 281474976710656e0"


@query(f"""WITH {G.OSM}, n AS (SELECT count(*) AS wanted FROM supplier), drawn AS (SELECT i AS attempt, 1440e-2 + {_DRAW.format(i=0)} * (1478e-2 - 1440e-2) AS lat, 12092e-2 + {_DRAW.format(i=1)} * (12113e-2 - 12092e-2) AS lon FROM n, range(3 * wanted) r(i)),
a AS (SELECT * FROM drawn WHERE {_AWAY.format(p='drawn', m=G.haversine('drawn', 'o'))}), f AS (SELECT *, row_number() OVER (ORDER BY attempt) AS k, count(*) OVER () AS found FROM a)
SELECT attempt, round(lat, 9) AS lat, round(lon, 9) AS lon, wanted::INT AS wanted, CASE WHEN found < wanted THEN (3 * wanted) || ' draws left ' || found || ' of ' || wanted END AS reason FROM f, n WHERE k <= wanted""")
def q_random_points(spark, d):
    """As many random points as there are suppliers, away from all map tags."""
    out = sampling.random_points(G.osm(spark, d), G.table(spark, d, "supplier").count())
    return out.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query(f"""WITH {G.DET}, {G.OSM}, {G.CITIES}, pts AS (SELECT s_suppkey AS pid, 1440e-2 + ((s_suppkey * 3001) % 38000) / 100000e0 AS lat, 12092e-2 + ((s_suppkey * 9007) % 21000) / 100000e0 AS lon, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 99 ELSE s_nationkey END AS psgc FROM supplier),
{G.in_city('pts', 'pid', 'exclude')}, by_place AS (SELECT pid, arg_min(city, ord) AS city FROM inside GROUP BY pid), c AS (SELECT p.pid, coalesce(n_name, b.city) AS city FROM pts p LEFT JOIN nation ON psgc = n_nationkey LEFT JOIN by_place b ON b.pid = p.pid),
{G.in_city('det', 'ord', 'ignore', 'held').replace('p.ord, e.city, e.ord FROM', 'p.ord AS k, e.city, e.ord FROM', 1)}, f AS (SELECT k, arg_min(city, ord) AS city FROM held GROUP BY k),
n AS (SELECT city, count(*) FILTER (tier = 'high') AS n_high, count(*) FILTER (tier = 'candidate') AS n_candidate FROM f JOIN det ON det.ord = k GROUP BY city), r AS (SELECT city, row_number() OVER (ORDER BY n_high DESC, city) AS rank, count(*) OVER () AS ranked FROM n WHERE n_high > 0),
d AS (SELECT pid, osm_id, {G.haversine('p', 'o')} AS m FROM pts p, osm o), k AS (SELECT pid, string_agg(osm_id::VARCHAR, ',' ORDER BY m, osm_id) AS cases FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY pid ORDER BY m, osm_id) <= 3) GROUP BY pid),
t AS (SELECT pid, count(*) FILTER (tier = 'high') AS high_around, count(*) FILTER (tier = 'candidate') AS candidates_around FROM pts p JOIN det x ON {G.haversine('p', 'x')} <= 1500 GROUP BY pid)
SELECT p.pid, c.city, n_high, n_candidate, rank, ranked, cases, coalesce(high_around, 0) AS high_around, coalesce(candidates_around, 0) AS candidates_around FROM pts p LEFT JOIN c USING (pid) LEFT JOIN n ON n.city = c.city LEFT JOIN r ON r.city = c.city LEFT JOIN k USING (pid) LEFT JOIN t USING (pid)""")
def q_context(spark, d):
    """City, counts, rank, nearest cases and tiles around, of every point, by code or else by place."""
    s = G.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    points = s.select(k.alias("pid"), *G._place("s_suppkey", 3001, 9007), F.when(k % 3 == 0, None).when(k % 7 == 0, 99).otherwise(F.col("s_nationkey")).cast("long").alias("psgc"))
    cities = G.cities(spark, d).withColumn("psgc", F.col("ord"))
    found = spatial.first_containing(G.det(spark, d).select("ord", "lat", "lon", "tier"), cities.withColumnRenamed("ord", "city_ord"), "ord", "city_ord", "city", "ignore").where("city is not null")
    counts = found.groupBy("city").agg(F.count_if(F.col("tier") == "high").alias("n_high"), F.count_if(F.col("tier") == "candidate").alias("n_candidate")).withColumn("density", F.col("n_high").cast("double"))
    out = lookup.context(points, cities, counts, G.osm(spark, d).select(F.col("osm_id").alias("case_id"), "lat", "lon"), G.det(spark, d))
    return out.withColumn("cases", F.array_join(F.transform("cases", lambda c: c["case_id"].cast("string")), ","))


@query("""WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i), p AS (SELECT a.label, b.label AS other, 1 - sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS cosine, sqrt(sum(pow(a.m - b.m, 2))) AS euclidean FROM x a JOIN x b USING (i) GROUP BY 1, 2),
f AS (SELECT cosine AS floor FROM p WHERE label = 1 AND other = 0), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, n, round(r.cosine, 6) AS cosine, round(r.euclidean, 6) AS euclidean, round(g.cosine, 6) AS geo_cosine, round(floor, 6) AS floor, CASE WHEN g.cosine <= floor + 5e-3 THEN 'within-envelope' WHEN g.cosine > floor + 3e-2 THEN 'severe-OOD' ELSE 'moderate-shift' END AS verdict
FROM n JOIN (SELECT * FROM p WHERE other = 0) r USING (label) JOIN (SELECT * FROM p WHERE other = 1) g USING (label), f WHERE label > 1""")
def q_domain_shift(spark, d):
    out = evaluate.domain_shift(G.table(spark, d, "embeddings"), "label", "embedding", 0, 1)
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("cosine", "euclidean", "geo_cosine", "floor")], "verdict")
