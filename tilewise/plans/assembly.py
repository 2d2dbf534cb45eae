"""Queries over training sources, caches, polygons from lines, sub-tiles, lookups and household rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo, scoring, text
from tilewise.operators import assembly, composite, dedupe, evaluate, gates, rollup, spatial

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


@query(f"""WITH {G.OSM}, x AS (SELECT osm_id AS key, 1 AS y, lat, lon FROM osm WHERE osm_id % 4 = 0 AND osm_id % 9 <> 0), n AS (SELECT osm_id AS key, 0 AS y, lat, lon FROM osm WHERE osm_id % 4 <> 0 AND osm_id % 9 <> 0)
SELECT 'pos_' || printf('%04d', row_number() OVER (ORDER BY key)) AS src, key, y FROM x UNION ALL SELECT 'neg_' || printf('%04d', row_number() OVER (ORDER BY key)), key, y FROM n""")
def q_training_sources(spark, d):
    o = G.osm(spark, d).withColumnRenamed("osm_id", "key")
    parts = [("pos", o.where("key % 4 = 0").withColumn("y", F.lit(1))), ("neg", o.where("key % 4 <> 0").withColumn("y", F.lit(0)))]
    return assembly.training_sources(parts, o.where("key % 9 = 0")).select("src", "key", "y")


@query("SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, greatest(1, floor(count(*) FILTER (quality = 1) * 32 / greatest(1, count(*) FILTER (quality = 0))))::BIGINT AS repeat_neg FROM labels")
def q_balance(spark, d):
    return assembly.balance(G.table(spark, d, "labels").withColumnRenamed("quality", "y"))


@query("SELECT c_custkey AS k, v AS variant FROM customer, range(4) t(v)")
def q_augmentations(spark, d):
    rows = assembly.augmentations(G.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    return rows.where("turns between 0 and 3 and brightness between 0.85 and 1.15").select("k", F.col("variant").cast("long").alias("variant"))


@query("SELECT count(*) FILTER (starts_with(source, 'src1')) AS src1, count(*) FILTER (starts_with(source, 'src2')) AS src2, count(*) AS n FROM documents")
def q_prefix_counts(spark, d):
    return assembly.prefix_counts(G.table(spark, d, "documents"), "source", ["src1", "src2"])


@query("""WITH a AS (SELECT c_custkey AS k FROM customer) SELECT a.k, coalesce(s.s_name, p.p_name) AS value, CASE WHEN s.s_name IS NOT NULL THEN 'supplier' WHEN p.p_name IS NOT NULL THEN 'part' END AS found_in FROM a LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = a.k LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON p_partkey = a.k""")
def q_first_source(spark, d):
    asked = G.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    s = G.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value"))
    p = G.table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("value"))
    return assembly.first_source(asked, "k", [("supplier", s), ("part", p)])


@query("""WITH n AS (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' City' ELSE '' END AS name, n_nationkey AS area FROM nation), q AS (SELECT DISTINCT 'NATION_' || (s_suppkey % 30) AS q FROM supplier) SELECT q, name, area FROM q JOIN n ON name = q OR name = q || ' City'""")
def q_name_search(spark, d):
    names = G.table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" City"))).otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("area"))
    asked = G.table(spark, d, "supplier").select(F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 30).cast("string")).alias("q")).distinct()
    return assembly.by_variants(asked, names, text.name_variants).select("q", "name", "area")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE p_size END::BIGINT AS v FROM part")
def q_with_cache(spark, d):
    rows = G.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    cache = rows.where("k % 2 = 0").select("k", F.lit(-1).cast("long").alias("v"))
    return assembly.with_cache(rows, cache, "k", lambda r: r)


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def q_without_polygon(spark, d):
    other = G.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))
    return assembly.without_match(G.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), other, "k")


@query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_carry_labels(spark, d):
    before = G.table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    return assembly.carry_labels(G.table(spark, d, "documents").select("doc_id"), before, "doc_id")


@query("SELECT s_suppkey AS k, r AS row, c AS col, c * 133 AS left, r * 133 AS top, (c + 1) * 133 AS right, (r + 1) * 133 AS bottom FROM supplier, range(3) a(r), range(3) b(c)".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def q_sub_tiles(spark, d):
    return assembly.sub_tiles(G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("""WITH b AS (SELECT p_partkey AS k, (p_partkey * 7) % 300 AS x0, (p_partkey * 11) % 300 AS y0, (p_partkey * 7) % 300 + p_size AS x1, (p_partkey * 11) % 300 + p_size * 2 AS y1 FROM part), s AS (SELECT *, least(400, ceil(greatest(x1 - x0, y1 - y0) * 17e-1))::INT AS side FROM b)
SELECT k, side, greatest(0, least(400 - side, floor((x0 + x1 - side) / 2e0)))::INT AS cx0, greatest(0, least(400 - side, floor((y0 + y1 - side) / 2e0)))::INT AS cy0 FROM s""")
def q_context_box(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    b = G.table(spark, d, "part").select(p.alias("k"), (p * 7 % 300).alias("x0"), (p * 11 % 300).alias("y0"), (p * 7 % 300 + s).alias("x1"), (p * 11 % 300 + s * 2).alias("y1"))
    return assembly.context_box(b).select("k", "side", "cx0", "cy0")


@query("""WITH m AS (SELECT l_suppkey AS k, l_orderkey % 400 AS x, l_partkey % 400 AS y FROM lineitem) SELECT k, count(*) AS area_px, round(121e0 - 11e-4 + min(x) / 400e0 * 22e-4, 9) AS west, round(145e-1 + 11e-4 - min(y) / 400e0 * 22e-4, 9) AS north FROM m GROUP BY k""")
def q_mask_box(spark, d):
    m = G.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 400).alias("x"), (F.col("l_partkey") % 400).alias("y"), F.lit(14.5).alias("lat"), F.lit(121.0).alias("lon"))
    r = assembly.mask_box(m, "k")
    return r.select("k", "area_px", F.round(F.col("ring")[0][0], 9).alias("west"), F.round(F.col("ring")[2][1], 9).alias("north"))


@query("""WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey AS p, floor(l_extendedprice + 5e-1)::BIGINT % 40000 AS area_px, (l_partkey % 100) / 100e0 AS clip, (l_suppkey % 100) / 100e0 AS color, 144e-1 + l_suppkey / 1000e0 AS lat FROM lineitem), c AS (SELECT *, 6e-1 * clip + 4e-1 * color AS confidence FROM s WHERE area_px BETWEEN 250 AND 28800)
SELECT k, p, round(confidence, 6) AS confidence, round(area_px * pow(2 * 11e-4 * 111320e0 * cos(radians(lat)) / 400, 2) * 15e-2, 4) AS kwp FROM c WHERE confidence >= 0.70e0""")
def q_segment_gate(spark, d):
    li = G.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_partkey").alias("p"), (F.floor(F.col("l_extendedprice") + 0.5) % 40000).alias("area_px"), (F.col("l_partkey") % 100 / F.lit(100.0)).alias("clip"), (F.col("l_suppkey") % 100 / F.lit(100.0)).alias("color"), (F.lit(14.4) + F.col("l_suppkey") / F.lit(1000.0)).alias("lat"))
    return assembly.segment_gate(li, 400, 0.18).select("k", "p", F.round("confidence", 6).alias("confidence"), F.round("kwp", 4).alias("kwp"))


@query("SELECT n_nationkey::BIGINT AS rel, 1 AS polygons, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS rings, 9 AS points FROM nation")
def q_polygonize(spark, d):
    """The cities' rings, cut into lines and shuffled, and put together again."""
    c = G.cities(spark, d).select(F.col("ord").alias("rel"), F.posexplode(F.col("polygons")[0]).alias("r", "ring"))
    e = c.select("rel", F.when(F.col("r") == 0, "outer").otherwise("inner").alias("role"), "ring", F.explode(F.sequence(F.lit(1), F.size("ring") - 1)).alias("i"))
    line = F.slice("ring", F.col("i"), F.lit(2))
    e = e.select("rel", "role", F.pmod(F.xxhash64("rel", "role", "i"), F.lit(1000)).alias("ord"), F.when(F.col("i") % 2 == 0, F.reverse(line)).otherwise(line).alias("line"))
    p = assembly.polygonize(e)
    return p.select("rel", F.size("polygons").alias("polygons"), F.size(F.col("polygons")[0]).alias("rings"), F.size(F.col("polygons")[0][0]).alias("points"))


@query("""WITH x AS (SELECT c_nationkey AS k, c_custkey AS o, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS b FROM customer), f AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS filled FROM x) SELECT k, arg_min(o, (-filled, o)) AS o, max(filled) AS filled FROM f GROUP BY k""")
def q_partial_choice(spark, d):
    k = F.col("c_custkey")
    x = G.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), k.alias("o"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 5 == 0, F.col("c_acctbal")).alias("b"))
    return assembly.partial_choice(x, "k", "o", ["a", "b"]).select("k", "o", "filled")


@query("SELECT o_orderpriority AS name, array_to_string(list_sort(list_distinct(list(strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate)))), ',') AS quarters FROM orders GROUP BY 1")
def q_manifest(spark, d):
    o = G.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("q"))
    part = lambda c: o.where(c).groupBy("name").agg(F.collect_set("q").alias("quarters"))
    return assembly.quarter_manifest(part(F.col("q") < "1996Q1"), part(F.col("q") >= "1995Q1")).select("name", F.array_join("quarters", ",").alias("quarters"))


@query(f"WITH {G.DET} SELECT ord, 'https://tiles.example/export?bbox=' AS base, CASE WHEN fetch_ok THEN 1 ELSE 0 END AS ok FROM det")
def q_export_url(spark, d):
    u = geo.export_url("https://tiles.example/export", F.col("lat"), F.col("lon"), 400)
    return G.det(spark, d).select("ord", F.substring(u, 1, 34).alias("base"), F.when(u.rlike(r"bbox=[0-9.]+%2C[0-9.]+%2C[0-9.]+%2C[0-9.]+&bboxSR=3857"), 1).otherwise(0).alias("ok"))


@query(f"WITH {G.OSM} SELECT osm_id, location, CASE WHEN location = 'automobile' THEN 'ground' WHEN location = 'building' THEN 'solar' ELSE 'other' END AS kind FROM osm")
def q_solar_tags(spark, d):
    loc = F.col("location")
    tags = F.create_map(F.lit("location"), F.when(loc == "automobile", "ground").otherwise("roof"), F.lit("power"), F.lit("generator"), F.lit("generator:source"), F.when(loc == "building", "solar").otherwise("wind"))
    rows = G.osm(spark, d).withColumn("tags", tags)
    return rows.select("osm_id", "location", F.when(text.is_ground_mount(F.col("tags")), "ground").when(text.tag_is_solar(F.col("tags")), "solar").otherwise("other").alias("kind"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'cafe' WHEN 2 THEN 'house' ELSE 'bakery' END AS type, p_partkey % 4 = 2 AS residential FROM part")
def q_building_type(spark, d):
    k = F.col("p_partkey") % 4
    null = F.lit(None).cast("string")
    tags = F.create_map(F.lit("building"), F.when(k == 2, "house").otherwise("yes"), F.lit("amenity"), F.when(k == 0, "school").when(k == 1, "cafe").otherwise(null), F.lit("shop"), F.when(k == 3, "bakery").otherwise(null))
    rows = G.table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.building_type(tags).alias("type"))
    return rows.withColumn("residential", F.col("type").isin(*C.RESIDENTIAL))


@query("""SELECT p_partkey AS k, round(v, 6) AS v, round(s, 6) AS s FROM (SELECT p_partkey, greatest(r, g, b) AS v, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS s FROM (SELECT p_partkey, (p_partkey * 7) % 256 / 255e0 AS r, (p_partkey * 11) % 256 / 255e0 AS g, (p_partkey * 13) % 256 / 255e0 AS b FROM part))""")
def q_hsv(spark, d):
    k = F.col("p_partkey")
    _, s, v = scoring.hsv(*[k * m % 256 / F.lit(255.0) for m in (7, 11, 13)])
    return G.table(spark, d, "part").select(k.alias("k"), F.round(v, 6).alias("v"), F.round(s, 6).alias("s"))


@query("""WITH m AS (SELECT c_custkey AS k, 1 + c_custkey % 6 AS n, (c_custkey * 13) % 900 AS kwh FROM customer), r AS (SELECT * FROM (VALUES (1, 80, 180), (2, 120, 280), (3, 180, 380), (4, 240, 480), (5, 300, 580), (6, 380, 700)) t(n, lo, hi)) SELECT k, CASE WHEN kwh < lo THEN 'below typical' WHEN kwh > hi THEN 'above typical' ELSE 'typical' END AS label FROM m JOIN r USING (n)""")
def q_usage_label(spark, d):
    k = F.col("c_custkey")
    low, high = (F.create_map(*[F.lit(x) for n, b in C.USUAL_KWH.items() for x in (n, b[i])]) for i in (0, 1))
    rows = G.table(spark, d, "customer").select(k.alias("k"), (k % 6 + 1).cast("int").alias("n"), (k * 13 % 900).alias("kwh"))
    return rows.select("k", F.when(F.col("kwh") < low[F.col("n")], "below typical").when(F.col("kwh") > high[F.col("n")], "above typical").otherwise("typical").alias("label"))


@query("SELECT c_custkey AS k, array_to_string(list_slice(list_distinct_ordered, 1, 3), ', ') AS label FROM (SELECT c_custkey, list_filter([c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, 'NATION_' || c_nationkey, 'PH'], lambda x: x <> '') AS list_distinct_ordered FROM customer)")
def q_address_label(spark, d):
    parts = [F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), F.lit("PH")]
    return G.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.address_label(*parts).alias("label"))


@query("SELECT n_nationkey AS k, round((120.92e0 + floor(n_nationkey / 5e0) * 42e-3) + 21e-3, 9) AS lon, round((14.40e0 + (n_nationkey % 5) * 76e-3) + 38e-3, 9) AS lat FROM nation")
def q_representative_point(spark, d):
    p = geo.representative_point(F.col("polygons"))
    return G.cities(spark, d).select(F.col("ord").cast("int").alias("k"), F.round(p["lon"], 9).alias("lon"), F.round(p["lat"], 9).alias("lat"))


@query(f"WITH {G.BUILDINGS} SELECT osm_id, 2 * greatest(60e0, (half * 111000e0) + 60) AS side_m FROM buildings".replace("2 * greatest(60e0, (half * 111000e0) + 60) AS side_m", "round(2 * greatest(60e0, half * 111000e0 + 60), 3) AS side_m"))
def q_padded_box(spark, d):
    b = geo.padded_bbox(F.col("ring"))
    return G.buildings(spark, d).select("osm_id", F.round((b["north"] - b["south"]) * 111_000, 3).alias("side_m"))


@query(f"WITH {G.LOG}, x AS (SELECT tile_id, arg_max(score, ord) AS score FROM log WHERE fetch_ok GROUP BY 1), c AS (SELECT tile_id, least(1e0, max(score2)) AS sc FROM log WHERE ord % 3 = 0 GROUP BY 1) SELECT CASE WHEN coalesce(sc, score) >= 0.85e0 THEN 'high' WHEN coalesce(sc, score) >= 0.70e0 THEN 'candidate' ELSE 'low_confidence' END AS tier, sc IS NOT NULL AS calibrated, count(*) AS n FROM x LEFT JOIN c USING (tile_id) GROUP BY 1, 2")
def q_retier(spark, d):
    rows = G.log(spark, d)
    cal = rows.where("ord % 3 = 0").groupBy("tile_id").agg(F.least(F.lit(1.0), F.max("score2")).alias("score_calibrated"))
    now = dedupe.keep_last(dedupe.scored(rows), "tile_id", "ord")
    now = now.withColumn("tier", scoring.tier(F.col("score"), "low_confidence"))
    return rollup.retier(now, cal, lambda s: scoring.tier(s, "low_confidence")).groupBy("tier", "calibrated").agg(F.count("*").alias("n"))


@query(f"WITH {G.OSM}, s AS (SELECT c_nationkey AS k, count(*) AS n_high, count(*) FILTER (osm_id % 3 = 0) AS n_new_high FROM osm GROUP BY 1) SELECT sum(n_high)::BIGINT AS n_high, sum(n_new_high)::BIGINT AS n_new_high, round(sum(n_new_high) / greatest(1, sum(n_high)), 6) AS share_new FROM s")
def q_new_share(spark, d):
    rows = G.osm(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("n_high"), F.count_if(F.col("osm_id") % 3 == 0).alias("n_new_high"))
    return rollup.new_share(rows).withColumn("share_new", F.round("share_new", 6))


@query("SELECT o_orderpriority AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def q_label_histogram(spark, d):
    o = G.table(spark, d, "orders")
    total = o.agg(F.count("*").alias("total"))
    return o.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT o_orderkey AS k, (o_orderdate - INTERVAL 1 YEAR)::DATE AS day FROM orders")
def q_baseline_date(spark, d):
    return G.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.baseline_date(F.to_date("o_orderdate")).alias("day"))


@query("SELECT s_suppkey AS k, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 6) AS scaled FROM supplier")
def q_min_max(spark, d):
    rows = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    return composite.min_max(rows, "x").select("k", F.round("x_scaled", 6).alias("scaled"))


@query("""WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '2024-13' ELSE '2024-05' END AS month, o_orderkey % 60 AS rate, o_orderkey % 7 AS low, o_orderkey % 11 AS mid, 9 AS high FROM orders) SELECT k, 'month' AS rule FROM t WHERE month = '2024-13' UNION ALL SELECT k, 'rate out of range' FROM t WHERE rate < 1 OR rate > 50 UNION ALL SELECT k, 'band' FROM t WHERE low > mid OR mid > high""")
def q_gate_tariff(spark, d):
    k = F.col("o_orderkey")
    rows = G.table(spark, d, "orders").select(k.alias("k"), F.when(k % 9 == 0, "2024-13").otherwise("2024-05").alias("month"), (k % 60).alias("rate"), (k % 7).alias("low"), (k % 11).alias("mid"), F.lit(9).alias("high"))
    return gates.violations(rows, "k", gates.tariff_rules())


@query("SELECT l_orderkey * 8 + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q_gate_repeated(spark, d):
    return gates.repeated(G.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k")), "k")


@query("SELECT src, y FROM (SELECT source AS src, (count(*) % 2)::INT AS y FROM documents GROUP BY 1)")
def q_holdout_split(spark, d):
    s = G.table(spark, d, "documents").groupBy(F.col("source").alias("src")).agg((F.count("*") % 2).cast("int").alias("y"))
    return evaluate.holdout(s).where(F.col("held_out").isNotNull()).select("src", "y")


@query(f"WITH {G.LOG}, {G.CITIES}, {G.in_city('log', 'ord', 'any_ring').replace('SELECT p.ord, e.city, e.ord FROM', 'SELECT p.ord AS k, e.city, e.ord FROM')} SELECT city, count(*) AS n FROM inside GROUP BY city")
def q_city_all_matches(spark, d):
    found = spatial.contains_join(G.log(spark, d).select("ord", "lat", "lon"), G.cities(spark, d).select("city", "polygons"), "any_ring")
    return found.groupBy("city").agg(F.count("*").alias("n"))
