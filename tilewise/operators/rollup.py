"""Counts and sums per city, area, halo cell and building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import scoring

from .shared import numbered
from .spatial import contains_join, range_join

#: Exact sums: measures are added as decimals, in any order.
MONEY = "decimal(28,6)"


def exact_sum(x: Column) -> Column:
    return F.sum(F.round(x, 6).cast(MONEY)).cast("double")


def count_if(x: Column) -> Column:
    return F.coalesce(F.count_if(x), F.lit(0))


def tier_totals(det: DataFrame) -> DataFrame:
    return det.agg(count_if(F.col("tier") == "high").alias("n_high"), count_if(F.col("tier") == "candidate").alias("n_candidate"), F.count("*").alias("n"))


def city_counts(det: DataFrame, city: str = "city") -> DataFrame:
    return det.groupBy(city).agg(count_if(F.col("tier") == "high").alias("n_high"), count_if(F.col("tier") == "candidate").alias("n_candidate"))


def city_detail(det: DataFrame, areas: DataFrame) -> DataFrame:
    """Per city: counts by tier and by map status, capacity, and density over its area (city, area_km2)."""
    high = F.col("tier") == "high"
    agg = det.groupBy("city").agg(
        count_if(high).alias("n_high"), count_if(F.col("tier") == "candidate").alias("n_candidate"), count_if(high & (F.col("status") == "new")).alias("n_new_high"),
        count_if(high & (F.col("status") == "confirmed")).alias("n_confirmed_high"), F.coalesce(exact_sum(F.when(high, F.col("kwp"))), F.lit(0.0)).alias("kwp_high"),
    )
    return agg.join(areas, "city", "left").withColumn("per_km2", F.when(F.col("area_km2") > 0, F.col("n_high") / F.col("area_km2")))


def new_share(rows: DataFrame) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum("n_high"), F.lit(0)).alias("n_high"), F.coalesce(F.sum("n_new_high"), F.lit(0)).alias("n_new_high"))
    return total.withColumn("share_new", F.col("n_new_high") / F.greatest(F.lit(1), F.col("n_high")))


def city_saturation(cities: DataFrame, tiles: DataFrame, buildings: DataFrame, holes: str = "any_ring") -> DataFrame:
    """Every city with its tiles, buildings and capacity; those without any keep zeros. A point may lie in several cities."""
    t = contains_join(tiles, cities.select("city", "polygons"), holes).groupBy("city").agg(count_if(F.col("tier") == "high").alias("n_high"), count_if(F.col("tier") == "candidate").alias("n_candidate"))
    b = contains_join(buildings, cities.select("city", "polygons"), holes).groupBy("city").agg(F.count("*").alias("n_buildings"), exact_sum(F.col("kwp")).alias("sum_kwp"))
    rows = cities.select("city").join(t, "city", "left").join(b, "city", "left").na.fill(0, ["n_high", "n_candidate", "n_buildings"]).na.fill(0.0, ["sum_kwp"])
    return rows.withColumn("mean_kwp", F.when(F.col("n_buildings") > 0, F.col("sum_kwp") / F.col("n_buildings")).otherwise(0.0))


def halo(cells: DataFrame, tiles: DataFrame, buildings: DataFrame, metres: float = C.HALO_M) -> DataFrame:
    """Each grid cell (iy, ix, lat, lon) that has tiles or buildings within so many metres, with counts, capacity and tier."""
    t = range_join(cells, tiles.select("lat", "lon", "tier"), metres).groupBy("iy", "ix").agg(count_if(F.col("tier") == "high").alias("n_high"), count_if(F.col("tier") == "candidate").alias("n_cand"))
    b = range_join(cells, buildings.select("lat", "lon", "kwp"), metres).groupBy("iy", "ix").agg(F.count("*").alias("n_buildings"), exact_sum(F.col("kwp")).alias("sum_kwp"))
    rows = t.join(b, ["iy", "ix"], "full").na.fill(0, ["n_high", "n_cand", "n_buildings"]).na.fill(0.0, ["sum_kwp"])
    rows = rows.where("n_high > 0 or n_cand > 0 or n_buildings > 0")
    return rows.withColumn("saturation", scoring.saturation_tier(F.col("n_buildings"), F.col("sum_kwp")))


def area_tiers(det: DataFrame, area: str = "area") -> DataFrame:
    """Areas by tier, with the total."""
    return det.groupBy(area).pivot("tier", ["high", "candidate"]).count().na.fill(0).withColumn("total", F.col("high") + F.col("candidate"))


def building_rollup(segments: DataFrame, buildings: DataFrame) -> DataFrame:
    """Per building: panel area (no more than the footprint), capacity, best segment, count and tiles."""
    agg = segments.groupBy("osm_id").agg(
        exact_sum(F.col("area_m2")).alias("panel_raw_m2"), F.max("confidence").alias("confidence"), F.count("*").alias("n_segments"),
        F.min_by("seg_id", F.struct(-F.col("confidence"), F.col("seg_id"))).alias("best_seg"), F.array_sort(F.collect_set("tile_id")).alias("tile_ids"),
    )
    rows = agg.join(buildings.select("osm_id", "building_type", "footprint_m2"), "osm_id")
    rows = rows.withColumn("panel_m2", F.least("panel_raw_m2", "footprint_m2"))
    return rows.withColumn("kwp", F.col("panel_m2") * C.KWP_PER_M2_BUILDING).withColumn("is_residential", F.coalesce(F.col("building_type").isin(*C.RESIDENTIAL), F.lit(False)))


def residential_rollup(rollup: DataFrame) -> DataFrame:
    """Private buildings as counts by type; none by itself."""
    return rollup.where("is_residential").groupBy(F.coalesce("building_type", F.lit("residential")).alias("building_type")).agg(F.count("*").alias("n"), exact_sum(F.col("kwp")).alias("kwp"))


def tile_anchors(rollup: DataFrame) -> DataFrame:
    """Each tile's building with the largest panel area (ties: smaller id)."""
    rows = rollup.select("osm_id", "panel_m2", F.explode("tile_ids").alias("tile_id"))
    return rows.groupBy("tile_id").agg(F.min_by("osm_id", F.struct(-F.col("panel_m2"), F.col("osm_id"))).alias("osm_id"), F.max("panel_m2").alias("panel_m2"))


def tile_kwp(rollup: DataFrame, fanout: str = "full") -> DataFrame:
    """Capacity of the buildings that touch each tile: full counts a building in each of its tiles, split shares it out."""
    share = F.col("kwp") if fanout == "full" else F.col("kwp") / F.size("tile_ids")
    return rollup.select(share.alias("kwp"), F.explode("tile_ids").alias("tile_id")).groupBy("tile_id").agg(exact_sum(F.col("kwp")).alias("kwp"), F.count("*").alias("n_buildings"))


def status_matrix(det: DataFrame) -> DataFrame:
    """Counts by map status and tier with subtotals, and the share of new among high."""
    return det.cube("status", "tier").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("tier", F.lit("all")).alias("tier"), "n")


def retier(det: DataFrame, calibrated: DataFrame, tier_of) -> DataFrame:
    """det with calibrated scores and new tiers where there are any; the rest keeps its own."""
    rows = det.join(calibrated.select("tile_id", "score_calibrated"), "tile_id", "left")
    has = F.col("score_calibrated").isNotNull()
    return rows.withColumn("tier", F.when(has, tier_of(F.col("score_calibrated"))).otherwise(F.col("tier"))).withColumn("calibrated", has)


def city_report(det: DataFrame, city: str = "city") -> DataFrame:
    """city, n_high, n_candidate, n_new_high, sum_kwp_high, place: as first published, before tags and buildings are joined.

    Until then each high detection counts as new and no capacity is known; places go by n_high, then by name.
    """
    rows = city_counts(det, city).withColumns({"n_new_high": F.col("n_high"), "sum_kwp_high": F.lit(0.0)})
    return numbered(rows, [F.desc("n_high"), F.col(city)], "place")


def top_capacity(rows: DataFrame, name: str, kwp: str, n: int = 15) -> DataFrame:
    """The first n rows with capacity, in order of capacity, then of name."""
    return rows.where(F.col(kwp) > 0).orderBy(F.desc(kwp), name).limit(n)


def capacity_summary(buildings: DataFrame, kwp: str = "kwp") -> DataFrame:
    return buildings.agg(F.count("*").alias("n"), F.coalesce(exact_sum(F.col(kwp)), F.lit(0.0)).alias("sum_kwp"), F.max(kwp).alias("max_kwp"))


def building_status(buildings: DataFrame, tiles: DataFrame, cut: float = C.HIGH) -> DataFrame:
    """osm_id, status of buildings (osm_id, tile_score, tile_ids): candidate below the cut, else confirmed if one of its tiles is (tiles: tile_id, confirmed), else new."""
    of = buildings.select("osm_id", "tile_score", F.explode_outer("tile_ids").alias("tile_id")).join(tiles.groupBy("tile_id").agg(F.bool_or("confirmed").alias("confirmed")), "tile_id", "left")
    rows = of.groupBy("osm_id").agg(F.min("tile_score").alias("s"), F.coalesce(F.bool_or("confirmed"), F.lit(False)).alias("c"))
    return rows.select("osm_id", F.when(F.col("s") < cut, "candidate").when(F.col("c"), "confirmed").otherwise("new").alias("status"))
