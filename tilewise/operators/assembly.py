"""Putting tables together: training sources, prioritised lookups, caches, polygons from lines, sub-tiles and series."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo

from .shared import first_per, numbered


def training_sources(parts: list[tuple[str, DataFrame]], excluded: DataFrame | None = None) -> DataFrame:
    """Sources of several kinds as one table: (prefix, rows with key, y, lat, lon), named prefix_0001 and so on.

    Keys in excluded (key) are left out; the number follows the key's order within its kind and has four digits at least.
    """
    tagged = []
    for prefix, rows in parts:
        rows = rows if excluded is None else rows.join(excluded.select("key"), "key", "left_anti")
        rows = numbered(rows, [F.col("key")], "_n")
        tagged.append(rows.select(F.concat(F.lit(f"{prefix}_"), F.format_string("%04d", "_n")).alias("src"), "key", "y", "lat", "lon"))
    return reduce(DataFrame.unionByName, tagged)


def augmentations(rows: DataFrame, key: str, variants: int = 4, seed: int = 42) -> DataFrame:
    """variants rows for each source: quarter turns, flip, brightness and colour factors that follow from a hash."""
    many = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed + i), key, "variant"), F.lit(10_000)) / F.lit(10_000.0)
    return many.select(*rows.columns, "variant", F.floor(draw(0) * 4).alias("turns"), (draw(1) < 0.5).alias("flip"), (draw(2) * 0.3 + 0.85).alias("brightness"), (draw(3) * 0.3 + 0.85).alias("colour"))


def balance(rows: DataFrame, y: str = "y", per_positive: int = 32) -> DataFrame:
    """Rows by class and how often each negative has to be repeated to balance the positives' variants."""
    n = rows.agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    return n.withColumn("repeat_neg", F.greatest(F.lit(1), F.floor(F.col("n_pos") * per_positive / F.greatest(F.lit(1), F.col("n_neg")))))


def prefix_counts(rows: DataFrame, src: str, prefixes: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(src).startswith(p)).alias(p.strip("_")) for p in prefixes], F.count("*").alias("n"))


def first_source(asked: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """asked with the value of the first source that has its key (key, value), and that source's name; null without any."""
    tagged = [df.select(key, "value", F.lit(name).alias("found_in"), F.lit(i).alias("_p")) for i, (name, df) in enumerate(sources)]
    best = first_per(reduce(DataFrame.unionByName, tagged).where("value is not null"), [key], [F.col("_p"), F.col("value")]).drop("_p")
    return asked.join(best, key, "left")


def by_variants(asked: DataFrame, names: DataFrame, variants) -> DataFrame:
    """Each asked name (q) with the known one (name, area) that equals one of its spellings; the smallest area on several."""
    spelt = asked.select("q", F.explode(variants(F.col("q"))).alias("name"))
    return first_per(spelt.join(names, "name"), ["q"], [F.col("area"), F.col("name")])


def with_cache(rows: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """The cached rows of the keys asked for, and compute() of the others: what is cached isn't computed again."""
    keys = rows.select(key).distinct()
    return cache.join(keys, key, "left_semi").unionByName(compute(rows.join(cache.select(key), key, "left_anti")))


def without_match(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return rows.join(other.select(key).distinct(), key, "left_anti")


def carry_labels(template: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """template with the labels of an earlier sheet."""
    return template.join(before.select(key, "label"), key, "left")


def sub_tiles(tiles: DataFrame, n: int = 3, pixels: int = 400) -> DataFrame:
    """n x n crop boxes of each tile: row, col, left, top, right, bottom."""
    step = pixels // n
    grid = tiles.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumns({"left": F.col("col") * step, "top": F.col("row") * step, "right": (F.col("col") + 1) * step, "bottom": (F.col("row") + 1) * step})


def context_box(boxes: DataFrame, pad: float = 0.35, pixels: int = 400) -> DataFrame:
    """A padded square box around each (x0, y0, x1, y1), moved so that it lies within the picture."""
    side = F.least(F.lit(pixels), F.ceil(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * (1 + 2 * pad))).cast("int")
    at = lambda a, b: F.greatest(F.lit(0), F.least(F.lit(pixels) - F.col("side"), F.floor((F.col(a) + F.col(b) - F.col("side")) / 2))).cast("int")
    out = boxes.withColumn("side", side)
    return out.withColumns({"cx0": at("x0", "x1"), "cy0": at("y0", "y1")})


def mask_box(mask: DataFrame, key: str, pixels: int = 400) -> DataFrame:
    """The ring of the box around each mask's pixels (key, lat, lon of the tile, x, y)."""
    b = mask.groupBy(key).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("area_px"))
    west, north = geo.pixel_to_lonlat(F.col("min_x"), F.col("min_y"), F.col("lat"), F.col("lon"), pixels)
    east, south = geo.pixel_to_lonlat(F.col("max_x") + 1, F.col("max_y") + 1, F.col("lat"), F.col("lon"), pixels)
    ring = F.array(F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south))
    return b.select(key, "area_px", ring.alias("ring"))


def segment_gate(segments: DataFrame, pixels: int, largest: float, smallest: int = 250, keep: float = C.CANDIDATE) -> DataFrame:
    """Segments of a plausible size (area_px) whose combined confidence is high enough, with area and capacity."""
    rows = segments.where(F.col("area_px").between(smallest, largest * pixels * pixels)).withColumn("confidence", F.lit(0.6) * F.col("clip") + F.lit(0.4) * F.col("color"))
    mpp = geo.metres_per_pixel(F.col("lat"), pixels)
    return rows.where(F.col("confidence") >= keep).withColumn("area_m2", F.col("area_px") * mpp * mpp).withColumn("kwp", F.col("area_m2") * C.KWP_PER_M2)


def _stitch(edges: pd.DataFrame) -> pd.DataFrame:
    """Rings of one relation's segments (role, ord, line), joined end to end."""
    rows = []
    for role, part in edges.groupby("role"):
        left, n = [[tuple(p) for p in line] for line in part.sort_values("ord")["line"]], 0
        while left:
            ring = left.pop(0)
            grown = True
            while ring[0] != ring[-1] and grown:
                grown = False
                for i, line in enumerate(left):
                    for way in (line, line[::-1]):
                        if way[0] == ring[-1]:
                            ring, grown = ring + way[1:], True
                        elif way[-1] == ring[0]:
                            ring, grown = way[:-1] + ring, True
                        if grown:
                            break
                    if grown:
                        left.pop(i)
                        break
            rows.append((edges["rel"].iloc[0], role, n, [list(p) for p in ring], ring[0] == ring[-1] and len(ring) >= 4))
            n += 1
    return pd.DataFrame(rows, columns=["rel", "role", "n", "ring", "closed"])


def polygonize(edges: DataFrame) -> DataFrame:
    """Polygons of relations from unordered lines (rel, role outer or inner, ord, line): each inner ring goes to the
    first outer ring that holds its first point; lines that close no ring are left out. One relation is one group."""
    rings = edges.groupBy("rel").applyInPandas(_stitch, "rel long, role string, n int, ring array<array<double>>, closed boolean").where("closed")
    outer = rings.where("role = 'outer'").select("rel", F.col("n").alias("o"), F.col("ring").alias("outer"))
    inner = rings.where("role = 'inner'").select("rel", F.col("n").alias("i"), F.col("ring").alias("inner"))
    held = first_per(inner.join(outer, "rel").where(geo.in_ring(F.col("inner")[0][0], F.col("inner")[0][1], F.col("outer"))), ["rel", "i"], [F.col("o")])
    holes = held.groupBy("rel", "o").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "inner"))), lambda x: x["inner"]).alias("holes"))
    whole = outer.join(holes, ["rel", "o"], "left").withColumn("polygon", F.concat(F.array("outer"), F.coalesce("holes", F.array().cast("array<array<array<double>>>"))))
    return whole.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "polygon"))), lambda x: x["polygon"]).alias("polygons"))


def partial_choice(rows: DataFrame, key: str, ord_col: str, fields: list[str]) -> DataFrame:
    """Of several extractions per key the one with most fields, the earlier on a tie."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return first_per(rows.withColumn("filled", filled), [key], [F.desc("filled"), F.col(ord_col)])


def quarter_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """A manifest's quarters with new ones put in, sorted, each once."""
    return old.unionByName(new).groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("quarters")))).alias("quarters"))


def placed(elements: DataFrame) -> DataFrame:
    """elements (lat, lon, center) with lat and lon from the centre where they are missing or 0; those without a place go."""
    at = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(f"center.{c}"))
    return elements.withColumns({"lat": at("lat"), "lon": at("lon")}).where("lat is not null and lon is not null").drop("center")


def smallest_relation(points: DataFrame, name: str = "name", relation: str = "relation") -> DataFrame:
    """Per name the relation whose points (lat, lon) have the smallest box in square degrees, ties to the smaller id: name, relation, area."""
    box = points.groupBy(name, relation).agg(((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))).alias("area"))
    return box.groupBy(name).agg(F.min(F.struct("area", relation)).alias("b")).select(name, f"b.{relation}", "b.area")


def holdout_rows(rows: DataFrame, wanted: DataFrame, key: str, row: str) -> DataFrame:
    """key, row of the wanted keys that are among rows; of rows that repeat a key the last."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(row).alias(row))


def with_geometry(cities: DataFrame, polygons: DataFrame, code: str) -> tuple[DataFrame, DataFrame]:
    """(cities with their polygon's geometry, codes of the cities that are skipped: no polygon, or one without geometry); of polygons that repeat a code the last by ord."""
    last = polygons.where(F.col(code).isNotNull()).groupBy(code).agg(F.max_by("geometry", "ord").alias("geometry"))
    have = last.where("geometry is not null")
    return cities.join(have, code), cities.select(code).join(have.select(code), code, "left_anti")


def first_raster(cells: DataFrame, rasters: DataFrame, key: str) -> DataFrame:
    """key, raster of each cell (key, lat, lon): the first (by ord) of rasters (raster, ord, south, west, north, east) that covers it; cells outside all go.

    Rasters are squares of whole degrees, so they are met by degree and not by comparing all pairs.
    """
    cover = rasters.withColumn("_y", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("_x", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    met = cells.withColumns({"_y": F.floor("lat"), "_x": F.floor("lon")}).join(cover, ["_y", "_x"]).where("lat between south and north and lon between west and east")
    return met.groupBy(key).agg(F.min_by("raster", "ord").alias("raster"))


def top_up(n_have: int, least: int = 200, copies: int = 4) -> tuple[int, int]:
    """(negatives to add so that there are at least so many, rows they make with their augmented copies)."""
    more = max(0, least - n_have)
    return more, more * (copies + 1)
