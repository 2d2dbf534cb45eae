"""Outlines, zones and tiled rasters against plain loops."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.functions import geo
from tilewise.operators import contours, zonal
from tilewise.operators.shared import new_path
from tilewise.sources import tiled_raster

PIXELS = "tile string, py int, px int"


def outlines(cells):
    """{first corner walk: (sides, area)} of a set of (y, x), by walking along sides one after another."""
    across, ahead = [(-1, 0), (0, 1), (1, 0), (0, -1)], [(0, 1), (1, 0), (0, -1), (-1, 0)]
    start = [(0, 0), (0, 1), (1, 1), (1, 0)]
    left = {(y, x, s) for y, x in cells for s in range(4) if (y + across[s][0], x + across[s][1]) not in cells}
    out = []
    while left:
        y, x, s = first = min(left)
        corners = []
        while True:
            left.discard((y, x, s))
            corners.append((x + start[s][1], y + start[s][0]))
            ay, ax = y + ahead[s][0], x + ahead[s][1]
            if (ay, ax) not in cells:
                s = (s + 1) % 4
            elif (ay + across[s][0], ax + across[s][1]) not in cells:
                y, x = ay, ax
            else:
                y, x, s = ay + across[s][0], ax + across[s][1], (s - 1) % 4
            if (y, x, s) == first:
                break
        area = sum(a * d - c * b for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True)) / 2
        step = -(-len(corners) // 64)
        thin = corners[::step]
        out.append((first, len(corners), area, tuple(thin + thin[:1])))
    return out


def found(spark, masks, **options):
    rows = [(t, y, x) for t, cells in masks.items() for y, x in cells]
    got = contours.rings(spark.createDataFrame(rows, PIXELS).repartition(3), ("tile",), **options).collect()
    back = lambda n: ((n >> 32) - (1 << 28), (n >> 2) % (1 << 30) - (1 << 28), n % 4)
    return Counter((r["tile"], back(r["ring"]), r["n_sides"], r["area"], tuple((int(x), int(y)) for x, y in r["points"])) for r in got)


def shapes():
    rng = random.Random(3)
    ring = {(y, x) for y in range(40) for x in range(40)} - {(y, x) for y in range(5, 30) for x in range(7, 33)}
    snake = {(y, x) for y in range(0, 61, 2) for x in range(70)} | {(y, 69 if y % 4 == 1 else 0) for y in range(1, 60, 2)}
    noise = {(rng.randrange(-40, 40), rng.randrange(-50, 30)) for _ in range(4000)}
    return {"ring": ring, "snake": snake, "noise": noise, "corner": {(0, 0), (1, 1), (2, 0)}, "one": {(-7, -9)}, None: {(3, 3), (3, 4)}}


@pytest.mark.parametrize("size", [8, 17, 256])
def test_outlines_of_all_parts(spark, size):
    """One ring goes through many squares, one is a line of 2,000 pixels; the size of the squares changes nothing."""
    masks = shapes()
    got = found(spark, masks, size=size)
    assert got == Counter((t, *r) for t, cells in masks.items() for r in outlines(cells))
    for t, cells in masks.items():
        assert sum(area for name, _, _, area, _ in got.elements() if name == t) == len(cells)
    assert all(p[0] == p[-1] and len(p) <= 65 for *_, p in got)


def test_outline_of_a_block_of_ten_squares(spark):
    side = 80
    rows = spark.range(side * side).selectExpr("cast(id div 80 as int) as py", "cast(id % 80 as int) as px")
    got = contours.rings(rows.union(rows.limit(50)).union(spark.createDataFrame([(None, 1)], "py int, px int")), size=8).collect()
    assert [(r["n_sides"], r["area"], r["n_points"]) for r in got] == [(4 * side, side * side, 64)]
    assert contours.rings(rows.where("px < 0")).count() == 0


def square(x, y, w, h, holes=()):
    ring = lambda a, b, c, e: [[a, b], [a + c, b], [a + c, b + e], [a, b + e], [a, b]]
    return [ring(x, y, w, h), *[ring(*o) for o in holes]]


def test_runs_say_the_same_as_the_ring_test(spark):
    rng = random.Random(5)
    star = lambda n, r: [[121.0 + r * rng.random() * math.cos(6.2832 * i / n), 14.5 + r * rng.random() * math.sin(6.2832 * i / n)] for i in range(n)]
    polygons = [("star", [[star(9, 0.05)]]), ("two", [square(120.95, 14.45, 0.03, 0.03, [(120.96, 14.46, 0.01, 0.01)]), square(121.0, 14.5, 0.03, 0.02)]), ("odd", [[star(13, 0.04)], [star(6, 0.02)]]), ("sticks out", [square(120.96, 14.48, 0.02, 0.02, [(120.97, 14.49, 0.05, 0.05)])]), ("edge", [square(120.9504, 14.4996, 0.004, 0.004)]), ("flat", [[[[121.0, 14.5], [121.01, 14.5], [121.0, 14.5]]]]), ("none", []), ("off", [square(10.0, 10.0, 0.01, 0.01)])]
    df = spark.createDataFrame(polygons, "name string, polygons array<array<array<array<double>>>>")
    grid = zonal.Grid(14.56, 120.94, 0.0008)
    pixels = spark.range(150 * 150).select((F.col("id") / 150).cast("long").alias("py"), (F.col("id") % 150).alias("px"))
    at = pixels.withColumns({"lat": grid.lat(F.col("py")), "lon": grid.lon(F.col("px"))})
    want = {(r["name"], r["py"], r["px"]) for r in at.crossJoin(df).where(geo.in_polygons(F.col("lon"), F.col("lat"), F.col("polygons"))).select("name", "py", "px").collect()}
    got = zonal.under(pixels, zonal.runs(df, "name", grid), "name", width=150).select("name", "py", "px").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 1000
    rows = zonal.zonal(pixels.withColumns({"value": F.col("px") / 10, "cls": F.when(F.col("py") % 2 == 0, 50).otherwise(10)}), df, "name", grid).collect()
    for r in rows:
        mine = [(y, x) for n, y, x in want if n == r["name"]]
        assert r["n"] == len(mine)
        assert r["mean"] == (pytest.approx(np.mean([x / 10 for _, x in mine])) if mine else None)
        assert r["share"] == (pytest.approx(np.mean([y % 2 == 0 for y, _ in mine])) if mine else None)
        assert r["km2"] == pytest.approx(sum((0.0008 * 111_320) ** 2 * np.cos(np.radians(14.56 - (y + 0.5) * 0.0008)) for y, _ in mine if y % 2 == 0) / 1e6, abs=1e-9)


@pytest.fixture
def tiles(spark):
    """6 x 5 tiles of two bands, of 16 x 16 pixels; one can't be read and one isn't there."""
    path = new_path(spark, "tiles")
    rows = spark.range(96 * 80).select((F.col("id") / 80).cast("long").alias("py"), (F.col("id") % 80).alias("px")).withColumn("value", (F.col("py") * 7 + F.col("px") * 3) % 5 * 10.0)
    both = rows.withColumn("band", F.explode(F.array(F.lit("a"), F.lit("b")))).where("not (py div 16 = 2 and px div 16 = 2)").where("band = 'a' or py % 3 = 0")
    assert tiled_raster.write_tiles(both.union(both.limit(5)), path, 16).count() == 2 * 29
    Path(path, "a", "y3_x1.npy").write_bytes(b"no array")
    return path, rows


def test_only_the_tiles_of_a_window_are_opened(spark, tiles):
    path, rows = tiles
    whole = tiled_raster.read_tiles(spark, path, 16)
    assert whole.rdd.getNumPartitions() == 58
    window = tiled_raster.read_tiles(spark, path, 16, (F.col("band") == "a") & F.col("py").between(20, 40) & (F.col("px") >= 33) & (F.col("px") < 48))
    assert window.rdd.getNumPartitions() == 1  # a partition a file: of three tiles one isn't there, one is met at its edge alone
    for file in Path(path).rglob("*.npy"):
        if file.name != "y1_x2.npy" or file.parent.name != "a":
            file.write_bytes(b"")  # would be seen if it were opened
    got = window.select("py", "px", "value", "error").collect()
    want = rows.where("py between 20 and 31 and px between 33 and 47").collect()
    assert {tuple(r)[:3] for r in got} == {tuple(r) for r in want} and all(r["error"] is None for r in got)
    assert tiled_raster.read_tiles(spark, path, 16, F.col("band").isin("b", "c") & (F.col("ty") == 5)).rdd.getNumPartitions() == 5
    assert tiled_raster.read_tiles(spark, path + "-none", 16).count() == 0


def test_share_of_windows_with_missing_and_broken_tiles(spark, tiles):
    path, rows = tiles
    cells = [("plain", 4, 20, 3, 30), ("missing", 33, 40, 34, 40), ("broken", 49, 50, 18, 19), ("half missing", 40, 50, 40, 50), ("outside", 500, 510, 0, 5), ("no pixels", 95, 94, 0, 3)]
    df = spark.createDataFrame(cells[:5], "cell string, y0 long, y1 long, x0 long, x1 long")
    got = {r["cell"]: (r["n"], r["share"]) for r in tiled_raster.window_share(df, tiled_raster.read_tiles(spark, path, 16, F.col("band") == "a"), ["cell"], 30.0, 16).collect()}
    inside = lambda y0, y1, x0, x1: [r["value"] == 30 for r in rows.where(f"py between {y0} and {y1} and px between {x0} and {x1} and not (py div 16 = 2 and px div 16 = 2)").collect()]
    for name, *box in (cells[0], cells[3]):
        values = inside(*box)
        if name == "half missing":
            values = [v for v in values]
        assert got[name] == (len(values), pytest.approx(np.mean(values)))
    assert got["missing"] == (0, None) == got["outside"] and got["broken"] == (0, 1.0)
