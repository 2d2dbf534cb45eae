"""Contexts of points and shifts of regions on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import evaluate, grid, lookup

POINTS = "pid long, lat double, lon double, psgc long"


def tables(spark):
    ring = lambda x, y, w: [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]]
    cities = spark.createDataFrame([(1, "first", 1, ring(121.0, 14.5, 0.02)), (2, "second", 2, ring(121.01, 14.5, 0.02)), (3, "far", 3, ring(100.0, 1.0, 0.1))], "psgc long, city string, ord long, polygons array<array<array<array<double>>>>")
    counts = spark.createDataFrame([("first", 5, 1, 2.0), ("second", 7, 0, 3.5), ("third", 1, 1, 0.0)], "city string, n_high long, n_candidate long, density double")
    cases = spark.createDataFrame([(1, 14.5, 121.0), (2, 14.5, 121.1), (3, -14.5, -59.0), (4, 14.6, 121.0)], "case_id long, lat double, lon double")
    tiles = spark.createDataFrame([("high", 14.505, 121.005), ("candidate", 14.505, 121.006), ("high", 14.6, 121.005), (None, 14.505, 121.005)], "tier string, lat double, lon double")
    return cities, counts, cases, tiles


def test_context_by_code_then_by_place(spark):
    points = spark.createDataFrame([(1, 14.505, 121.005, None), (2, 14.505, 121.005, 3), (3, 14.505, 121.015, 99), (4, 50.0, 10.0, None), (5, None, None, 2)], POINTS)
    got = {r["pid"]: r for r in lookup.context(points, *tables(spark)).collect()}
    assert {p: (r["city"], r["n_high"], r["n_candidate"], r["rank"], r["ranked"]) for p, r in got.items()} == {1: ("first", 5, 1, 2, 2), 2: ("far", None, None, None, None), 3: ("first", 5, 1, 2, 2), 4: (None,) * 5, 5: ("second", 7, 0, 1, 2)}
    assert {p: (r["high_around"], r["candidates_around"]) for p, r in got.items()} == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (0, 0), 5: (0, 0)}
    assert [c["case_id"] for c in got[1]["cases"]] == [1, 2, 4] and [c["rank"] for c in got[4]["cases"]] == [1, 2, 3] and got[5]["cases"] is None
    assert lookup.context(points.limit(0), *tables(spark)).count() == 0


def test_shift_is_measured_against_the_anchor(spark):
    rng = np.random.default_rng(2)
    means = {"trained": [1.0, 0.0, 0.0], "scan": [0.9, 0.3, 0.0], "near": [0.9, 0.32, 0.02], "off": [0.0, 0.2, 1.0]}
    rows = [(g, (np.array(m) + rng.normal(0, 0.01, 3)).tolist()) for g, m in means.items() for _ in range(20)]
    df = spark.createDataFrame(rows, "region string, v array<double>")
    got = {r["region"]: r for r in evaluate.domain_shift(df, "region", "v", "trained", "scan").collect()}
    mean = {g: np.mean([v for k, v in rows if k == g], 0) for g in means}
    cos = lambda a, b: 1 - mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b])
    assert set(got) == {"near", "off"} and [got[g]["verdict"] for g in ("near", "off")] == ["within-envelope", "severe-OOD"]
    for g, r in got.items():
        want = (20, cos(g, "trained"), np.linalg.norm(mean[g] - mean["trained"]), cos(g, "scan"), cos("scan", "trained"))
        assert (r["n"], r["cosine"], r["euclidean"], r["geo_cosine"], r["floor"]) == pytest.approx(want, abs=1e-12)
    assert evaluate.domain_shift(df.where("region <> 'scan'"), "region", "v", "trained", "scan").count() == 0


def test_grids_of_many_areas_equal_single_ones(spark):
    boxes = [("a", 14.40, 120.92, 14.45, 120.95), ("b", 10.3, 123.9, 10.33, 123.91), ("empty", 1.0, 1.0, 1.0, 2.0), ("thin", 1.0, 1.0, 1.001, 1.2), ("null", None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(boxes, "area string, south double, west double, north double, east double")
    got = {tuple(r) for r in grid.grids(df, "area").collect()}
    metric = {tuple(r)[:3] for r in grid.grids_metres(df, "area").collect()}
    for area, *box in boxes[:2]:
        assert {r[1:] for r in got if r[0] == area} == {tuple(r) for r in grid.grid(spark, box).select("iy", "ix", "lat", "lon", "tile_id").collect()}
        assert {r[1:] for r in metric if r[0] == area} == {tuple(r) for r in grid.grid_metres(spark, box).select("iy", "ix").collect()}
    assert {r[0] for r in got} == {"a", "b"} and grid.grids(df.where(F.col("area") == "x"), "area").count() == 0
