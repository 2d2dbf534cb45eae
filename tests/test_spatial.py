"""Joins by distance at every latitude, across longitude 180 and over the poles, and far rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import spatial


def arc(a, b):
    """Metres between points (lat, lon), by the angle of their vectors, not by the formula that is tested."""
    v = lambda p: np.array([math.cos(math.radians(p[0])) * math.cos(math.radians(p[1])), math.cos(math.radians(p[0])) * math.sin(math.radians(p[1])), math.sin(math.radians(p[0]))])
    x, y = v(a), v(b)
    return 6371000 * math.atan2(float(np.linalg.norm(np.cross(x, y))), float(x @ y))


def around(lat, lon, n, spread_m, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        la = max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * spread_m / 111_195))
        lo = lon + rng.uniform(-1, 1) * min(180.0, spread_m / 111_195 / max(1e-9, math.cos(math.radians(la))))
        out.append((i, la, (lo + 180) % 360 - 180))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, lat double, lon double")


PLACES = [(0.0, 10.0), (45.0, -70.0), (60.0, 25.0), (-60.0, 179.999), (85.0, 120.0), (0.001, -180.0), (89.99, 0.0), (-90.0, 0.0)]


@pytest.mark.parametrize("lat,lon", PLACES)
def test_range_join_is_complete_everywhere(spark, lat, lon):
    a, b = around(lat, lon, 60, 3000, 1), around(lat, lon, 60, 3000, 2)
    got = {(r["k"], r["r"]) for r in spatial.range_join(frame(spark, a, "k"), frame(spark, b, "r"), 700).collect()}
    want = {(i, j): arc(p, q) for i, *p in a for j, *q in b}
    assert {p for p, m in want.items() if m < 700 - 1e-3} <= got <= {p for p, m in want.items() if m < 700 + 1e-3}
    assert len(got) > 20


def test_radius_of_a_continent_and_missing_coordinates(spark):
    a = around(70, 170, 25, 4_000_000, 3) + [(90, None, 1.0), (91, 1.0, None)]
    b = around(-10, -20, 25, 9_000_000, 4) + [(90, None, None)]
    got = {(r["k"], r["r"]) for r in spatial.range_join(frame(spark, a, "k"), frame(spark, b, "r"), 8_000_000).collect()}
    want = {(i, j): arc(p, q) for i, *p in a if None not in p for j, *q in b if None not in q}
    assert got == {p for p, m in want.items() if m < 8_000_000}


@pytest.mark.parametrize("lat,lon", [(60.0, 25.0), (0.001, -180.0), (89.99, 0.0)])
def test_nearest_equals_brute_force(spark, lat, lon):
    a, b = around(lat, lon, 50, 20_000, 5), around(lat, lon, 40, 20_000, 6)
    a += [(100 + i, la, lo) for i, (la, lo) in enumerate([(-lat, lon), (0.0, 0.0), (-89.0, 100.0), (lat, lon + 0.2), (12.0, 179.9)])]
    got = spatial.nearest_k(frame(spark, a, "k"), frame(spark, b, "r"), "k", "r", 3).collect()
    assert len(got) == 3 * len(a)
    for i, *p in a:
        best = sorted(arc(p, q) for _, *q in b)[:3]
        found = sorted((r["rank"], r["r"], r["distance_m"]) for r in got if r["k"] == i)
        assert [d for *_, d in found] == pytest.approx(best, rel=1e-6, abs=1e-3)
        assert [arc(p, b[j][1:]) for _, j, _ in found] == pytest.approx(best, rel=1e-6, abs=1e-3)


def test_ties_groups_and_fewer_rows_than_asked(spark):
    left = spark.createDataFrame([(1, 10.0, 10.0, "a"), (2, 10.0, 10.0, "b"), (3, 10.0, 10.0, "none"), (4, None, 10.0, "a")], "k long, lat double, lon double, g string")
    right = spark.createDataFrame([(9, 20.0, 10.0, "a"), (8, 20.0, 10.0, "a"), (7, -20.0, 100.0, "b")], "r long, lat double, lon double, g string")
    assert {(r["k"], r["r"]) for r in spatial.nearest_same(left, right, "g", "k", "r").collect()} == {(1, 8), (2, 7), (3, None), (4, None)}
    ranks = spatial.nearest_k(left, right, "k", "r", 5, by=("g",)).select("k", "r", "rank").collect()
    assert {tuple(r) for r in ranks} == {(1, 8, 1), (1, 9, 2), (2, 7, 1)}


def test_far_rows_meet_few_rows(spark):
    """300 rows on the other side of the globe against 20,000 in one city, 10,000 of them in one place."""
    rng = random.Random(8)
    city = [(i, 14.5 + rng.random() * 0.3, 121.0 + rng.random() * 0.3) for i in range(10_000)] + [(20_000 + i, 14.65, 121.15) for i in range(10_000)]
    far = [(i, -20 + rng.random() * 30, -90 + rng.random() * 60) for i in range(300)]
    left, right = frame(spark, far, "k"), frame(spark, city, "r")
    pairs = spatial._descend(left, right, "k", "r", 1, ()).cache()
    assert pairs.count() < 300 * 1000  # of 6,000,000 pairs in all: the city's edge on a row's side, within two cubes
    best = {r["k"]: r["d"] for r in pairs.groupBy("k").agg(F.min("distance_m").alias("d")).collect()}
    for i, *p in far[:40]:
        assert best[i] == pytest.approx(min(arc(p, q) for _, *q in city[:10_001]), rel=1e-9, abs=1e-2)
