"""Areas of footprints and the buildings of segments at the edges of rounding and over copies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewise.functions import geo
from tilewise.operators import spatial


def footprint(key, size):
    """The ring of a building in the catalogue's tables."""
    lat, lon, h = 14.40 + key * 5003 % 38000 / 100000.0, 120.92 + key * 9001 % 21000 / 100000.0, size / 200000.0
    return [[lon + x * h, lat + y * h] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


def test_area_is_the_same_in_both_directions(spark):
    # in the order of the ring the last bit of the mean latitude made these 691 and 690, 1080 and 1079 m2
    rings = [footprint(118221, 24), footprint(70504, 30)]
    df = spark.createDataFrame([(r, r[::-1]) for r in rings], "a array<array<double>>, b array<array<double>>")
    got = df.select(*[F.round(geo.ring_area_m2(F.col(c)), 0).alias(c) for c in "ab"], geo.mean_lat(F.col("a")).alias("m")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(690.0, 690.0), (1080.0, 1080.0)]
    assert [r["m"] for r in got] == [math.fsum(y for _, y in r) / 5 for r in rings]


def square(lon, lat, h):
    return [[lon + x * h, lat + y * h] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


def diamond(lon, lat, h):
    return [[lon, lat - h], [lon + h, lat], [lon, lat + h], [lon - h, lat], [lon, lat - h]]


def holds(x, y, ring):
    pairs = zip(ring, ring[-1:] + ring[:-1], strict=True)
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1] + 1e-12) + a[0] for a, b in pairs) % 2 == 1


def best(lon, lat, ring, buildings):
    """(osm_id, inside) by comparing with all buildings (osm_id, ord, ring), or None."""
    found = []
    box = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r))
    a = box(ring)
    for osm_id, ord_, other in buildings:
        b = box(other)
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w >= 0 and h >= 0 and holds(lon, lat, other):
            found.append((0, 0.0, ord_, osm_id))
        elif w > 0 and h > 0:
            found.append((1, -w * h, ord_, osm_id))
    return (min(found)[3], min(found)[0] == 0) if found else None


@pytest.mark.parametrize("shape", ["half", "ring", "diamonds"])
def test_best_of_many_buildings_makes_no_rows_of_pairs(spark, monkeypatch, shape):
    rng, written, cut = random.Random(11), [], spatial.cut_lineage

    def counted(df):
        rows = cut(df)
        written.append(rows.count())
        return rows

    monkeypatch.setattr(spatial, "cut_lineage", counted)
    outline = diamond if shape == "diamonds" else square
    spots = [(121 + rng.uniform(-1, 1) * 4e-4, 14.5 + rng.uniform(-1, 1) * 4e-4) for _ in range(40)]  # most buildings share a centre
    squares = [(*(rng.choice(spots) if i % 8 else (121 + rng.random() * 4e-3, 14.5 + rng.random() * 4e-3)), rng.randrange(1, 11) * 2.5e-5) for i in range(400)]
    ords = rng.sample(range(400), 400)
    segments = [(i, 121 + rng.uniform(-1, 1) * 8e-4, 14.5 + rng.uniform(-1, 1) * 8e-4, rng.randrange(1, 51) * 1e-6) for i in range(300)]
    segments += [(300 + i, 121 + rng.random() * 4e-3, 14.5 + rng.random() * 4e-3, rng.uniform(1e-4, 3e-3)) for i in range(40)]  # in many cells
    segments += [(400, 122.0, 14.5, 1e-5), (401, None, 14.5, 1e-5)]
    ring = lambda f, x, y, h: None if x is None else f(x, y, h)
    rows = [(i, x, y, h, ring(square, x, y, h)) for i, x, y, h in segments]
    houses = [(1000 + i, o, x, y, h, outline(x, y, h)) for i, (o, (x, y, h)) in enumerate(zip(ords, squares, strict=True))]
    a = spark.createDataFrame(rows, "seg_id long, lon double, lat double, half double, ring array<array<double>>")
    b = spark.createDataFrame(houses, "osm_id long, ord long, lon double, lat double, half double, ring array<array<double>>")
    a, b = (a.drop("ring"), b.drop("ring")) if shape == "half" else (a.drop("half"), b.select("osm_id", "ord", "ring"))
    got = {r["seg_id"]: (r["osm_id"], r["inside"]) for r in spatial.best_building(a, b).collect()}
    want = {i: best(x, y, r, [(o, n, p) for o, n, *_, p in houses]) for i, x, y, _, r in rows if r}
    assert got == {i: x for i, x in want.items() if x} and 200 < len(got) < 341
    assert 0 < sum(inside for _, inside in got.values()) < len(got)
    assert max(written) < 6000  # 400 buildings in their cells; pairs are many more

