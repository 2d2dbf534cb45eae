import cmath
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.functions import geo, scoring, text
from tilewise.operators import dedupe, evaluate, gates, grid, links, raster, shared, spatial
from tilewise.sources import readers, sinks
from tilewise.streaming import ingest


def turns(x, y, ring):
    """How often the ring goes round the point, by the angles under which its sides are seen."""
    total = 0.0
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[(k + 1) % len(ring)]
        u, v = complex(ax - x, ay - y), complex(bx - x, by - y)
        total += cmath.phase(v / u)
    return round(total / (2 * math.pi))


def metres(a, b):
    (la, lo), (lb, mo) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(mo - lo) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_point_in_ring_on_random_rings(spark):
    rng, rows = random.Random(1), []
    for _ in range(60):
        n = rng.randrange(3, 9)
        ring = [[rng.random(), rng.random()] for _ in range(n)]
        rows += [(rng.random(), rng.random(), ring) for _ in range(5)]
    df = spark.createDataFrame(rows, "x double, y double, ring array<array<double>>")
    got = df.select("x", "y", "ring", geo.in_ring(F.col("x"), F.col("y"), F.col("ring")).alias("r")).collect()
    # where sides cross, inside is where the ring goes round an odd number of times
    assert all(r["r"] == bool(turns(r["x"], r["y"], r["ring"]) % 2) for r in got)


def test_holes(spark):
    sq = lambda h: [[-h, -h], [h, -h], [h, h], [-h, h], [-h, -h]]
    df = spark.createDataFrame([([[sq(2.0), sq(1.0)]],)], "p array<array<array<array<double>>>>")
    at = lambda x, holes: df.select(geo.in_polygons(F.lit(x), F.lit(0.1), F.col("p"), holes)).first()[0]
    assert [at(0.0, h) for h in ("exclude", "ignore", "any_ring")] == [False, True, True]
    assert [at(1.5, h) for h in ("exclude", "ignore", "any_ring")] == [True, True, True]


def test_areas_and_grid(spark):
    d = 100 / 111_320
    ring = [[0.0, 0.0], [d, 0.0], [d, d], [0.0, d], [0.0, 0.0]]
    df = spark.createDataFrame([(ring,), (ring[:2],)], "r array<array<double>>")
    got = [r[0] for r in df.select(geo.ring_area_m2(F.col("r"))).collect()]
    assert got[0] == pytest.approx(10_000, rel=0.01) and got[1] == 0
    assert grid.grid(spark).count() == 176 * 94
    assert grid.grid(spark, (1.0, 1.0, 1.0, 2.0)).count() == 0
    with pytest.raises(ValueError):
        grid.grid_metres(spark, (2.0, 1.0, 1.0, 2.0))


def points(n, seed):
    rng = random.Random(seed)
    return [(i, 14.4 + rng.random() * 0.05, 120.9 + rng.random() * 0.05) for i in range(n)]


def test_range_and_nearest_equal_brute_force(spark):
    a, b = points(80, 2), points(120, 3)
    left, right = spark.createDataFrame(a, "k long, lat double, lon double"), spark.createDataFrame(b, "r long, lat double, lon double")
    want = {(i, j) for i, *p in a for j, *q in b if metres(p, q) <= 700}
    assert {(r["k"], r["r"]) for r in spatial.range_join(left, right, 700).collect()} == want
    far = [(999, 10.0, 119.0)]
    got = spatial.nearest(spark.createDataFrame(a + far, left.schema), right, "k", "r").collect()
    assert {(r["k"], r["r"]) for r in got} == {(i, min((metres(p, q), j) for j, *q in b)[1]) for i, *p in a + far}
    none = spatial.nearest(left, right.where("r < 0"), "k", "r").collect()
    assert len(none) == 80 and all(r["r"] is None for r in none)
    kept = {r["k"] for r in spatial.exclude_near(left, right, "k", 240).collect()}
    assert kept == {i for i, *p in a if all(metres(p, q) >= 240 for _, *q in b)}


def test_dedupe_and_sets(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.9), (3, "b", None)], "ord long, tile_id string, score double")
    assert [r["ord"] for r in dedupe.keep_last(rows, "tile_id", "ord").orderBy("ord").collect()] == [2, 3]
    assert [r["ord"] for r in dedupe.keep_first(rows, "tile_id", "ord").orderBy("ord").collect()] == [1, 3]
    change = {r["ord"]: r["change"] for r in dedupe.set_partition(rows.where("ord < 3"), rows.where("ord > 1"), "ord").collect()}
    assert change == {1: "dropped", 2: "kept", 3: "added"}


def test_connected_parts(spark):
    rng = random.Random(4)
    cells = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(150)})
    seen, want = {}, 0
    for c in cells:
        if c in seen:
            continue
        want += 1
        stack = [c]
        while stack:
            y, x = stack.pop()
            if (y, x) in seen or (y, x) not in set(cells):
                continue
            seen[y, x] = want
            stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    got = raster.connected_parts(spark.createDataFrame(cells, "py long, px long")).collect()
    assert len(got) == len(cells) and len({(r["part_py"], r["part_px"]) for r in got}) == want
    assert len({(seen[r["py"], r["px"]], r["part_py"], r["part_px"]) for r in got}) == want


def test_parts_across_blocks(spark):
    snake: list[tuple[int, int]] = []
    for turn in range(25):  # 1,000 pixels that go to and fro
        xs = range(38) if turn % 2 == 0 else range(37, -1, -1)
        snake += [(2 * turn, x) for x in xs] + [(2 * turn + 1, 37 if turn % 2 == 0 else 0)]
    far = [(-300, -5), (-299, -6), (10**6, 10**6), (70, 7)]
    pixels = spark.createDataFrame([*snake, *far, snake[0], (None, 3), (3, None)], "py long, px long")
    for block in (7, 256):
        got = {(r["py"], r["px"]): (r["part_py"], r["part_px"]) for r in raster.connected_parts(pixels, block).collect()}
        assert len(got) == len(set(snake + far)) and {got[p] for p in snake} == {(0, 0)}
        assert got[-299, -6] == got[-300, -5] == (-300, -5) and got[10**6, 10**6] == (10**6, 10**6) and got[70, 7] == (70, 7)
    assert raster.connected_parts(pixels.limit(0)).count() == 0


def test_rounds_of_links_grow_with_the_logarithm(spark, monkeypatch):
    tables = []

    def store(df):
        tables.append(1)
        return shared.cut_lineage(df)

    rng = random.Random(9)
    shuffled = list(range(1000))
    rng.shuffle(shuffled)
    for order, at_once in ((list(range(1000)), 2_000_000), (list(range(1000)), 0), (shuffled, 0)):
        monkeypatch.setattr(links, "_contracted", (lambda x: x) if not at_once else links._contracted)
        tables.clear()
        edges = list(zip(order, order[1:]))
        got = links.components(spark.createDataFrame([*edges, (5, 5), (2000, 2001), (2001, None)], "a long, b long"), store=store).collect()
        assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(1000)} | {2000: 2000, 2001: 2000}
        assert len(tables) <= (10 if at_once else 60)
    one, two = np.array([5, 7, 1, 9, 9]), np.array([7, 8, 2, 5, 5])
    assert [x.tolist() for x in links._forest(one, two)] == [[2, 7, 8, 9], [1, 5, 5, 5]]


def test_evaluation_edges(spark):
    none = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, score double")
    row = evaluate.prf_at(none, 0.95).first()
    assert (row["precision"], row["recall"]) == (None, None)
    got = evaluate.sweep(spark.createDataFrame([(1, 0.29), (0, 0.57), (1, 1.0)], "y int, score double")).orderBy("threshold").collect()
    assert len(got) == 101 and [(r["tp"], r["fp"]) for r in got if round(r["threshold"], 2) in (0.29, 0.3, 0.57, 0.58, 1.0)] == [(2, 1), (1, 1), (1, 1), (1, 0), (1, 0)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.month_label(F.lit("2026-07"))) == "July 2026" and one(text.month_label(F.lit("x"))) == "x"
    assert one(text.name_variants(F.lit("Santa Rosa"))) == ["Santa Rosa", "Santa Rosa City", "Sta. Rosa"]
    assert one(text.quarter_dates(F.lit("2024Q1"))[1]).isoformat() == "2024-03-31" and one(text.quarter_dates(F.lit("2024Q5"))[0]) is None
    assert one(text.baseline_date(F.lit("2024-02-29").cast("date"))).isoformat() == "2023-02-28"
    assert one(scoring.tier(F.lit(0.85))) == "high" and one(scoring.tier(F.lit(0.69))) is None
    assert one(text.slug(F.lit("  A b/c "))) == "A_b_c"


def test_readers_and_sinks(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"tile_id": "a", "lat": 1.0, "lon": 2.0, "fetch_ok": true, "score": 0.9}\nnot json\n{"tile_id": "a", "fetch_ok": false}\n{"tile_id": "b", "fetch_ok": true, "score": 0.8}\n')
    rows = readers.scan_log(spark, str(log))
    assert [(r["tile_id"], r["score"]) for r in rows.orderBy("ord").collect()] == [("a", 0.9), ("a", None), ("b", 0.8)]
    assert readers.done(rows).count() == 2
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.scan_log(spark, str(log), strict=True).collect()
    (tmp_path / "g.json").write_text(json.dumps({"_about": [{"name": "x"}], "metro": [{"name": "A"}, {"name": "B"}]}))
    assert [r["name"] for r in readers.grouped_json(spark, str(tmp_path / "g.json"), "name: string").orderBy("ord").collect()] == ["A", "B"]
    fc = sinks.feature_collection(spark.createDataFrame([(1.5, 2.5, "x")], "lon double, lat double, name string"), {"cut": 0.85}).first()[0]
    assert json.loads(fc)["features"][0]["geometry"]["coordinates"] == [1.5, 2.5]
    (tmp_path / "f.json").write_text(fc)
    got = readers.geojson(spark, str(tmp_path / "f.json"), "name string").first()
    assert (got["lon"], got["lat"], got["name"], got["keys"]) == (1.5, 2.5, "x", ["name"])
    lines = ["| Tile | Verdict |", "|---|:-:|", "| a | solar |", "text", "| Only |", "|--|", "| b |"]
    table = readers.markdown_tables(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string"))
    assert [r["row"] for r in table.orderBy("line").collect()] == [{"Tile": "a", "Verdict": "solar"}, {"Only": "b"}]
    old = spark.createDataFrame([("2024Q1", 1), ("2024Q2", 2)], "quarter string, n int")
    assert sorted(map(tuple, sinks.upsert(old, spark.createDataFrame([("2024Q2", 5)], old.schema), "quarter").collect())) == [("2024Q1", 1), ("2024Q2", 5)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, "a", float("nan")), (2, None, 9.0), (3, "c", None)], "k int, name string, z double")
    got = {(r["k"], r["rule"]) for r in gates.violations(rows, "k", gates.quarter_rules(["z"])).collect()}
    assert got == {(1, "z isn't finite"), (2, "no name"), (2, "z out of bounds")}
    with pytest.raises(ValueError):
        gates.refuse_degraded(spark.createDataFrame([(True,), (False,)], "fetch_ok boolean"))


def test_stream_writes_each_tile_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = '{"tile_id": "%s", "fetch_ok": true, "score": 0.9, "ts": "2024-01-01T00:00:0%d"}\n'
    (src / "1.json").write_text(line % ("a", 1) + line % ("b", 2) + "broken\n")
    for _ in range(2):
        q = ingest.write_once(ingest.once_per_tile(ingest.scan_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        (src / "2.json").write_text(line % ("a", 3) + line % ("c", 4))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("tile_id").collect()) == ["a", "b", "c"]
