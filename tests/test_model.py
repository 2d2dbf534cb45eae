"""Fits of the catalogue against numpy, and functions that no query uses."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.functions import scoring
from tilewise.operators import dedupe, evaluate, model, raster, spatial
from tilewise.plans import catalogue
from tilewise.plans import geography as G
from tilewise.sources import readers, sinks
from tilewise.streaming import ingest

from .test_heads import head, platt


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), np.array([[float(x) for x in r["embedding"]] for r in rows])


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def test_head_of_all_vectors(spark, sf_dir):
    ids, label, x = vectors(spark, sf_dir)
    w = head(x, (label < 3).astype(float))
    want = dict(zip(ids.tolist(), sigmoid(x @ w[:-1] + w[-1]), strict=True))
    assert {r["vec_id"]: r["score"] for r in catalogue.QUERIES["q_fit_lr"](spark, sf_dir).collect()} == pytest.approx(want, abs=1e-4)


def test_leave_one_region_out(spark, sf_dir):
    ids, label, x = vectors(spark, sf_dir)
    y, region = (label < 2).astype(float), ids % 4
    got = {r["region"]: r for r in catalogue.QUERIES["q_loro"](spark, sf_dir).collect()}
    assert set(got) == {"0", "1", "2", "3"}
    for g in range(4):
        w = head(x[region != g], y[region != g])
        own, p = y[region == g], sigmoid(x[region == g] @ w[:-1] + w[-1])
        assert np.abs(p - 0.5).min() > 1e-6
        tp, fp, fn = ((p >= 0.5) & (own == 1)).sum(), ((p >= 0.5) & (own == 0)).sum(), ((p < 0.5) & (own == 1)).sum()
        r = got[str(g)]
        assert (r["tp"], r["fp"], r["fn"], r["n_neg"]) == (tp, fp, fn, (own == 0).sum())
        assert (r["recall"], r["precision"]) == pytest.approx((tp / (tp + fn), tp / (tp + fp)))


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def test_domain_auc(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label in (0, 1)").withColumn("h", F.xxhash64(F.lit(1202), "vec_id")).collect()
    x, y, s = np.array([[float(v) for v in r["embedding"]] for r in e]), np.array([float(r["label"] == 1) for r in e]), np.zeros(len(e))
    fold = np.zeros(len(e), int)
    for c in (0, 1):
        mine = sorted((i for i in range(len(e)) if y[i] == c), key=lambda i: (e[i]["h"], e[i]["vec_id"]))
        fold[mine] = np.arange(len(mine)) % 5
    for f in range(5):
        w = head(x[fold != f], y[fold != f])
        s[fold == f] = sigmoid(x[fold == f] @ w[:-1] + w[-1])
    got = catalogue.QUERIES["q_domain_auc"](spark, sf_dir).first()
    assert got["folds"] == 5 and got["auc"] == pytest.approx(auc(y, s), abs=2e-6)


def test_platt_and_isotonic_of_scores(spark, sf_dir):
    rows = G.scores(spark, sf_dir).collect()
    y, s = np.array([float(r["y"]) for r in rows]), np.array([r["score"] for r in rows])
    a, b = platt(y, s)
    got = catalogue.QUERIES["q_platt_fit"](spark, sf_dir).first()
    assert (got["a"], got["b"]) == pytest.approx((a, b), abs=1e-3)
    # pools of neighbours, equal scores first, until their means go up
    pools = [[y[s == v].sum(), (s == v).sum(), v] for v in np.unique(s)]
    out: list = []
    for p in pools:
        out.append([p[0], p[1], [p[2]]])
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            t, n, v = out.pop()
            out[-1] = [out[-1][0] + t, out[-1][1] + n, out[-1][2] + v]
    want = {v: t / n for t, n, vs in out for v in vs}
    for r in catalogue.QUERIES["q_fit_isotonic"](spark, sf_dir).collect():
        assert r["calibrated"] == pytest.approx(want[r["score"]], abs=1e-9)


def test_operating_points_and_five_numbers(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.2)], "y int, score double")
    got = {r["point"]: (r["threshold"], r["tp"], r["fp"]) for r in evaluate.operating_points(df).collect()}
    assert got == {"high_precision": (0.7, 3, 0), "target": (0.61, 3, 0), "deployed": (0.85, 1, 0)}
    assert set(r["point"] for r in evaluate.operating_points(df.where("y = 0")).collect()) == {"deployed"}
    rows = [("a", x) for x in (5.0, 1.0, 1.0, 3.0, 9.0, 1.0, 7.0)] + [("b", 2.0), (None, 4.0), (None, 6.0), ("c", None)]
    five = {r["g"]: tuple(r)[1:] for r in evaluate.five_numbers(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert five == {"a": (1.0, 1.0, 3.0, 7.0, 9.0, 7), "b": (2.0, 2.0, 2.0, 2.0, 2.0, 1), None: (4.0, 4.0, 6.0, 6.0, 6.0, 2)}


def test_best_building_counts_a_pair_once(spark):
    ring = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    buildings = [(1, 5, ring(0.0, 0.0, 0.01, 0.01)), (2, 4, ring(0.009, 0.0, 0.01, 0.01)), (3, 3, ring(0.05, 0.05, 0.001, 0.001)), (4, 2, [[0.0, 0.02], [0.02, 0.02], [0.0, 0.04]])]
    segments = [(10, 0.005, 0.005, ring(0.004, 0.004, 0.002, 0.002)), (11, 0.0095, 0.005, ring(0.008, 0.004, 0.003, 0.002)), (12, 0.025, 0.025, ring(0.018, 0.02, 0.014, 0.01)), (13, 0.5, 0.5, ring(0.5, 0.5, 0.1, 0.1)), (14, -0.001, 0.005, ring(-0.002, 0.004, 0.003, 0.002)), (10, 0.005, 0.005, ring(0.004, 0.004, 0.002, 0.002))]
    got = spatial.best_building(spark.createDataFrame(segments, "seg_id long, lon double, lat double, ring array<array<double>>"), spark.createDataFrame(buildings, "osm_id long, ord long, ring array<array<double>>")).collect()
    assert {(r["seg_id"], r["osm_id"], r["inside"]) for r in got} == {(10, 1, True), (11, 2, True), (12, 4, False), (14, 1, False)} and len(got) == 4


def test_readers_and_writers_without_a_query(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name, size in (("14.40108_120.92112.jpg", 2000), ("14.5_121.0.jpg", 900), ("other.jpg", 5000), ("14.6_-121.5.jpg", 1001)):
        (tmp_path / "img" / name).write_bytes(b"x" * size)
    tiles = readers.image_tiles(spark, str(tmp_path / "img"))
    assert {(r["lat"], r["lon"], r["length"]) for r in tiles.collect()} == {(14.40108, 120.92112, 2000), (14.6, -121.5, 1001)}
    assert all("bbox=" in r["url"] and r["url"].startswith("http://x?") for r in readers.fetch_plan(tiles, "http://x").collect())
    config = spark.createDataFrame([("cebu", 1), ("davao", 2)], "slug string, n int")
    assert readers.config_row(config, "slug", "davao").first()["n"] == 2
    with pytest.raises(KeyError, match="known are cebu, davao"):
        readers.config_row(config, "slug", "manila")
    points = spark.createDataFrame([(121.0, 14.5, "a", None), (121.5, 14.6, "b", 0.5)], "lon double, lat double, name string, score double")
    sinks.write_features(points, str(tmp_path / "features"))
    features = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "features")).collect()]
    assert sorted((f["properties"]["name"], f["geometry"]["coordinates"]) for f in features) == [("a", [121.0, 14.5]), ("b", [121.5, 14.6])]
    sinks.write_csv(points, str(tmp_path / "csv"), ["name", "score"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("a", None), ("b", "0.5")]


def test_largest_parts_and_tier_counts(spark, tmp_path):
    parts = spark.createDataFrame([(0, 0, y, x) for y in range(3) for x in range(4)] + [(5, 5, 5, 5)] + [(9, 9, 9, x) for x in range(12)], "part_py int, part_px int, py int, px int")
    got = raster.largest_parts(parts, 1, 12 + 1, 1).collect()
    assert [(r["part_py"], r["pixels"], r["cy"], r["cx"]) for r in got] == [(0, 12, 1.0, 1.5)]
    (tmp_path / "in").mkdir()
    records = [("a", 0.9, 0), ("b", 0.75, 1), ("c", 0.1, 2), ("d", None, 3), ("e", 0.86, 70)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"tile_id": t, "score": s, "ts": f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00Z"}) for t, s, m in records))
    q = ingest.tier_counts(ingest.scan_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tiers").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["tier"], r["n"], r["h"]) for r in spark.sql("select tier, n, hour(window.start) as h from tiers").collect()} == {("high", 1, 0), ("candidate", 1, 0), ("below", 2, 0), ("high", 1, 1)}


def test_zero_shot_heads_and_groups(spark):
    rows = spark.createDataFrame([("s", [3.0, 4.0], 1), ("s", [0.0, 2.0], 0), ("t", [-1.0, 0.0], 0)], "src string, v array<double>, y int")
    got = {r["src"]: r["margin"] for r in model.zero_shot(rows, "v", [1.0, 0.0], [0.0, 1.0], "src").collect()}
    assert got == pytest.approx({"s": -0.2, "t": -1.0})
    assert model.head_frame(spark, [0.5, -1.0], 0.25, 1.2).collect()[0].asDict() == {"coefficients": [0.5, -1.0], "intercept": 0.25, "a": 1.2, "b": None}
    unit = [r[0] for r in rows.select(scoring.l2_normalised(F.col("v"))).collect()]
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[2] == [-1.0, 0.0]
    same = dedupe.dedupe_grouped(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 0)], "k int, name string, ord int"), [F.col("k")], "ord")
    assert {(r["k"], r["name"]) for r in same.collect()} == {(1, "b"), (2, "c")}
