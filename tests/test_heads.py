"""Fits of many groups and folds at once against separate fits with numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import heads, sampling
from tilewise.plans import catalogue
from tilewise.plans import geography as G

from .test_spatial import arc


def newton(x, y, cw, penalty):
    """Logistic regression by Newton's method with halved steps, in one place."""
    w = np.zeros(x.shape[1])
    loss = lambda w: (cw * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + (penalty * w * w).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g, h = x.T @ (cw * (p - y)) + penalty * w, (x * (cw * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12)
        d, t = np.linalg.solve(h, g), 1.0
        while loss(w - t * d) > loss(w) and t > 1e-12:
            t /= 2
        w = w - t * d
        if np.abs(t * d).max() < 1e-12:
            break
    return w


def platt(y, z):
    return newton(np.stack([z, np.ones(len(z))], 1), y, np.ones(len(y)), np.array([1e-6, 0.0]))


def head(x, y):
    n1 = y.sum()
    cw = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    return newton(np.concatenate([x, np.ones((len(x), 1))], 1), y, cw, np.append(np.ones(x.shape[1]), 0.0))


@pytest.fixture(scope="module")
def groups():
    rng, rows = random.Random(2), []
    for g, (n, slope) in {"steep": (300, 3.0), "flat": (200, 0.01), "down": (150, -2.0), "few": (80, 1.5), None: (60, 2.0)}.items():
        for _ in range(n):
            z = rng.gauss(0, 2)
            y = int(rng.random() < 1 / (1 + np.exp(-(slope * z - 0.5))))
            rows.append((g, y, round(z, 2)))
    rows = [r for r in rows if r[0] != "few" or r[1] == 0] + [("few", 1, 1.0)] * 3
    rows = [r for r in rows if r[0] != "flat"] + [("flat", y, z) for g, _, z in rows if g == "flat" for y in (0, 1)]  # no slope at all
    rows += [("one class", 0, float(i)) for i in range(9)] + [("all solar", 1, float(i)) for i in range(9)] + [("steep", None, 1.0), ("steep", 1, None), ("steep", 1, float("nan"))]
    return rows + [("apart", 0, -1.0 - i) for i in range(20)] + [("apart", 1, 1.0 + i) for i in range(20)]


def test_platt_of_all_groups(spark, groups):
    got = {r["g"]: r for r in heads.fit_platt(spark.createDataFrame(groups, "g string, y int, z double"), "g").collect()}
    assert set(got) == {g for g, *_ in groups}
    for g, r in got.items():
        y, z = (np.array(v, float) for v in zip(*[(y, z) for k, y, z in groups if k == g and y is not None and z is not None and z == z], strict=True))
        assert (r["n_pos"], r["n_neg"]) == (y.sum(), len(y) - y.sum())
        if g in ("one class", "all solar"):
            assert r["a"] is None and r["b"] is None
        else:
            assert (r["a"], r["b"]) == pytest.approx(tuple(platt(y, z)), rel=1e-4 if g == "apart" else 1e-6, abs=1e-6)


def test_calibration_and_its_guard(spark, groups):
    got = {r["g"]: r for r in heads.calibrate(spark.createDataFrame(groups, "g string, y int, z double"), "g", threshold=0.6).collect()}
    status = {g: r["status"] for g, r in got.items()}
    assert status == {"steep": "calibrated", "flat": "calibration_not_estimable", "down": "calibration_not_estimable", "few": "uncalibrated_low_n", None: "calibrated", "one class": "uncalibrated_low_n", "all solar": "calibration_not_estimable", "apart": "calibrated"}
    y, z = (np.array(v, float) for v in zip(*[(y, z) for k, y, z in groups if k == "steep" and y is not None and z is not None and z == z], strict=True))
    a, b = platt(y, z)
    p = 1 / (1 + np.exp(-(a * z + b)))
    r = got["steep"]
    tp, fp, fn = ((p >= 0.6) & (y == 1)).sum(), ((p >= 0.6) & (y == 0)).sum(), ((p < 0.6) & (y == 1)).sum()
    assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
    assert (r["brier"], r["precision"], r["recall"]) == pytest.approx((((p - y) ** 2).mean(), tp / (tp + fp), tp / (tp + fn)), rel=1e-6)
    assert all(got[g]["brier"] is None and got[g]["tp"] is None for g, s in status.items() if s != "calibrated")


def test_query_of_group_calibration(spark, sf_dir):
    rows = [(r["src"], r["y"], r["score"] * 4 - 2) for r in G.scores(spark, sf_dir).collect()]
    for r in catalogue.QUERIES["q_group_platt"](spark, sf_dir).collect():
        y, z = (np.array(v, float) for v in zip(*[(y, z) for g, y, z in rows if g == r["src"]], strict=True))
        if 0 < y.sum() < len(y):
            a, b = platt(y, z)
            assert r["a"] == pytest.approx(a, abs=1e-6)
            assert r["b"] is None or r["b"] == pytest.approx(b, abs=1e-6)


def vectors(n, sources, seed=1, dim=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, dim))
    y = (x @ rng.normal(0, 1, dim) + rng.normal(0, 1, n) > 0.3).astype(float)
    return [(i, f"s{i % sources}", float(y[i]), x[i].tolist()) for i in range(n)]


SCHEMA = "id long, src string, y double, v array<double>"


def expected(rows):
    x, y, src = np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for s in set(src):
        w = head(x[src != s], y[src != s])
        out |= {rows[i][0]: 1 / (1 + np.exp(-(x[i] @ w[:-1] + w[-1]))) for i in np.flatnonzero(src == s)}
    return out


def test_leave_one_source_out_equals_separate_fits(spark, monkeypatch):
    rows = vectors(240, 7)
    extra = [(900, "s0", None, [0.0] * 5), (901, "s0", 1.0, None), (902, "s1", 1.0, [0.0, None, 0.0, 0.0, 0.0])]
    df = heads.by_source(spark.createDataFrame(rows + extra, SCHEMA).repartition(3), "src")
    want = expected(rows)
    got = {r["id"]: r["score"] for r in heads.out_of_fold(df, "fold", "v", "y").collect()}
    assert got == pytest.approx(want, abs=1e-7)
    monkeypatch.setattr(heads, "FOLDS_AT_ONCE", 3)  # in rounds
    assert {r["id"]: r["score"] for r in heads.out_of_fold(df, "fold", "v", "y").collect()} == pytest.approx(want, abs=1e-7)


def test_jobs_do_not_grow_with_folds(spark):
    def jobs(sources):
        df = heads.by_source(spark.createDataFrame(vectors(200, sources), SCHEMA), "src")
        spark.sparkContext.setJobGroup(f"folds-{sources}", "")
        heads.out_of_fold(df, "fold", "v", "y").count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{sources}"))

    few, many = jobs(3), jobs(40)
    spark.sparkContext.setJobGroup("", "")
    assert 5 < many <= few + 12  # a step more or less, not 37 fits


def test_a_fold_that_holds_a_whole_class(spark):
    rows = [(i, "a" if i % 2 else "b", float(i % 2), [float(i)]) for i in range(20)]
    got = heads.out_of_fold(heads.by_source(spark.createDataFrame(rows, SCHEMA), "src"), "fold", "v", "y").collect()
    assert len(got) == 20 and all(r["score"] is None for r in got)
    assert heads.out_of_fold(spark.createDataFrame([], SCHEMA).withColumn("fold", F.lit(1)), "fold", "v", "y").count() == 0


def test_queries_of_folds(spark, sf_dir):
    rows = [(r["vec_id"], f"s{r['vec_id'] % 23}", float(r["label"] < 3), [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r["vec_id"]: r["score"] for r in catalogue.QUERIES["q_leave_one_source"](spark, sf_dir).collect()}
    assert got == pytest.approx(expected(rows), abs=2e-5)
    folds = {r["vec_id"]: (r["src"], r["fold"], r["score"]) for r in catalogue.QUERIES["q_source_folds"](spark, sf_dir).collect()}
    assert len({(s, f) for s, f, _ in folds.values()}) == 23
    want = expected([(i, str(folds[i][1]), y, v) for i, _, y, v in rows])
    assert {i: s for i, (*_, s) in folds.items()} == pytest.approx(want, abs=2e-5)


def test_negatives_of_regions(spark):
    rng = random.Random(4)
    scan = [(f"t{i}", 14.4 + rng.random() * 0.2, 120.9 + rng.random() * 0.2, i % 11 > 0, 0.1, "hot" if i % 3 else "small") for i in range(900)] + [("x", None, 1.0, True, 0.1, "small"), (None, 14.5, 121.0, True, 0.1, "small"), ("y", 14.5, 121.0, True, None, "small"), ("z", 14.5, 121.0, True, 0.2, None)]
    scan += scan[5:40]
    known = [(i, 14.4 + rng.random() * 0.2, 120.9 + rng.random() * 0.2) for i in range(150)]
    df, k = spark.createDataFrame(scan, "tile_id string, lat double, lon double, fetch_ok boolean, score double, region string"), spark.createDataFrame(known, "k long, lat double, lon double")
    away = {(t, g) for t, la, lo, ok, s, g in scan if None not in (t, la, lo, s, g) and ok and all(arc((la, lo), p) >= 240 for _, *p in known)}
    got = sampling.region_negatives(df, k, 300)
    rows = [tuple(r) for r in got.collect()]
    assert {g: sum(r[0] == g for r in rows) for g in ("hot", "small")} == {g: min(300, sum(x == g for _, x in away)) for g in ("hot", "small")}
    assert {(r[1], r[0]) for r in rows} <= away and len({r[1] for r in rows}) == len(rows)
    assert sorted(rows) == sorted(tuple(r) for r in sampling.region_negatives(df.repartition(7), k.repartition(5), 300).collect())
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # a task sends k rows of a group at most


def test_random_points(spark):
    known = spark.createDataFrame([(14.5, 121.0)], "lat double, lon double")
    got = sampling.random_points(known, 200).collect()
    assert len(got) == 200 and all(r["reason"] is None for r in got)
    assert all(14.40 <= r["lat"] <= 14.78 and 120.92 <= r["lon"] <= 121.13 and arc((r["lat"], r["lon"]), (14.5, 121.0)) >= 240 for r in got)
    few = sampling.random_points(known, 50, bbox=(14.4985, 120.9985, 14.5015, 121.0015)).collect()
    assert len(few) < 50 and all(r["reason"] == f"150 draws left {len(few)} of 50" for r in few)
    assert sampling.random_points(known.where("lat < 0"), 10, seed=1).count() == 10
