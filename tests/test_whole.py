"""Queries that answer for whole tables, on fixtures and against SQL without the cuts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.operators import model, spatial
from tilewise.plans import catalogue


def test_holdout_compares_whole_texts(spark, tmp_path):
    text = "The same first twenty letters, then this one"
    docs = [("same", text), ("case", text.upper()), ("begins", text[:30] + "something else"), ("holds", "Before it: " + text), ("other", "x")]
    spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(docs)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text), (2, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["q_holdout_antijoin"](spark, str(tmp_path)).collect()
    assert {r["src"]: r["n"] for r in got} == {"begins": 1, "holds": 1, "other": 1}


def brute_mmd2(x, y):
    both = np.concatenate([x, y]).astype(float)
    d2 = ((both[:, None] - both[None]) ** 2).sum(2)
    up = np.triu(np.ones(d2.shape, bool), 1)
    k = np.exp(-d2 / np.median(d2[up & (d2 > 0)]))
    n, m = len(x), len(y)
    inside = lambda part: part[np.triu_indices(len(part), 1)].mean()
    return inside(k[:n, :n]) + inside(k[n:, n:]) - 2 * k[:n, n:].mean()


def test_mmd_counts_all_vectors(spark, sf_dir):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (130, 4)), rng.normal(0.3, 1, (95, 4))
    x[100:] += 2  # those with later ids lie elsewhere
    x[3] = x[4]
    rows = [(i, True, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, False, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, one boolean, v array<double>")
    for block in (17, 60, 1000):
        assert model.mmd2(df, F.col("one"), "id", "v", block=block).first()[0] == pytest.approx(brute_mmd2(x, y), abs=1e-12)
    assert model.mmd2(df.where("id < 1"), F.col("one"), "id", "v").first()[0] is None
    got = {label: np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label") == label).collect()]) for label in (0, 1)}
    assert min(map(len, got.values())) > 40
    assert catalogue.QUERIES["q_mmd"](spark, sf_dir).first()["mmd2"] == pytest.approx(brute_mmd2(got[0], got[1]), abs=1e-6)


def uncut(sf_dir, name, *cuts):
    """The rows of a query's SQL without its cuts (pairs of what is there and what takes its place)."""
    sql, db = catalogue.SQL[name], duckdb.connect()
    for old, new in cuts:
        sql = sql.replace(old, new)
    for t in ("customer", "supplier", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = db.sql(sql)
    return rel.columns, sorted(rel.fetchall())


def test_nearest_cases_of_all_tags(spark, sf_dir):
    columns, want = uncut(sf_dir, "q_nearest_cases", (" WHERE s_suppkey < 12", ""), (" WHERE o.osm_id % 7 = 0", ""))
    got = catalogue.QUERIES["q_nearest_cases"](spark, sf_dir).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == want
    assert len(got) == 3 * spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_nearest_k_far_few_and_tied(spark):
    rng = np.random.default_rng(5)
    place = lambda n, far: [(i, *map(float, rng.uniform((14, 120), (14.5, 120.5)) + (far if i % 10 == 0 else 0))) for i in range(n)]
    a, b = place(60, 8), place(40, 3)
    b += [(100 + i, *b[i][1:]) for i in range(5)]  # ties
    left, right = spark.createDataFrame(a, "k long, lat double, lon double"), spark.createDataFrame(b, "r long, lat double, lon double")

    def metres(p, q):
        x, y, u, v = map(np.radians, (p[1], q[1], p[2], q[2]))
        return 2 * 6371000 * np.arcsin(np.sqrt(np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin((v - u) / 2) ** 2))

    for some, k in ((b, 3), (b[:2], 3), ([], 3)):
        got = spatial.nearest_k(left, right.where(F.col("r").isin([r for r, *_ in some])), "k", "r", k).collect()
        want = {(p[0], rank, r) for p in a for rank, (_, r) in enumerate(sorted((round(metres(p, q), 6), q[0]) for q in some)[:k], 1)}
        assert {(r["k"], r["rank"], r["r"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(
    "name, cuts",
    [
        ("q_nearby", [(" WHERE o.osm_id % 5 = 0", "")]),
        ("q_capacity_labels", [(" WHERE (ord * 31) % 5 = 0", ""), ("printf('%.1f', score * 40e0)", "round((score * 40e0)::DECIMAL(28,6), 1)::DECIMAL(28,1)::VARCHAR")]),
        ("q_training_sources", [("osm_id % 4 = 1", "osm_id % 4 <> 0")]),
    ],
)
def test_query_answers_for_all_rows(spark, sf_dir, name, cuts):
    columns, want = uncut(sf_dir, name, *cuts)
    got = catalogue.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == want


def test_each_tag_has_a_class_and_each_detection_a_label(spark, sf_dir):
    tags = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 9 <> 0").count()
    assert catalogue.QUERIES["q_training_sources"](spark, sf_dir).select("key").distinct().count() == tags
    labels = catalogue.QUERIES["q_capacity_labels"](spark, sf_dir).collect()
    assert any((r["ord"] * 31) % 5 for r in labels)
