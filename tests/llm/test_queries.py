"""The operators' queries against their SQL, and the promises of those without one."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from tilewise.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        p = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df, rel = QUERIES[name](spark, sf_dir), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in place) for r in rel.fetchall())


def test_nearest_vectors_of_the_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict = {}
    for r in QUERIES["op1_vp_search"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    recall = []
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        recall.append(len(set(best.tolist()) & {i for _, i, _ in found}) / 10)
        assert all(abs(s - d[ids == i][0]) < 1e-12 for _, i, s in found)
        assert [s for *_, s in sorted(found)] == sorted(s for *_, s in found)
    assert np.mean(recall) >= 0.9


def test_one_row_per_document_or_page(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert QUERIES["op7_mix_sources"](spark, sf_dir).select("doc_id").distinct().count() == docs
    pages = QUERIES["op2_html_text"](spark, sf_dir).collect()
    assert len(pages) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in pages)
