"""Radix selection of hard negatives against sorting all scores."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewise.llm import hard_negatives as H

# names that the operator uses itself
ROWS = "vec_id long, embedding array<double>, label int, id long, v array<double>, dim int, norm double, win long, anchor long"


def brute(rows, every=5):
    best = {}
    for i, e, lab in rows:
        if i is None or e is None or lab is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * x) for x in e]
        if sum(x * x for x in v) < 2**59:
            best[i] = min(best.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in best.items() if len(w) == len(v)}
        same = sorted((-score[i], i) for i in score if i != a and best[i][0] == lab)[:5]
        for s, p in same:
            negatives = sorted((-score[i], i) for i in score if best[i][0] != lab and 30 * -s <= 100 * score[i] <= 90 * -s)[:10]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(negatives, 1)]
    return Counter(out)


def run(spark, rows, every=5):
    df = spark.createDataFrame([(i, e, lab, 1, [2.0], 3, 4.0, 5, 6) for i, e, lab in rows], ROWS).repartition(3)
    got = H.mine(H.usable(df, "vec_id", F.col("label"), "embedding"), F.col("id") % every == 0)
    return Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(n, dim, scale=0.2, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.05, scale) for _ in range(dim)], rng.randrange(4)) for i in range(n)]


def test_against_sorting(spark):
    assert run(spark, rows := vectors(240, 8)) == brute(rows)


def test_small_chunks_digits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 100)
    monkeypatch.setattr(H, "CELLS", 60)
    monkeypatch.setattr(H, "DIGITS", 4)
    assert run(spark, rows := vectors(150, 4, seed=2)) == brute(rows)


def test_ties_and_a_large_group_of_copies(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [0.5, 0.3], i % 2) for i in range(200)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_odd_rows(spark):
    rows = vectors(60, 3) + vectors(20, 0) + [
        (100, None, 1), (105, [0.1, None, 0.2], 1), (110, [0.1, math.nan, 0.2], 1), (115, [math.inf, 0.1, 0.2], 1), (None, [0.1, 0.2, 0.3], 1), (120, [0.1, 0.2, 0.3], None), (125, [0.0, 0.0, 0.0], 2),
        (-5, [0.4, 0.1, 0.2], 1), (130, [0.4, 0.1, 0.2], 1), (130, [0.4, 0.1, 0.2], 1), (130, [0.3, 0.1, 0.2], 1), (135, [0.3, 0.3], 1), (136, [0.3, 0.2], 0), (137, [0.3, 0.1], 1), (140, [1e300, 1.0, 1.0], 1), (145, [-0.5, -0.5, -0.5], 3),
    ]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [2e5, 3e5, 1e6])
def test_large_integers_are_exact(spark, scale):
    assert run(spark, rows := vectors(80, 3, scale, seed=5)) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == Counter() == run(spark, [(1, [0.1], 1), (2, [0.2], 2)])
