import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.llm import parity_join
from tilewise.llm.parity_join import keys, near_components, one_of_each, op3, same_size, shingles, sketch

SCHEMA = "doc_id long, text string, keys string, component_id string"


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(rows, k, num, den):
    """{row index: (set size, component)} by comparing all pairs."""
    sets, ids = sets_of([t for _, t in rows], k), [i for i, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= max(len(x), len(y)) * num and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), low[find(i)]) for i in range(len(rows)))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op3(spark, sf_dir)) == brute(rows, 3, 9, 10)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_groups_and_chains(spark, k, num, den):
    rng, rows = random.Random(k), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    for i in range(60):  # each differs from the one before by a word: a chain whose ends aren't similar
        base = base[:]
        base[rng.randrange(400)] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    for i in range(40):  # around the threshold
        words = [f"v{j}" for j in range(100)]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(3000 + i, t) for i, t in enumerate(["", None, " \t\n", "one", "ONE", "one two", "two one", "a b c", "A\x0bB\x0cc", "É é", "a\xa0b"])]
    rows += [(5000 + i, " ".join(base[:395] + [f"z{i}a", f"z{i}b", f"z{i}c", f"z{i}d", "end"])) for i in range(20)]
    rows += [(4000 + i, "same text as the others in this group " * 3) for i in range(30)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    assert got(near_components(df, k, (num, den))) == brute(rows, k, num, den)
    kept = one_of_each(df, k, (num, den))
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows, k, num, den)})


@pytest.mark.parametrize("nearest", [1, 4])
def test_near_groups_in_chunks_and_rounds(spark, monkeypatch, nearest):
    # many texts around the threshold under the same keys, in chunks of a few: some pairs are left to the last round
    for name, value in (("CHUNK", 7), ("SET_CHUNK", 5), ("NEAREST", nearest), ("ROUNDS", 1), ("FREQUENT", 4), ("SHARED_AT_ONCE", 300)):
        monkeypatch.setattr(parity_join, name, value)
    rng, rows = random.Random(17), []
    for g in range(3):
        words = [f"g{g}w{j}" for j in range(120)]
        for i in range(30):
            own = words[:]
            for j in rng.sample(range(120), rng.randint(1, 6)):
                own[j] = f"n{rng.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(own)))
    common = " ".join(f"c{j}" for j in range(60))  # a passage that all of these share and nothing else
    rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(90)) + " " + common) for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    assert got(near_components(df, 5, (8, 10))) == brute(rows, 5, 8, 10)


def test_open_pairs_equal_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 400 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in rng.integers(0, 80, 60)]
    bits, size, comp = same_size([sketch(x) for x in sets], 64), np.array(list(map(len, sets))), rng.integers(0, 20, 60)
    apart = np.array([[int(np.bitwise_count(a ^ b).sum()) for b in bits] for a in bits])
    for one, two in ((np.arange(60), np.arange(60)), (np.arange(25), np.arange(25, 60))):
        want = {(i, j) for i in one for j in two if comp[i] != comp[j] and apart[i, j] * 18 <= (size[i] + size[j]) * 2 and min(size[i], size[j]) * 10 >= max(size[i], size[j]) * 8}
        both = want | {(j, i) for i, j in want}
        x, y, more = parity_join._nearest_open(comp, size, bits, one, two, 8, 10, 3)
        for i in range(60):
            near = sorted((apart[i, j], j) for k, j in both if k == i)
            assert [int(v) for v in y[x == i]] == [j for _, j in near[:3]] and all(more[x == i] == (len(near) > 3))
        a, b = parity_join._verified_forest(comp, size, bits, sets, one, two, 8, 10)
        similar = {(i, j) for i, j in want if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(a, b)) <= similar and len(a) < len(np.unique(comp))


def test_similar_sets_share_a_key():
    rng = random.Random(5)
    for trial in range(400):
        n = rng.randrange(9, 300)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - n // rng.choice([5, 6, 8, 12]) + 0)) | {rng.getrandbits(64) for _ in range(n // 25)}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        num = rng.choice([8, 9])
        if 10 * len(a & b) >= num * len(a | b) and a != b:
            assert np.intersect1d(keys(x, num, 10), keys(y, num, 10)).size, trial


def test_empty_table_and_null_ids(spark):
    assert near_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "", ""), (7, "a b c d e f", "", ""), (None, None, "", "")], SCHEMA)
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in near_components(df).collect()), key=str) == [(7, 2), (None, 0), (None, 2)]
    assert len(shingles(["a b", "a  b"], 5)[0]) == 1


def test_sketches_bound_the_difference_at_any_size():
    rng = random.Random(8)
    for n in (5, 1000, 1030, 3000):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(sorted(a)[: n - n // 7]) | {rng.getrandbits(64) for _ in range(n // 9)}
        x, y = (sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(same_size([x], size) ^ same_size([y], size)).sum())
        assert apart <= len(a ^ b) and (len(a ^ b) - apart) % 2 == 0 and apart >= 0.6 * len(a ^ b)


def test_sets_of_a_group_are_sent_once_a_chunk(spark):
    """1,500 near copies, all paired with the smallest and the largest of them: no class is in more than 100 rows with sets, where each pair had held both."""
    n = 1500
    pairs = spark.range(1, n).selectExpr("0L as a", "id as b").union(spark.range(1, n - 1).selectExpr("id as a", f"cast({n - 1} as long) as b"))
    dealt = parity_join.around_hubs(pairs).cache()
    assert {(min(r["hub"], r["other"]), max(r["hub"], r["other"])) for r in dealt.collect()} == {tuple(r) for r in pairs.collect()}
    sets = spark.range(n).selectExpr("id as node", "array(id) as set")
    rows = parity_join.with_sets(dealt, sets)
    assert rows.count() == dealt.count() + dealt.select("hub", "chunk").distinct().count()
    of = rows.selectExpr("coalesce(other, hub) as node").groupBy("node").count().agg(F.max("count")).first()[0]
    assert of <= 100
    chunk = rows.groupBy("hub", "chunk").count().agg(F.max("count"), F.avg("count")).first()
    assert chunk[0] < 160 and chunk[1] > 50
