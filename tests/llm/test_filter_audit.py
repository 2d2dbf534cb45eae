"""The filter audit against a plain loop over orders."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tilewise.llm import filter_audit

# names that the operator uses itself
DOCS = "doc_id long, text string, source string, mask int, hash string, part string, kind int, _first long, good int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """(part, order, step) -> the seven counts."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    ids = defaultdict(list)
    for i, t, _ in docs:
        ids[t or ""].append(i)
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in ids[t])}
        parts[s or ""].append(("".join(k for k, v in fails.items() if v), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shapley[part, f] += len(gone)
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: rng.choice(["river", "Stone", "the", "HOUSE", "agua", "niño", "x\x1cy", "a b", "50%", "ok", "light", "water"]) + str(rng.randrange(60))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    docs = [(i, rng.choice(texts), rng.choice(["s0", "s0", "s1", None, ""])) for i in range(300)]
    docs += [(900, None, "s1"), (901, "", "s1"), (None, texts[0], "s0"), (None, None, None), (902, "same", "s0"), (902, "same", "s0"), (903, " ".join(f"w{i % 50_000}" for i in range(400_000)), "s2")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (5000, 1, 1), (7, None, None)]
    return docs, labels


def test_against_a_loop(spark, rows, monkeypatch):
    docs, labels = rows
    frame = spark.createDataFrame([(*d, 1, "h", "p", 2, 3, 4) for d in docs], DOCS).repartition(3)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS))
    assert Counter(map(tuple, got.collect())) == brute(docs, labels)


def test_partial_arrays_are_sent_early(spark, rows, monkeypatch):
    docs, labels = rows
    docs = [(i, t, f"host{k % 37}") for k, (i, t, _) in enumerate(docs)]
    frame = spark.createDataFrame([(*d, 1, "h", "p", 2, 3, 4) for d in docs], DOCS)
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 5)
    monkeypatch.setattr(filter_audit, "ROWS", 20)
    assert Counter(map(tuple, filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect())) == brute(docs, labels)


def test_pieces_keep_words_whole(rows):
    for _, t, _ in rows[0][-7:]:
        b = (t or "").encode()
        cut = list(filter_audit.pieces(b, 100))
        assert b"".join(cut) == b and [w for p in cut for w in p.split()] == b.split()
    assert list(filter_audit.pieces(b"x" * 500, 100)) == [b"x" * 500]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "text", "s", 1, "h", "p", 2, 3, 4)], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0
