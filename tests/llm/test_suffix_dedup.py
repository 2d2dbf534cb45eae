import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tilewise.llm import suffix_dedup
from tilewise.llm.suffix_dedup import common_prefixes, dedup_substrings, op6, repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, spans string, text_key string"


def brute(rows, length):
    seen = Counter(b[i : i + length] for b in (t.encode() for t in rows) for i in range(len(b) - length + 1))
    out = []
    for t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(120):
        n = rng.randrange(1, 300)
        data = bytes(rng.choice(b"ab\xff" if trial % 3 else b"abcdefgh\x00") for _ in range(n))
        x = np.frombuffer(data, np.uint8)
        order = suffix_array(x, 400)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:]), data
        want = [0] + [next((k for k in range(n) if a + k >= n or b + k >= n or data[a + k] != data[b + k]), n) for a, b in zip(order, order[1:])]
        assert common_prefixes(x, order, 400).tolist() == want


def test_long_repeats_are_not_gone_through_again_and_again():
    rng = np.random.default_rng(5)

    def seconds(x):
        started = time.process_time()
        order = suffix_array(x, 400)
        common_prefixes(x, order, 400)
        return time.process_time() - started

    alone = rng.integers(97, 123, 400_000, dtype=np.uint8)
    twice = np.tile(alone[:100_000], 4)
    assert min(seconds(twice) for _ in range(3)) < 8 * min(seconds(alone) for _ in range(3))


def test_words_of_all_lengths_and_bytes():
    rng = random.Random(6)
    for trial in range(60):
        letters = [b"a", b"\x00\xff", bytes(range(256))][trial % 3]
        data = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 400))) * (1 + trial % 2)
        x = np.frombuffer(data, np.uint8)
        for depth in (1, 3, 80, 81, 150, 400):
            order = suffix_array(x, depth)
            assert sorted(order.tolist()) == list(range(len(data)))
            words = [data[i : i + depth] for i in order]
            assert words == sorted(words)
            want = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(words, words[1:])]
            assert common_prefixes(x, order, depth).tolist() == want


def test_repeated_starts():
    a, b = repeated_starts([b"abcabcabd", b"xabcab"], [7, 4], 3)
    assert a.tolist() == [True, True, True, True, True, True, False] and b.tolist() == [False, True, True, True]


@pytest.mark.parametrize("hot", [1 << 24, 50])
def test_small_strings(spark, hot):
    rng, rows = random.Random(3), []
    base = "".join(rng.choice("abcdefghij é") for _ in range(300))
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("xyz\n")
        rows.append("".join(t)[rng.randrange(50) : rng.randrange(200, 301)])
    rows += ["", "short", "ab" * 200, "ab" * 200, "c" * 90, "unique " + "".join(rng.choice("klmn") for _ in range(100))]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(rows)], SCHEMA)
    got = dedup_substrings(df, 40, 10, shard_bytes=3000, hot_bytes=hot).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(rows, 40)


def test_strings_of_a_hot_anchor_are_sorted(spark, monkeypatch):
    """60 near copies under one anchor: dealt again, all of it goes through suffix arrays, and no string is counted by itself."""
    rng = random.Random(6)
    base = [rng.choice("abcdefgh ") for _ in range(700)]
    rows = []
    for _ in range(60):
        t = list(base)
        for _ in range(6):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append("".join(t))
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(suffix_dedup, "count_strings", lambda *a: pytest.fail("counted"))
    got = dedup_substrings(df, 80, 10, shard_bytes=3000, hot_bytes=40_000).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(rows, 80)


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = op6(spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute([r["text"] or "" for r in rows], 400)
    assert all(r["removed_share"] == pytest.approx(r["n_removed"] / max(1, r["n_bytes"])) for r in got)


def test_nulls_and_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
    got = dedup_substrings(spark.createDataFrame([(None, None, "", ""), (1, "q" * 500, "", "")], SCHEMA)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == [(0, 0, 0), (500, 500, 1)]


def test_periodic_text_takes_bounded_memory():
    data = np.frombuffer(b"ab" * 100_000 + b"a\0" * 1000 + b"abc" * 50_000, np.uint8)
    tracemalloc.start()
    order = suffix_array(data, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw = data.tobytes()
    assert sorted(order.tolist()) == list(range(len(data))) and peak < 120 * len(data)
    some = [raw[i : i + 400] for i in order[::37]]
    assert some == sorted(some)


def test_planted_passages_around_the_length(spark):
    # 52 words of 6 letters are 363 bytes and stay; 60 are 419 and go from all documents; all else is left alone
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    short, exact, long = words(52), words(58)[:400], words(60)
    docs = {}
    for i in range(40):
        passage = (None, short, exact, long)[i % 4]
        docs[i] = (words(80), passage, words(70))
    # what stands beside a passage is another letter in each document
    rows = [(i, f"{a}{chr(48 + i)}{p}{chr(48 + i)}{b}" if p else f"{a} {b}") for i, (a, p, b) in docs.items()]
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()}
    for i, (a, p, b) in docs.items():
        text = dict(rows)[i]
        if i % 4 < 2:
            assert got[i]["n_removed"] == 0 and bytes(got[i]["kept"]) == text.encode()
        else:
            assert got[i]["n_removed"] == len(p) and got[i]["n_spans"] == 1 and bytes(got[i]["kept"]).decode() == text.replace(p, "")
