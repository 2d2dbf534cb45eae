"""The closed form of the schedule against a loop that serves the queues token by token and carries what it owes them."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from tilewise.llm import packing


def deficit_loop(sizes, weights, length):
    """Tokens of each queue in each window. With each token that is put out every queue earns its share; it goes to the queue that was first owed half a token.

    A queue that has earned all its tokens no longer earns, and the others share its place by weight.
    """
    earned, due, now = [Fraction(0)] * len(sizes), [], Fraction(0)
    while any(e < s for e, s in zip(earned, sizes, strict=True)):
        live = [i for i, s in enumerate(sizes) if earned[i] < s]
        live = [i for i in live if weights[i] > 0] or live
        whole = sum(Fraction(weights[i] or sizes[i]) for i in live)
        share = {i: Fraction(weights[i] or sizes[i]) / whole for i in live}
        # up to the next moment at which some queue is owed half a token, or has earned all
        step = min((min(x for x in (int(earned[i] + Fraction(1, 2)) + Fraction(1, 2), Fraction(sizes[i])) if x > earned[i]) - earned[i]) / share[i] for i in live)
        now += step
        for i in live:
            earned[i] += step * share[i]
            if earned[i] % 1 == Fraction(1, 2):
                due.append((round(float(now), 6), i))
    due.sort()
    assert [sum(q == i for _, q in due) for i in range(len(sizes))] == list(sizes)
    return [[sum(q == i for _, q in due[k : k + length]) for i in range(len(sizes))] for k in range(0, len(due), length)]


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_a_deficit_round_robin(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 12), rng.randrange(1, 400)]) for _ in range(rng.randrange(1, 8))]
    weights = sizes if seed % 3 == 0 else [rng.choice([0.5, 1.0, 2.0, 3.25, 0.0]) for _ in sizes]
    length = rng.choice([16, 64, 100])
    plan, want = packing.Schedule(sizes, None if seed % 3 == 0 else weights), deficit_loop(sizes, weights, length)
    for k, take in enumerate(want):
        t = min(plan.total, (k + 1) * length)
        assert [plan.served(i, t)[1] - plan.served(i, k * length)[1] for i in range(len(sizes))] == take


@pytest.mark.parametrize("seed", range(20))
def test_small_sources_leave_no_gap(seed):
    """Queues of a few tokens beside large ones: every token is in one piece, and every window is full and without a gap."""
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 30), rng.randrange(1, 900)]) for _ in range(rng.randrange(2, 12))]
    plan, length = packing.Schedule(sizes, None if seed % 2 else [rng.choice([0.5, 1.0, 2.0, 3.25]) for _ in sizes]), 16
    rows = [(q, "s", q, 0, n, np.arange(n, dtype="<u2").tobytes()) for q, n in enumerate(sizes)]
    out = packing.cut(dict(zip(("doc_id", "source", "queue", "first", "n", "ids"), map(list, zip(*rows, strict=True)), strict=True)), plan, length)
    places, tokens = defaultdict(list), defaultdict(list)
    for d, start, n, seq, offset in zip(*(out[k] for k in ("doc_id", "start", "length", "sequence_id", "offset")), strict=True):
        places[seq] += range(offset, offset + n)
        tokens[d] += range(start, start + n)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert {d: sorted(v) for d, v in tokens.items()} == {q: list(range(n)) for q, n in enumerate(sizes)}
    assert sum(len(v) == length for v in places.values()) >= sum(sizes) // length


def test_packed_windows_hold_what_the_loop_serves(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("river stone water light house".split()) for _ in range(rng.randrange(1, 120))), rng.choice("aaab") + "c" * (i % 2)) for i in range(120)]
    weights = {"a": 2.0, "ac": 1.0, "b": 1.0, "bc": 3.0}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), weights, 256).collect()
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p["source"]] += p["length"]
    queues = sorted(sizes)
    want = deficit_loop([sizes[q] for q in queues], [weights[q] for q in queues], 256)
    full = sum(sizes.values()) // 256
    got = [[sum(p["length"] for p in pieces if p["source"] == q and (p["sequence_id"] == k if k < full else p["sequence_id"] >= full)) for q in queues] for k in range(len(want))]
    assert got == want


def test_a_worker_keeps_what_its_encoder_knows():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder.of(path)
    first = encoder.batch(["Some words, and some more.", None])
    assert packing.Encoder.of(path) is encoder and " words," in encoder.known
    assert packing.Encoder.of(path).batch(["Some words, and some more.", None]) == first == packing.Encoder(path).batch(["Some words, and some more.", None])
