"""n-grams, hits and the filter against plain counts of strings."""

import random
from collections import Counter

import numpy as np

from tilewise.llm.language_id import Filter, Grams, slots


def plain(text, orders=(2, 3, 4)):
    """The n-grams of a text as strings: letters in lower case, all else one space, a space at both ends."""
    s = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    while "  " in s:
        s = s.replace("  ", " ")
    return [s[i : i + n] for n in orders for i in range(len(s) - n + 1)]


def texts(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçĐжλ漢字 "
    out = ["", "  ", "a", "A-b", "x\ny", "\n", "word  word\tword", "123 456", "É" * 50, "漢字かな"]
    return out + ["".join(rng.choice(letters + " .,\n7") for _ in range(rng.randrange(1, 300))) for _ in range(n)]


def test_grams_are_those_of_the_strings():
    some = texts(1)
    names: dict = {}
    got = [Counter() for _ in some]
    for h, owner in Grams().of(some):
        for x, i in zip(h.tolist(), owner.tolist(), strict=True):
            got[i][x] += 1
    for t, mine in zip(some, got, strict=True):
        want = Counter(plain(t))
        assert sorted(mine.values()) == sorted(want.values()), t
        assert sum(mine.values()) == len(plain(t))
    # one hash for each string and one string for each hash
    for t in some:
        for (h, _), n in zip(Grams().of([t]), (2, 3, 4)):
            for x, g in zip(h.tolist(), plain(t, (n,)), strict=True):
                assert names.setdefault(g, x) == x
    assert len(set(names.values())) == len(names)


def test_filter_against_exact_sets():
    rng, some, grams = random.Random(3), texts(2, 120), Grams()
    languages = [f"l{i:02}" for i in range(70)]  # two words of bits
    every = sorted({g for t in some for g in plain(t)})
    holds = {k: set(rng.sample(every, rng.randrange(len(every) // 10, len(every) // 2))) for k in languages}
    number = {}
    for t in some:
        for (h, _), n in zip(grams.of([t]), (2, 3, 4)):
            number |= dict(zip(plain(t, (n,)), h, strict=True))
    masks = np.zeros((2, 1 << 16), np.uint64)
    for i, k in enumerate(languages):
        for s in slots(np.array([number[g] for g in sorted(holds[k])], np.uint64), 16, 2):
            masks[i // 64][s] |= np.uint64(1) << np.uint64(i % 64)
    model = Filter(languages, masks, 16, 2, (2, 3, 4))
    hits, total = model.hits(some, grams)
    exact = np.array([[sum(g in holds[k] for g in plain(t)) for k in languages] for t in some], float)
    assert total.tolist() == [len(plain(t)) for t in some]
    # nothing is missed: before the correction there are at least as many hits as there are n-grams held
    assert (hits * (1 - model.rates) + total[:, None] * model.rates >= exact - 1e-6).all()
    # and after it the sum over many texts is near the exact one
    assert np.allclose(hits.sum(0), exact.sum(0), rtol=0.15, atol=0.03 * total.sum())
