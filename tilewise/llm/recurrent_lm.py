"""Scores of whole documents by a gated recurrent language model.

Counts of all training words are gathered over the cluster. A word's class follows from its last two bytes: the most
frequent endings have a class each, the rest share one, and the end of a document is a class of its own. The model is a
GRU over the previous tokens with a class-factored output: softmax over the classes, then softmax within the class over
its most frequent words and "another word", whose probability is shared by the smoothed counts of the class's other
words (one more stands for all words never seen). Each factor sums to one over its choices, and so does their product.

The weights of the GRU are trained in numpy by truncated backpropagation (windows of STEPS tokens, the state carried from
window to window, set back where a document begins) on all training documents, each from its first token to its last.
Documents are dealt to shards of about SHARD_TOKENS tokens by a hash of id and text, and a shard's documents, in the order
of a hash, to ROUNDS parts. In each round a task goes through one part of each shard, from the weights that all start
with, and the mean of the shards' weights, by their tokens, is what the next round starts with; PASSES times all tokens
are gone through in that way. Shards depend on the rows alone, and so do the weights. Scoring goes through a batch of documents together, in windows, carrying
each document's state from its first token to its last, however long it is.

A word's count is looked up in the vocabulary: up to VOCABULARY distinct words each worker reads it from the shared
folder; beyond that the distinct words of each text are joined with it, which gives the same sums.

Defined results: a null or empty text is the end token alone; a null id is not held out; rows that repeat get the same
scores; without training documents every token is unknown; an empty table gives an empty one; other columns are not read.
Words stand for themselves by 64-bit hashes.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table
from .language_id import held_out
from .warc import file_system

CLASSES, HEADS, HIDDEN, STEPS, SMOOTH = 96, 7, 24, 16, 0.1
PASSES, ROUNDS, SHARD_TOKENS, VOCABULARY = 1, 3, 1_000_000, 16_000_000
#: Most texts that go through a shard side by side, and the fewest windows that a part of a shard is to have if that permits.
STREAMS, WINDOWS = 512, 60
#: Texts that are scored side by side.
TEXTS = 4000
#: Step size of the first round; later ones take smaller steps.
RATE = 1e-2
END, REST = 0, 1  # classes
COUNTED = "word long, tail int, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(texts: list[str | None], at_once: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its last two bytes as a number, how many words each text has); words are kept as objects for at_once texts."""
    hashes, tails, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], np.zeros(len(texts), np.int64)
    for lo in range(0, len(texts), at_once):
        split = [(t or "").encode().lower().split() for t in texts[lo : lo + at_once]]
        flat = [w for ws in split for w in ws]
        n[lo : lo + at_once] = [len(ws) for ws in split]
        if not flat:
            continue
        # the last two bytes, out of the words joined by spaces
        joined = np.frombuffer(b" " + b" ".join(flat), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        tails.append(joined[ends].astype(np.uint16) * np.uint16(256) + joined[ends - 1])
        hashes.append(pd.util.hash_array(np.array(flat, dtype=object), categorize=False).view(np.int64))
    return np.concatenate(hashes), np.concatenate(tails), n


def count_words(rows: DataFrame) -> DataFrame:
    """COUNTED of rows (text), summed up in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                h, tail, _ = words_of(batch.column(0).slice(lo, 2000).to_pylist())
                word, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(tail[at].astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

    return rows.mapInArrow(run, COUNTED).groupBy("word", "tail").agg(F.sum("n").alias("n"))


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Model:
    """The weights, and what is known of classes and heads."""

    def __init__(self, tails: dict[int, int], heads: dict[int, tuple[int, int, int]], class_words: np.ndarray, class_kinds: np.ndarray, documents: int):
        """tails: class by ending; heads: word -> (class, item, count); words and distinct words of each class."""
        self.classes, self.items = len(class_words), HEADS + 1
        self.tail_class = np.full(1 << 16, REST, np.int64)
        for tail, c in tails.items():
            self.tail_class[tail] = c
        self.head_words = np.array(sorted(heads), np.int64)
        self.head_items = np.array([heads[w][1] for w in self.head_words.tolist()], np.int64)
        counts = np.zeros((self.classes, self.items))
        for c, item, n in heads.values():
            counts[c, item] = n
        kinds = class_kinds - (counts > 0).sum(1)
        counts[:, 0] = class_words - counts.sum(1)
        #: what the count of a word that is no head is divided by
        self.others = counts[:, 0] + SMOOTH * (kinds + 1)
        self.words, self.kinds, self.documents = class_words.sum(), class_kinds.sum(), documents
        rng, h, bos = np.random.default_rng(10), HIDDEN, self.classes * self.items
        self.bos = bos
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        mass = counts.sum(1)
        mass[END] = documents
        used = counts > 0
        used[:, 0] = True
        self.p = {
            "E": normal(bos + 1, h), "Wx": normal(h, 3 * h), "b": np.zeros(3 * h, np.float32), "U": normal(h, 3 * h),
            "Wc": np.zeros((h, self.classes), np.float32), "bc": np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32),
            "Wi": np.zeros((self.classes, self.items, h), np.float32), "bi": np.where(used, np.log(counts + 0.5), -1e9).astype(np.float32),
        }

    def ids(self, word: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, item) of each word."""
        cls, item = self.tail_class[tail], np.zeros(len(word), np.int64)
        if len(self.head_words):
            at = np.minimum(np.searchsorted(self.head_words, word), len(self.head_words) - 1)
            item = np.where(self.head_words[at] == word, self.head_items[at], 0)
        return cls, item

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state; x: the inputs' share of the gates."""
        n, u = HIDDEN, self.p["U"]
        gates = h @ u[:, : 2 * n]
        gates += x[:, : 2 * n]
        gates = sigmoid(gates)
        new = (gates[:, n:] * h) @ u[:, 2 * n :]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        return new + gates[:, :n] * (h - new)

    @staticmethod
    def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(an order by class, (class, from, to) of each class that occurs)."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(cls))
        return order, [(c, int(hi - k), int(hi)) for c, (hi, k) in enumerate(zip(ends, np.diff(ends, prepend=0), strict=True)) if k]

    def _small(self, weights: str, bias: str) -> bool:
        """Whether no sum of exponentials can leave the range of a float: states lie between -1 and 1, so the weights bound them."""
        spread = np.abs(self.p[weights]).sum(0 if weights == "Wc" else 2)
        return (spread + self.p[bias]).max() < 60 and (self.p[bias].max(-1) - spread.max()).min() > -60

    def output(self, h: np.ndarray, cls: np.ndarray, item: np.ndarray) -> np.ndarray:
        """log P(class) + log P(item | class) for each state."""
        logits = h @ self.p["Wc"]
        logits += self.p["bc"]
        if not self._small("Wc", "bc"):
            logits -= logits.max(1, keepdims=True)
        out = logits[np.arange(len(h)), cls]
        out -= np.log(np.exp(logits, out=logits).sum(1))
        order, parts = self._by_class(cls)
        states, within = h[order], np.empty((len(h), self.items), h.dtype)
        for c, lo, hi in parts:
            np.matmul(states[lo:hi], self.p["Wi"][c].T, out=within[lo:hi])
            within[lo:hi] += self.p["bi"][c]
        if not self._small("Wi", "bi"):
            within -= within.max(1, keepdims=True)
        inside = within[np.arange(len(h)), item[order]]
        inside -= np.log(np.exp(within, out=within).sum(1))
        out[order] += inside
        return out

    def codes(self, cls: np.ndarray, item: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The tokens of documents in a row, each document's end among them as 0; n: words of each document."""
        out = np.zeros(len(cls) + len(n), np.uint16)
        out[np.arange(len(cls)) + np.repeat(np.arange(len(n)), n)] = cls * self.items + item
        return out

    def train(self, codes: np.ndarray, rate: float = RATE) -> float:
        """Truncated backpropagation over all tokens of codes(), once; their mean loss."""
        codes = codes.astype(np.int64)
        cls, item = np.divmod(codes, self.items)
        first = np.append(True, codes[:-1] == END * self.items)[: len(codes)]
        prev = np.where(first, self.bos, np.roll(codes, 1))
        streams = max(1, min(STREAMS, len(codes) // (WINDOWS * STEPS)))
        length, longer = divmod(len(codes), streams)  # the first streams have a token more
        starts = np.arange(streams) * length + np.minimum(np.arange(streams), longer)
        m, v, t, loss = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0, 0.0
        h = np.zeros((streams, HIDDEN), np.float32)
        windows = [(lo, min(lo + STEPS, length), streams) for lo in range(0, length, STEPS)] + [(length, length + 1, longer)] * (longer > 0)
        for lo, hi, many in windows:
            at = starts[:many] + np.arange(lo, hi)[:, None]
            part, grads, h = self._backward(cls[at], item[at], prev[at], first[at], h[:many])
            loss, t = loss + part, t + 1
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            step = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            for k, g in grads.items():
                g *= min(1.0, 1.0 / (norm + 1e-8))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= step * m[k] / (np.sqrt(v[k]) + 1e-6)
        return loss / max(1, len(codes))

    def _backward(self, cls, item, prev, first, h):
        """(loss, gradients, last state) of one window, steps x streams."""
        p, n, steps, many = self.p, HIDDEN, len(cls), cls.shape[1]
        kept, (u, un) = [], (np.ascontiguousarray(p["U"][:, : 2 * n]), np.ascontiguousarray(p["U"][:, 2 * n :]))
        inputs = (p["E"] @ p["Wx"] + p["b"])[prev]
        out = np.empty((steps, many, n), inputs.dtype)
        for t in range(steps):
            h = h * ~first[t][:, None]
            gates = h @ u
            gates += inputs[t, :, : 2 * n]
            gates = sigmoid(gates)
            z, r = gates[:, :n], gates[:, n:]
            rh = r * h
            new = np.tanh(inputs[t, :, 2 * n :] + rh @ un)
            kept.append((h, z, r, rh, new))
            h = new + z * (h - new)
            out[t] = h
        last, out = h, out.reshape(-1, n)
        c, i, rows = cls.ravel(), item.ravel(), np.arange(steps * many)
        g = {k: np.zeros_like(w) for k, w in p.items()}
        scale = out.dtype.type(1 / many)
        soft = out @ p["Wc"]
        soft += p["bc"]
        if not self._small("Wc", "bc"):
            soft -= soft.max(1, keepdims=True)
        np.exp(soft, out=soft)
        soft /= soft.sum(1, keepdims=True)
        loss = -float(np.log(soft[rows, c] + 1e-12).sum())
        soft[rows, c] -= 1
        soft *= scale
        g["Wc"], g["bc"] = out.T @ soft, soft.sum(0)
        down = soft @ p["Wc"].T
        # within the classes: the tokens of a class lie together
        order, parts = self._by_class(c)
        states, inner, below = out[order], np.empty((len(rows), self.items), out.dtype), np.empty_like(out)
        for k, lo, hi in parts:
            np.matmul(states[lo:hi], p["Wi"][k].T, out=inner[lo:hi])
            inner[lo:hi] += p["bi"][k]
        if not self._small("Wi", "bi"):
            inner -= inner.max(1, keepdims=True)
        np.exp(inner, out=inner)
        inner /= inner.sum(1, keepdims=True)
        loss -= float(np.log(inner[rows, i[order]] + 1e-12).sum())
        inner[rows, i[order]] -= 1
        inner *= scale
        for k, lo, hi in parts:
            d = inner[lo:hi]
            np.matmul(d.T, states[lo:hi], out=g["Wi"][k])
            g["bi"][k] = d.sum(0)
            np.matmul(d, p["Wi"][k], out=below[lo:hi])
        down[order] += below
        down = down.reshape(steps, many, n)
        gated = np.empty((steps, many, 3 * n), down.dtype)
        back = np.zeros((many, n), down.dtype)
        for t in reversed(range(steps)):
            h, z, r, rh, new = kept[t]
            d, da = down[t] + back, gated[t]
            da[:, :n] = d * (h - new) * z * (1 - z)
            da[:, 2 * n :] = d * (1 - z) * (1 - new * new)
            drh = da[:, 2 * n :] @ un.T
            da[:, n : 2 * n] = drh * rh * (1 - r)
            back = d * z + drh * r + da[:, : 2 * n] @ u.T
            back *= ~first[t][:, None]
        gated, was = gated.reshape(-1, 3 * n), np.stack([x[0] for x in kept]).reshape(-1, n)
        g["U"][:, : 2 * n] = was.T @ gated[:, : 2 * n]
        g["U"][:, 2 * n :] = np.stack([x[3] for x in kept]).reshape(-1, n).T @ gated[:, 2 * n :]
        # what each input has got, over all places where it stands
        order = np.argsort(prev.ravel().astype(np.uint16), kind="stable")
        seen = prev.ravel()[order]
        lead = np.flatnonzero(np.append(True, seen[1:] != seen[:-1])[: len(seen)])
        table = np.zeros((len(p["E"]), 3 * n), gated.dtype)
        table[seen[lead]] = np.add.reduceat(gated[order], lead, axis=0)
        g["E"], g["Wx"], g["b"] = table @ p["Wx"].T, p["E"].T @ table, table.sum(0)
        return loss, g, last

    def likelihoods(self, cls: np.ndarray, item: np.ndarray, n: np.ndarray, steps: int = 64) -> np.ndarray:
        """The sum of log P over each document's tokens and its end; n: words of each document, cls and item of all in a row."""
        many, total = len(n), n + 1
        order = np.argsort(-n, kind="stable")
        rank = np.empty(many, np.int64)
        rank[order] = np.arange(many)
        # the tokens by their place in the document, and in each place those of longer documents first
        on = np.cumsum(np.bincount(total, minlength=int(total.max(initial=0)) + 1)[::-1])[::-1][1:]  # documents that have the place
        first = np.concatenate([[0], np.cumsum(on)])
        ends = np.cumsum(total)
        place = np.arange(ends[-1] if many else 0) - np.repeat(ends - total, total)
        codes = np.empty(len(place), np.int32)
        codes[first[place] + np.repeat(rank, total)] = self.codes(cls, item, n)
        del place
        gates = self.p["E"] @ self.p["Wx"] + self.p["b"]
        out, h, before = np.zeros(many), np.zeros((many, HIDDEN), np.float32), np.full(many, self.bos)
        lo = 0
        while lo < len(on):
            hi = min(len(on), lo + steps)
            states = np.empty((first[hi] - first[lo], HIDDEN), gates.dtype)
            for t in range(lo, hi):
                k = on[t]
                h = self.step(gates[before[:k]], h[:k])
                states[first[t] - first[lo] : first[t + 1] - first[lo]] = h
                before = codes[first[t] : first[t + 1]]
            c, i = np.divmod(codes[first[lo] : first[hi]], self.items)
            got = np.concatenate([self.output(states[a : a + 16384], c[a : a + 16384], i[a : a + 16384]) for a in range(0, len(states), 16384)])
            for t in range(lo, hi):
                out[: on[t]] += got[first[t] - first[lo] : first[t + 1] - first[lo]]
            lo = hi
        return out[rank]


def _shards(train: DataFrame, model: Model, shards: int) -> DataFrame:
    """shard, codes: the tokens of all documents, a row for each shard, documents in the order of a hash."""
    names = ["shard", "at", "codes"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1500):
                part = batch.slice(lo, 1500)
                word, tail, n = words_of(part.column(2).to_pylist())
                codes, ends = model.codes(*model.ids(word, tail), n), np.cumsum(n + 1)
                texts = [codes[a:b].tobytes() for a, b in zip(ends - n - 1, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], names=names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept = None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([b"".join(kept)], pa.binary())], names=["shard", "codes"])
        for batch in batches:
            for s, codes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != shard and kept:
                    yield row()
                    kept = []
                shard = s
                kept.append(codes)
        if kept:
            yield row()

    at = F.xxhash64(F.lit(10), "id", "text")
    rows = train.select(F.pmod(at, F.lit(shards)).alias("shard"), F.xxhash64(F.lit(11), "id", "text").alias("at"), "text")
    rows = rows.mapInArrow(coded, "shard long, at long, codes binary").repartition(shards, "shard").sortWithinPartitions(*names)
    return stored(rows.mapInArrow(joined, "shard long, codes binary"), "shards")


def _part(codes: np.ndarray, part: int) -> np.ndarray:
    """One of the ROUNDS parts of a shard, of whole documents: each goes where its middle lies."""
    ends = np.flatnonzero(codes == END) + 1
    middle = (np.concatenate([[0], ends[:-1]]) + ends) / 2
    cut = lambda k: int(np.searchsorted(middle, k * len(codes) / ROUNDS))
    lo, hi = cut(part), cut(part + 1) if part + 1 < ROUNDS else len(ends)
    return codes[ends[lo - 1] if lo else 0 : ends[hi - 1] if hi else 0]


def _train(train: DataFrame, model: Model, shard_tokens: int) -> None:
    """Trains model on all documents (id, text): rounds over parts of all shards, whose weights are averaged after each."""
    shards = max(1, round((int(model.words) + model.documents) / shard_tokens))
    rows, groups = _shards(train, model, shards), math.ceil(math.sqrt(shards))
    shapes = {k: w.shape for k, w in model.p.items()}

    def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([math.prod(x) for x in shapes.values()])[:-1]
        return {k: x.reshape(shapes[k]).astype(np.float32) for k, x in zip(shapes, np.split(flat, cuts), strict=True)}

    for turn in range(PASSES * ROUNDS):
        sent = train.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    m = copy.copy(sent.value)
                    m.p = {k: w.copy() for k, w in m.p.items()}
                    codes = _part(np.frombuffer(batch.column(1)[i].as_py(), np.uint16), turn % ROUNDS)
                    if not len(codes):
                        continue
                    m.train(codes, RATE * (1 - 0.6 * turn / (PASSES * ROUNDS)))
                    total = np.concatenate([w.ravel() for w in m.p.values()]).astype(np.float64) * len(codes)
                    shard = batch.column(0)[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([shard % groups]), pa.array([shard]), pa.array([len(codes)]), pa.array([total.tobytes()], pa.binary())], names=["part", "shard", "tokens", "total"])

        def summed(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in part.sort_values("shard")["total"])
            return pd.DataFrame({"part": part["part"].iloc[:1], "tokens": [part["tokens"].sum()], "total": [total.tobytes()]})

        found = rows.mapInArrow(run, "part long, shard long, tokens long, total binary").groupBy("part").applyInPandas(summed, "part long, tokens long, total binary").collect()
        sent.destroy()
        if not found:  # few documents, all of them in other parts
            continue
        found.sort(key=lambda r: r["part"])
        model.p = unpacked(sum(np.frombuffer(r["total"]) for r in found) / sum(r["tokens"] for r in found))
    discard(rows)


def fit(train: DataFrame, shard_tokens: int = SHARD_TOKENS) -> tuple[Model, DataFrame]:
    """(model, vocabulary: COUNTED of all training words) of rows (id, text)."""
    vocabulary = stored(count_words(train.select("text")), "vocabulary")
    by_tail = vocabulary.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    endings = {r["tail"]: (r["n"], r["kinds"]) for r in by_tail.collect()}  # at most 65,536
    top = sorted(endings, key=lambda t: (-endings[t][0], t))[: CLASSES - 2]
    tails = {t: i + 2 for i, t in enumerate(top)}
    words, kinds = np.zeros(len(tails) + 2), np.zeros(len(tails) + 2)
    for t, (n, k) in endings.items():
        words[tails.get(t, REST)] += n
        kinds[tails.get(t, REST)] += k
    heads: dict[int, tuple[int, int, int]] = {}
    per: dict[int, int] = {}
    # at most 200,000 words can have so large a share of the text; the heads are among them
    often = vocabulary.where(F.col("n") >= max(2.0, words.sum() / 200_000)).select("tail", "n", "word").collect()
    for r in sorted(often, key=lambda r: (-r["n"], r["word"])):
        c = tails.get(r["tail"], REST)
        if per.get(c, 0) < HEADS:
            per[c] = per.get(c, 0) + 1
            heads[r["word"]] = (c, per[c], r["n"])
    documents = train.count()
    model = Model(tails, heads, words, kinds, documents)
    if documents:
        _train(train, model, shard_tokens)
    return model, vocabulary


_loaded: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _vocabulary(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(words in order, their counts), read once by each worker, a file at a time."""
    if folder not in _loaded:
        import pyarrow.dataset as ds

        fs, path = file_system(folder)
        parts = ds.dataset(path, filesystem=fs, format="parquet")
        rows, at = parts.count_rows(), 0
        _loaded.clear()
        word, n = np.empty(rows, np.int64), np.empty(rows, np.int64)
        for batch in parts.to_batches(columns=["word", "n"], batch_size=200_000, use_threads=False, fragment_readahead=0, batch_readahead=0):
            k = batch.num_rows
            word[at : at + k], n[at : at + k] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at += k
        order = np.argsort(word).astype(np.int32)
        _loaded[folder] = word[order], n[order]
        pa.default_memory_pool().release_unused()
    return _loaded[folder]


def _sums(word: np.ndarray, item: np.ndarray, cls: np.ndarray, count: np.ndarray, times: np.ndarray, model: Model, total: float):
    """(known, base, others) of words with the given counts."""
    base = times * np.log10((count + SMOOTH) / total)
    others = np.where(item == 0, times * np.log10((count + SMOOTH) / model.others[cls]), 0.0)
    return times * (count > 0), base, others


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """_row, n_tokens, n_known, train_tokens, base_score, score; docs: _row, text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    n_train = int(model.words) + model.documents
    total = n_train + SMOOTH * (model.kinds + (model.documents > 0) + 1)
    end = float(np.log10((model.documents + SMOOTH) / total)), int(model.documents > 0)
    local = vocabulary.count() <= most
    folder = vocabulary.inputFiles()[0].rsplit("/", 1)[0] if local and vocabulary.inputFiles() else None
    try:
        if folder:
            file_system(folder)
    except (ImportError, OSError, pa.ArrowException):  # a store that only Spark reads
        local, folder = False, None
    if not local:
        docs = docs.withColumn("text_key", F.xxhash64("text"))
    schema = f"_row {docs.schema['_row'].dataType.simpleString()}, n_tokens long, part double, " + ("known long, base double, others double" if local else "text_key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                word, tail, n = words_of(part.column(1).to_pylist())
                cls, item = m.ids(word, tail)
                columns = [part.column(0), pa.array(n + 1), pa.array(m.likelihoods(cls, item, n) / np.log(10))]
                if local:
                    known, counts = _vocabulary(folder) if folder else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    distinct_words, place = np.unique(word, return_inverse=True)
                    at = np.minimum(np.searchsorted(known, distinct_words), max(0, len(known) - 1))
                    count = (np.where(known[at] == distinct_words, counts[at], 0) if len(known) else np.zeros(len(distinct_words), np.int64))[place]
                    owner = np.repeat(np.arange(len(n)), n)
                    columns += [pa.array(np.bincount(owner, x, len(n)).astype(k)) for x, k in zip(_sums(word, item, cls, count, np.ones(len(word)), m, total), (np.int64, float, float), strict=True)]
                else:
                    columns.append(part.column(2))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in names])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, tail, _ = words_of([text])
                word, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), key)), pa.array(word), pa.array(tail[at].astype(np.int32)), pa.array(n)], names=["text_key", "word", "tail", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            key, word, tail, n, count = (c.to_numpy() for c in batch.columns)
            cls, item = m.ids(word, tail)
            known, base, others = _sums(word, item, cls, count, n, m, total)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(known.astype(np.int64)), pa.array(base), pa.array(others)], names=["text_key", "known", "base", "others"])

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema)
    rows = docs.mapInArrow(run, schema)
    if not local:
        texts = docs.groupBy("text_key").agg(F.first("text").alias("text"))
        pairs = texts.mapInArrow(distinct, "text_key long, word long, tail int, n long").join(vocabulary.select("word", F.col("n").alias("count")), "word", "left")
        sums = pairs.select("text_key", "word", "tail", "n", F.coalesce("count", F.lit(0)).alias("count")).mapInArrow(summed, "text_key long, known long, base double, others double")
        rows = rows.join(sums.groupBy("text_key").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("others").alias("others")), "text_key", "left").na.fill(0, ["known", "base", "others"])
    return rows.select("_row", "n_tokens", (F.col("known") + end[1]).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + end[0]).alias("base_score"), (F.col("part") + F.col("others")).alias("score"))


def score_documents(docs: DataFrame, folds: int = 10, text: str = "text", id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS, most: int = VOCABULARY) -> DataFrame:
    """SCORES of all documents, learnt from those that aren't held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = held_out(F.col("id"), folds)
    model, vocabulary = fit(rows.where(~out), shard_tokens)
    scored = score(rows.select(F.struct(F.col("id").alias("doc_id"), out.alias("held_out")).alias("_row"), "text"), model, vocabulary, most)
    return scored.select("_row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
