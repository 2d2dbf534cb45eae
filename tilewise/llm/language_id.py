"""Language identification by language-bitmask filters of character n-grams.

Training: n-grams of 2 to 4 characters (letters in lower case; all else is one space) are counted per language, in each
partition first and then over all. A language holds an n-gram if it has it MIN_COUNT times or more and at a rate of at
least SHARE of the highest rate among the languages. The filter is a Bloom filter whose slots are not bits but
bitmasks, one bit for each language: AND over an n-gram's slots gives, at once, all languages that may hold it.

Prediction: over the whole text, each language's hits are counted (a popcount of its bit over all n-grams). A language
whose bit is set in a share f of the slots answers to an unknown n-gram with probability f^k; hits are corrected for
that, and the language with the most decides. The score is its part of all corrected hits.

The fit takes at most TRAIN_DOCS labelled documents of each language (fewer rows: all), chosen by a hash of the id; this
bound is a parameter. The filter has SLOTS slots at any input size. Everything else covers whole texts and all rows.

Defined results: text that is null or has no letter is `und` with score 0; a text with letters none of whose n-grams any
language holds gets the first language, with score 0; without any labelled document all are `und`; ties go to the language
that is first by code point; rows that repeat get the same answer; an empty table gives an empty one; other columns are
carried by `keep_known` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_uniform, stored, table

ORDERS, SLOTS_LOG2, HASHES, TRAIN_DOCS, MIN_COUNT, SHARE = (2, 3, 4), 20, 2, 4000, 3, 0.5
_U = np.uint64
_MULT = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def _letters() -> np.ndarray:
    """For each code point below 0x3000 the lower-case letter, or a space; later code points stand for themselves."""
    table_ = np.full(0x3000, 32, np.uint32)
    for c in range(0x3000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table_[c] = ord(low) if len(low) == 1 else c
    return table_


class Grams:
    """n-gram hashes of many texts at once."""

    def __init__(self, orders: tuple[int, ...] = ORDERS):
        self.orders, self.letters = orders, _letters()

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: (hashes, the text that each belongs to)."""
        # a text starts and ends with a space, and n-grams don't reach over the bounds
        joined = " " + " \n ".join(texts) + " "
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bound = raw == 10
        ends = np.flatnonzero(bound)
        if len(ends) != len(texts) - 1:  # a line feed in a text is white space like any
            joined = " " + " \n ".join(t.replace("\n", " ") for t in texts) + " "
            raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            bound = raw == 10
            ends = np.flatnonzero(bound)
        chars = np.where(raw < 0x3000, self.letters[np.minimum(raw, 0x2FFF)], raw)
        # runs of spaces count once
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | bound[1:]
        chars, owner = chars[keep], np.cumsum(bound)[keep]
        wide = chars.astype(_U)
        acc = np.zeros(len(wide), _U)
        for i in range(max(self.orders)):
            n = len(wide) - i
            if n <= 0:
                break
            acc = (acc[:n] * _U(0x100000001B3) + wide[i:] + _U(1)) * _MULT[0]
            acc ^= acc >> _U(29)
            if i + 1 in self.orders:
                inside = owner[:n] == owner[i:]
                if i == 1:  # two spaces say nothing
                    inside &= (chars[:n] != 32) | (chars[i:] != 32)
                yield (acc[inside] + _U(i)) * _MULT[1], owner[:n][inside]


def slots(h: np.ndarray, log2: int, hashes: int) -> list[np.ndarray]:
    return [((h ^ (h >> _U(31))) * _MULT[1 + k]) >> _U(64 - log2) for k in range(hashes)]


class Filter:
    """masks: words x slots bitmasks; rates: the false-positive rate of each language."""

    def __init__(self, languages: list[str], masks: np.ndarray, log2: int, hashes: int, orders: tuple[int, ...]):
        self.languages, self.masks, self.log2, self.hashes, self.orders = languages, masks, log2, hashes, orders
        fill = [np.count_nonzero(masks[i // 64] & (_U(1) << _U(i % 64))) / masks.shape[1] for i in range(len(languages))]
        self.rates = np.array(fill) ** hashes

    def hits(self, texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """(corrected hits of each language in each text, n-grams of each text)."""
        count, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, owner in grams.of(texts):
            at = slots(h, self.log2, self.hashes)
            total += np.bincount(owner, minlength=len(texts))
            for w in range(len(self.masks)):
                got = self.masks[w][at[0]]
                for s in at[1:]:
                    got &= self.masks[w][s]
                for i in range(64 * w, min(len(self.languages), 64 * w + 64)):
                    count[:, i] += np.bincount(owner[(got >> _U(i % 64)) & _U(1) == 1], minlength=len(texts))
        return np.maximum(0, (count - total[:, None] * self.rates) / (1 - np.minimum(self.rates, 0.999))), total


def _chunks(texts: list[str | None], size: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of up to size characters together; one longer text is alone."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t or "") > size:
            yield lo, [x or "" for x in texts[lo:i]]
            lo, n = i, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, [x or "" for x in texts[lo:]]


def count_grams(rows: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """gram, lang, n of rows (text, lang): counted in each task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                by: dict[str, list[str]] = {}
                for t, lang in zip(*(c.to_pylist() for c in batch.slice(lo, 2000).columns), strict=True):
                    by.setdefault(lang, []).append(t or "")
                for lang, texts in by.items():
                    for _, part in _chunks(texts, 4_000_000):
                        for h, _ in grams.of(part):
                            g, n = np.unique(h, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array([lang] * len(g)), pa.array(n)], names=["gram", "lang", "n"])

    return rows.mapInArrow(run, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, orders: tuple[int, ...] = ORDERS, log2: int = SLOTS_LOG2, hashes: int = HASHES, min_count: int = MIN_COUNT, share: float = SHARE) -> Filter:
    """The filter of the languages in labelled (rows without a language are left out)."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(per)
    if not languages:
        return Filter([], np.zeros((1, 1 << log2), _U), log2, hashes, orders)
    part = F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(1.0, train_docs / n))])
    sample = known.where(key_uniform("id", seed=8) < part[F.col("lang")]).select("text", "lang")
    counts = stored(count_grams(sample, orders), "gram-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])[F.col("lang")]
    top = counts.withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("all"))  # as many as there are languages
    held = top.select("gram", F.explode("all").alias("x"), "top").where((F.col("x.n") >= min_count) & (F.col("x.rate") >= share * F.col("top"))).select("gram", F.col("x.lang").alias("lang"))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, i = batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy()
            for s in slots(h, log2, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array((i // 64).astype(np.int32)), pa.array((_U(1) << (i % 64).astype(_U)).view(np.int64))], names=["slot", "word", "mask"])

    placed = held.select("gram", number[F.col("lang")].cast("long").alias("i")).mapInArrow(place, "slot long, word int, mask long")
    found = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most slots x words rows, at any input size
    masks = np.zeros((-(-len(languages) // 64), 1 << log2), _U)
    masks[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().view(_U)
    return Filter(languages, masks, log2, hashes, orders)


def predict(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and support (corrected hits of that language per n-gram); docs has none of these columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        grams = Grams(m.orders)
        for batch in batches:
            texts, names, scores, support = batch.column(0).to_pylist(), [], [], []
            for _, part in _chunks(texts):
                hits, total = m.hits(part, grams) if m.languages else (np.zeros((len(part), 1)), np.zeros(len(part)))
                best, every = hits.argmax(1), hits.sum(1)
                for j, t in enumerate(part):
                    some = bool(m.languages) and any(map(str.isalpha, t))
                    names.append(m.languages[best[j]] if some else "und")
                    scores.append(float(hits[j, best[j]] / every[j]) if some and every[j] > 0 else 0.0)
                    support.append(float(min(1.0, hits[j, best[j]] / total[j])) if some and total[j] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(support, pa.float64())], names=["_row", "lang_pred", "score", "support"])

    rows = docs.select(F.col(text).cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(True).alias("_")).alias("_row"))
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, lang_pred string, score double, support double"
    return rows.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c != text], "lang_pred", "score", "support")


def held_out(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def keep_known(docs: DataFrame, model: Filter, min_support: float = 0.02, text: str = "text") -> DataFrame:
    """The rows of docs whose language is known: not `und`, and with a language that holds min_support of the n-grams."""
    names = docs.columns
    rows = docs.select(F.col(f"`{text}`").alias("_body"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"))
    return predict(rows, model, "_body").where((F.col("lang_pred") != "und") & (F.col("support") >= min_support)).select("_all.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")
