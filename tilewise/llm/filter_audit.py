"""How filters interact: for every order in which five filters can be applied, what each removes, and what it costs.

A document fails some of the five filters: a mask of five bits. A table of 32 masks by 120 orders, worked out once, has the
step at which each order removes such a document (its first failure). Tasks look their documents up in it and count
(part, order, step, label) with one bincount a batch; those partial arrays are summed by a shuffle that gets a row for
each task, part and order. All figures follow from the removals: a filter's failures are what it removes when it goes
first, those that only it fails are what it removes when it goes last, the sum over all orders is its Shapley value times
120.

Copies: a text's smallest doc_id is found by a hash of 128 bits with sums within the tasks first; a document then
is the first of its text if (hash, doc_id) is met there. Neither join has a key that a group of copies shares.

Defined results: null texts are empty; null and empty parts are one; a null doc_id is no later copy and has no label, but
the copies of its text don't look at it either; documents that repeat id and text are both first; of several labels of a
document any counts; labels without a document count nowhere; an empty table gives an empty one; very long texts are gone
through in pieces that end at white space; columns other than id, text and part are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS, KINDS = len(LETTERS) + 1, 4
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
#: Bytes of a text whose words are held at once; parts whose counts a task holds; documents that are looked up at once.
PIECE_BYTES, HELD_PARTS, ROWS = 1 << 20, 400, 2000
UPPER, CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))
FACTS = "doc_id long, part string, mask int, hash binary"


def first_failures() -> np.ndarray:
    """masks x orders: the step (from 0) whose filter is the first that fails, 5 where none does."""
    out = np.full((1 << len(LETTERS), len(ORDERS)), len(LETTERS), np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(len(LETTERS))):
            fails = np.arange(len(out)) >> LETTERS.index(order[step]) & 1 == 1
            out[fails, o] = step
    return out


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """text in pieces of about so many bytes that end before white space (or where there is none for long, later)."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(text) - at > size:
        found = space.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def mask_of(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    n, distinct = 0, set()
    for piece in pieces(text):
        words = piece.split()  # of bytes: at space, \t, \n, \v, \f and \r
        n += len(words)
        distinct.update(words)
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUED))
    marks = len(text) > len(text.translate(None, MARKS))
    return (n < MIN_WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * points) << 2 | marks << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, hashes = [], []
        for value in batch.column(2):
            text = value.as_py() or b""
            masks.append(mask_of(text))
            hashes.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "part", "mask", "hash"])


def removals(rows: DataFrame) -> DataFrame:
    """part, ord and the documents by step (d0 to d5), of those the good (g) and the toxic (t); rows: part, mask, kind (1: good, 2: toxic)."""
    names = [f"{x}{s}" for x in "dgt" for s in range(STEPS)]
    schema = "part string, ord int, " + ", ".join(f"{n} long" for n in names)
    table_of = first_failures()

    def rows_of(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = np.stack(list(held.values())) if held else np.zeros((0, len(ORDERS), STEPS, KINDS), np.int64)
        sums = np.concatenate([n.sum(3), n[..., 1] + n[..., 3], n[..., 2] + n[..., 3]], axis=2).reshape(-1, len(names))
        parts = [p for p in held for _ in ORDERS]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.tile(np.arange(len(ORDERS)), len(held)), pa.int32()), *[pa.array(np.ascontiguousarray(c), pa.int64()) for c in sums.T]], names=["part", "ord", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                coded = b.column(0).dictionary_encode()
                codes, parts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                step = table_of[b.column(1).to_numpy()]
                at = ((codes[:, None].astype(np.int64) * len(ORDERS) + np.arange(len(ORDERS))) * STEPS + step) * KINDS + b.column(2).to_numpy()[:, None]
                n = np.bincount(at.ravel(), minlength=len(parts) * len(ORDERS) * STEPS * KINDS).reshape(len(parts), len(ORDERS), STEPS, KINDS)
                for p, x in zip(parts, n, strict=True):
                    held[p] = held[p] + x if p in held else x.copy()
                if len(held) > HELD_PARTS:
                    yield rows_of(held)
                    held = {}
        if held:
            yield rows_of(held)

    return rows.select("part", "mask", "kind").mapInArrow(count, schema).groupBy("part", "ord").agg(*[F.sum(n).alias(n) for n in names])


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", id_col: str = "doc_id") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; labels: doc_id, quality, toxic."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("text"))
    facts = stored(rows.mapInArrow(_facts, FACTS), "audit")
    named, nameless = facts.where("doc_id is not null"), facts.where("doc_id is null")
    firsts = named.groupBy(F.col("hash").alias("_hash")).agg(F.min("doc_id").alias("_first"))
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("bad"))
    met = named.join(firsts, (F.col("hash") == F.col("_hash")) & (F.col("doc_id") == F.col("_first")), "left").join(label, F.col("doc_id") == F.col("_id"), "left")
    later = F.when(F.col("_first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    kind = F.coalesce(F.col("good") + F.col("bad"), F.lit(0))
    masks = met.select("part", F.col("mask").bitwiseOR(later).alias("mask"), kind.alias("kind")).unionByName(nameless.select("part", "mask", F.lit(0).alias("kind")))
    sums = removals(masks)
    steps = [
        F.struct(F.lit(s + 1).alias("step"), sum((F.col(f"d{k}") for k in range(s + 2, STEPS)), F.col(f"d{s + 1}")).alias("kept"), F.col(f"d{s}").alias("removed"), F.col(f"g{s}").alias("good_lost"), F.col(f"t{s}").alias("toxic_lost"))
        for s in range(len(LETTERS))
    ]
    out = sums.select("part", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("ord") + 1).alias("filter_order"), F.explode(F.array(*steps)).alias("s")).select("part", "filter_order", "s.*")
    # 120 rows a part and filter
    same = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    out = out.withColumns({
        "unique_fails": F.max(F.when(F.col("step") == len(LETTERS), F.col("removed"))).over(same),
        "redundant": F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same) - F.col("removed"), "shapley": F.sum("removed").over(same),
    })
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > low THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE toxic) AS nt FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || e.k || h.k AS filter_order FROM x a, x b, x c, x e, x h WHERE len(list_distinct([a.k, b.k, c.k, e.k, h.k])) = 5),
s AS (SELECT filter_order, i::INT AS step, filter_order[i] AS own, left(filter_order, i - 1) AS earlier FROM o, range(1, 6) r(i)),
c AS (SELECT part, filter_order, step, own, n, ng, nt, contains(fails, own) AS hit, translate(earlier, fails, '') <> earlier AS gone, fails = own AS alone FROM g, s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT hit AND NOT gone) AS kept, sum(n) FILTER (WHERE hit AND NOT gone) AS removed, sum(n) FILTER (WHERE hit AND gone) AS redundant,
  sum(n) FILTER (WHERE alone) AS unique_fails, sum(ng) FILTER (WHERE hit AND NOT gone) AS good_lost, sum(nt) FILTER (WHERE hit AND NOT gone) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
