"""Removal of byte strings that occur twice, by suffix arrays built with two-stage sorting.

Every string of LENGTH bytes is dealt by its anchor, the smallest hash among its GRAM-byte substrings. Strings that are
equal have equal anchors, and neighbouring strings mostly share one, so a text falls into runs of starts with one
anchor. A run travels as (anchor, hash of its bytes, place); its bytes travel only where the anchor also has a run of
other bytes, or recurs within the run, and then once for all runs of the same bytes (the copies are counted beforehand).

Those bytes are put together in shards by anchor, and each shard gets a suffix array. Stage one sorts the suffixes that
are smaller than their successors directly, on LENGTH bytes; stage two induces all others by a scan over the buckets
of first bytes, a whole bucket at a time. The common prefixes of neighbours then tell which starts have an equal string
elsewhere. Every byte under such a string goes; starts of different runs are brought together again by text.

An anchor whose runs of different bytes would fill more than a shard (a large group of near copies) is not sorted in one
task: its strings are dealt again, by the smallest hash among longer grams, and fall into runs with finer anchors, for which
all of the above holds. Only strings that stay together under grams of three quarters of their length, in more bytes than
a shard holds, are hashed one by one and counted over the cluster, which sums up equal ones before the shuffle.

Defined results: a null text is empty; texts of fewer than LENGTH bytes lose nothing; equal texts of LENGTH bytes or more
lose everything; rows that repeat count as copies; a null id is carried; an empty table gives an empty one; columns other
than id and text are not read. Hashes of 64 bits stand for runs and texts; two different ones among k collide with
probability k^2 / 2^65, within one anchor for runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, stored, table

LENGTH, GRAM, SHARD_BYTES, HOT_BYTES = 400, 100, 4 << 20, 16 << 20
#: Times GRAM: the grams by which hot anchors are dealt again; strings that are hashed in one batch.
FINER, STRINGS = (2, 3), 50_000
#: Bytes whose rank stands for them while suffixes are sorted.
WORD_BYTES = 80
_U = np.uint64
_B = 0x9E3779B97F4A7C15


class Anchors:
    """The runs of a text: (anchor, start, number of starts, hash of the bytes, whether the anchor recurs)."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.powers, self.inverse = length, gram, np.ones(1, _U), np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 2 * n
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[_U(1)], np.full(n, _B, _U)]), dtype=_U)
                self.inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n, pow(_B, -1, 1 << 64), _U)]), dtype=_U)

    def of(self, data: bytes) -> list[tuple[int, int, int, int, bool]]:
        n, w, length = len(data), self.gram, self.length
        if n < length:
            return []
        self._grow(n + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((np.frombuffer(data, np.uint8).astype(_U) + _U(1)) * self.powers[:n], dtype=_U)])
        g = (sums[w:] - sums[:-w]) * self.inverse[: n - w + 1]
        g = (g ^ (g >> _U(32))) * _U(0xD6E8FEB86659FD93)
        g = (g ^ (g >> _U(32))) * _U(0xD6E8FEB86659FD93)
        g ^= g >> _U(32)
        # the smallest of each window: of what is left of its block's end, and right of it
        wide = length - w + 1
        rows = np.full(-(-len(g) // wide) * wide, np.iinfo(_U).max, _U)
        rows[: len(g)] = g
        rows = rows.reshape(-1, wide)
        left = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        right = np.minimum.accumulate(rows, 1).ravel()
        low = np.minimum(left[: n - length + 1], right[wide - 1 : n - length + wide])
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(low)]]))
        out = []
        for s, c, v in zip(starts.tolist(), counts.tolist(), low[starts], strict=True):
            again = np.count_nonzero(g[s : s + c + wide - 1] == v) > 1
            out.append((int(v) - 2**63, s, c, xxhash.xxh3_64_intdigest(data[s : s + c + length - 1]) - 2**63, again))
        return out


def word_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """For each place (and `width` places after the end) the rank of the `width` bytes from there, equal where they are; the end sorts before all.

    The first words hold as many bytes as 64 bits can code; each round doubles them and sorts what is still tied.
    """
    n = len(data)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, _U)
    code[used] = np.arange(1, len(used) + 1, dtype=_U)
    bits = int(len(used)).bit_length()
    done = min(width, 64 // bits)
    coded = np.append(code[data], np.zeros(done, _U))
    key = np.zeros(n, _U)
    for k in range(done):
        key <<= _U(bits)
        key |= coded[k : k + n]
    del coded
    rank, live, base = np.zeros(n + width, np.uint32), None, np.arange(1, n + 1, dtype=np.uint32)
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        tied = ~(new & np.append(new[1:], True))
        # a rank is the place of the group's first among all; of what is sorted again, the places of its group
        first = base[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = order if live is None else live[order]
        rank[at] = first
        live, base = at[tied], base[tied]
        if done == width or not len(live):
            return rank
        step = min(done, width - done)
        key = rank[live].astype(_U) << _U(32)
        key |= rank[live + step]
        done += step


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of data (bytes) in the order of their first `depth` bytes; the end sorts before all."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    differs = np.flatnonzero(data[:-1] != data[1:])
    smaller = np.zeros(n, bool)  # than its successor; the last suffix isn't
    if len(differs):
        # each place up to a difference is as that difference says
        smaller[: differs[-1] + 1] = np.repeat(data[differs] < data[differs + 1], np.diff(differs, prepend=-1))
    # stage one: by the ranks of words, and where those are equal by the next word
    width = min(WORD_BYTES, depth)
    rank = word_ranks(data, width)
    direct = np.flatnonzero(smaller)
    group, live, at = np.zeros(len(direct), _U), np.arange(len(direct)), 0
    # places that are tied so far, and a word more of them in each pass: memory stays a few numbers a suffix, however periodic the text
    while len(live):
        key = group[live] << _U(32)
        key |= rank[direct[live] + at]
        order = np.argsort(key)
        direct[live], key = direct[live][order], key[order]
        new = np.append(True, key[1:] != key[:-1])
        group[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        live = live[~(new & np.append(new[1:], True))]
        if at == depth - width:
            break
        at = min(at + width, depth - width)
    del rank, group
    bounds = np.searchsorted(data[direct], np.arange(257))
    # stage two: the buckets in order; what a bucket holds puts the larger suffixes before it into theirs
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & ~smaller[before]]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & ~smaller[before]]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        if len(before):
            cut = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                larger[first[lo]].append(before[lo:hi])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the length of its common prefix with the one before, in bytes up to `most`.

    Where the next suffix in the text follows the next one too, its prefix is a byte shorter; so only the last of each such
    chain is compared.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[0]], before[order[1:]] = -1, order[:-1]
    goes_on = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[before[:-1]])
    last = np.append(np.flatnonzero(~goes_on), n - 1)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((n + most,), ">u8", padded.tobytes(), strides=(1,))
    ends = np.zeros(len(last), np.int64)
    live = np.flatnonzero(before[last] >= 0)
    for at in range(0, most, 8):
        x = words[last[live] + at].astype(_U) ^ words[before[last[live]] + at].astype(_U)
        ended = x != 0
        # equal bytes before the first that differs
        ends[live[ended]] = at + sum((x[ended] < _U(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        live = live[~ended]
        if not len(live):
            break
    ends[live] = most
    # bytes after the end don't count
    ends = np.minimum(ends, n - np.maximum(last, before[last]))
    length = np.repeat(last + ends, np.diff(last, prepend=-1)) - np.arange(n)
    return np.minimum(length, most)[order]


def repeated_starts(pieces: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its first `starts` positions begin a string of `length` bytes that begins elsewhere too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    order = suffix_array(data, length)
    group = np.cumsum(common_prefixes(data, order, length) < length)
    at = np.cumsum([0, *map(len, pieces)])
    valid = np.zeros(len(data), bool)
    for a, c in zip(at, starts, strict=False):
        valid[a : a + c] = True
    many = np.bincount(group, valid[order]) > 1
    found = np.zeros(len(data), bool)
    found[order] = many[group]
    return [found[a : a + c] for a, c in zip(at, starts, strict=False)]


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


RUNS = "anchor long, run long, start long, starts long, again boolean, text_key long, doc_id long"


def runs_of(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """RUNS of docs (doc_id, text, text_key)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text, key in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    for v, s, c, h, again in anchors.of(text.encode()):
                        for column, x in zip(out, (v, h, s, c, again, key, doc_id), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if i == 4 else pa.int64()) for i, x in enumerate(out)], names=[f.split()[0] for f in RUNS.split(", ")])

    return stored(docs.mapInArrow(find, RUNS), "runs")


PIECES = "anchor long, run long, starts long, bytes binary"
REPEATS = "anchor long, run long, lo long, hi long"


def bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """PIECES: the bytes of the runs in wanted (RUNS), from one document each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part, out = batch.slice(lo, 200), ([], [], [], [])
                for text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    for x in asked:
                        for column, v in zip(out, (x["anchor"], x["run"], x["starts"], data[x["start"] : x["start"] + x["starts"] + length - 1]), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["anchor", "run", "starts", "bytes"])

    asked = stored(wanted.groupBy("text_key", "doc_id").agg(F.collect_list(F.struct("anchor", "run", "start", "starts")).alias("asked")), "asked")
    texts = docs.join(sized(asked.select("text_key").distinct(), 1_000_000), "text_key", "left_semi")
    asked = asked.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    texts = texts.join(asked, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return texts.select("text", "asked").mapInArrow(cut, PIECES)


def sort_shards(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """REPEATS by a suffix array for each shard."""

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["anchor", "run"])
        found = repeated_starts(part["bytes"].to_list(), part["starts"].to_list(), length)
        rows = [(a, r, lo, hi) for a, r, x in zip(part["anchor"], part["run"], found, strict=True) for lo, hi in spans(x)]
        return pd.DataFrame(rows, columns=["anchor", "run", "lo", "hi"]).astype("int64")

    return pieces.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInPandas(search, REPEATS)


def count_strings(pieces: DataFrame, length: int) -> DataFrame:
    """REPEATS by a hash of each string, for anchors with too many runs for one task."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, r, c, data = (x[k].as_py() for x in batch.columns)
                for lo in range(0, c, STRINGS):
                    n = min(STRINGS, c - lo)
                    h = [xxhash.xxh3_64_intdigest(data[i : i + length]) - 2**63 for i in range(lo, lo + n)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.full(n, r)), pa.array(np.arange(lo, lo + n)), pa.array(h)], names=["anchor", "run", "lo", "string"])

    strings = stored(pieces.dropDuplicates(["anchor", "run"]).mapInArrow(hashes, "anchor long, run long, lo long, string long"), "strings")
    many = strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.join(sized(stored(many, "many")), ["anchor", "string"], "left_semi").select("anchor", "run", "lo", (F.col("lo") + 1).alias("hi"))


def repeats_under(pieces: DataFrame, length: int, gram: int, shard_bytes: int, hot_bytes: int, finer: tuple[int, ...] = FINER) -> DataFrame:
    """REPEATS of the strings in stored PIECES: sorted in shards, those of hot anchors under finer ones first."""
    pieces = pieces.dropDuplicates(["anchor", "run"])
    load = stored(pieces.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("bytes")), "load")
    total = load.agg(F.sum("bytes")).first()[0] or 0
    hot = stored(load.where(F.col("bytes") > hot_bytes).select("anchor"), "hot-anchors")
    found = sort_shards(pieces.join(sized(hot), "anchor", "left_anti"), max(1, -(-total // shard_bytes)), length)
    if hot.isEmpty():
        return found
    crowded = pieces.join(sized(hot), "anchor", "left_semi")
    if not finer:
        return found.unionByName(count_strings(crowded, length))
    return found.unionByName(_dealt_again(crowded, length, gram, shard_bytes, hot_bytes, finer))


SUBRUNS = "up long, up_run long, at long, sub long, run long, starts long, again boolean, bytes binary"


def _dealt_again(pieces: DataFrame, length: int, gram: int, shard_bytes: int, hot_bytes: int, finer: tuple[int, ...]) -> DataFrame:
    """REPEATS of PIECES, whose strings are dealt by anchors of finer[0] * gram bytes within their own."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, finer[0] * gram)
        for batch in batches:
            for k in range(batch.num_rows):
                up, run, _, data = (x[k].as_py() for x in batch.columns)
                out: list[list] = [[] for _ in range(8)]
                for v, s, c, h, again in anchors.of(data):
                    for column, x in zip(out, (up, run, s, v, h, c, again, data[s : s + c + length - 1]), strict=True):
                        column.append(x)
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SUBRUNS.split(", ")])

    subs = pieces.select("anchor", "run", "starts", "bytes").mapInArrow(find, SUBRUNS)
    subs = stored(subs.withColumn("anchor", F.xxhash64("up", "sub")).drop("sub"), "finer-runs")
    places = subs.select("up", "up_run", "at", "anchor", "run", "starts")
    seen = subs.groupBy("anchor").agg(F.min("run").alias("r0"), F.max("run").alias("r1"), F.bool_or("again").alias("again")).where("again or r0 <> r1").select("anchor")
    again = places.groupBy("anchor", "run").agg(F.count("*").alias("n"))
    found = repeats_under(stored(subs.select("anchor", "run", "starts", "bytes").join(stored(seen, "seen-anchors"), "anchor", "left_semi"), "pieces"), length, gram, shard_bytes, hot_bytes, finer[1:])
    # a run that occurs twice goes as a whole, of the others the parts that were found
    whole = places.join(again.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("up", "up_run", F.col("at").alias("lo"), (F.col("at") + F.col("starts")).alias("hi"))
    parts = places.join(again.where("n = 1").select("anchor", "run"), ["anchor", "run"]).join(found, ["anchor", "run"]).select("up", "up_run", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return whole.unionByName(parts).select(F.col("up").alias("anchor"), F.col("up_run").alias("run"), "lo", "hi")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """text_key, spans (sorted, apart): the bytes to remove from each text that loses any; docs: doc_id, text, text_key."""
    runs = runs_of(docs, length, gram)
    # anchors that occur more than once; copies of a run are summed up before the shuffle
    seen = runs.groupBy("anchor").agg(F.min("run").alias("r0"), F.max("run").alias("r1"), F.count("*").alias("n"), F.bool_or("again").alias("again")).where("n > 1 or again")
    seen = stored(seen.select("anchor", (F.col("again") | (F.col("r0") != F.col("r1"))).alias("sort")), "seen-anchors")
    runs = stored(runs.join(sized(seen, 1_000_000), "anchor"), "shared-runs")
    kinds = runs.groupBy("anchor", "run", "sort").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "starts")).alias("one"))
    kinds = stored(kinds.select("anchor", "run", "sort", "n", "one.*"), "run-kinds")
    # what is to be sorted
    asked = kinds.where("sort")
    found = repeats_under(stored(bytes_of(docs, asked, length), "pieces"), length, gram, shard_bytes, hot_bytes)
    # a run that occurs twice goes as a whole; of the others go the parts that the suffix arrays found
    whole = kinds.where("n > 1").select("anchor", "run", F.lit(0).cast("long").alias("lo"), F.col("starts").alias("hi"))
    gone = stored(whole.unionByName(found.join(kinds.where("sort and n = 1").select("anchor", "run"), ["anchor", "run"])), "repeats")
    places = runs.select("anchor", "run", "text_key", "start").dropDuplicates(["text_key", "start"]).join(gone, ["anchor", "run"])
    places = places.select("text_key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length - 1).alias("hi"))
    # spans that touch become one
    order = Window.partitionBy("text_key").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = places.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("text_key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return stored(islands.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", id_col: str = "doc_id", with_kept: bool = False, **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_kept: and the bytes that stay) of each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    lost = repeats(rows, length, gram, **sizes)
    joined = rows.join(sized(lost), "text_key", "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in schema.split(", ")]
                for doc_id, t, cut in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    data, cut = t.encode(), cut or []
                    kept = b"".join(data[a:b] for a, b in zip([0, *(x["hi"] for x in cut)], [*(x["lo"] for x in cut), len(data)], strict=True))
                    for column, v in zip(out, (doc_id, len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                        column.append(v)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=False)], names=[f.split()[0] for f in schema.split(", ")])

    return joined.mapInArrow(apply, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And removed_share: of the document's bytes, those that are removed."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.withColumn("removed_share", F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, b, unnest(range(0, greatest(0, n - 399))) AS i FROM d),
h AS (SELECT doc_id, i, md5(b[i + 1 : i + 400]) AS h FROM p),
dup AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 400 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM dup WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
sp AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM k GROUP BY doc_id, k),
c AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS fr FROM sp UNION ALL SELECT doc_id, n, coalesce(hi, 0) FROM d LEFT JOIN (SELECT doc_id, max(hi) AS hi FROM sp GROUP BY doc_id) USING (doc_id)),
t AS (SELECT doc_id, string_agg(hex(b[fr + 1 : lo]), '' ORDER BY fr) AS kept FROM c JOIN d USING (doc_id) WHERE lo > fr GROUP BY doc_id),
r AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, CASE WHEN n > 0 THEN coalesce(removed, 0) / n::DOUBLE ELSE 0e0 END AS removed_share FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
