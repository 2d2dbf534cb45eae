"""Hard negatives by a distributed radix selection over integer scores.

A search has an anchor and windows of scores, lowest to highest; each window wants its k highest scores. A round counts, per
window, the rows under each of 1024 digits of the distance from the window's upper end; summed over all tasks the counts
tell the bucket that holds the k-th score and how many lie above it, and the next round looks at that bucket alone, a
digit finer. After the last digit the k-th score is known exactly. Then one more pass gathers what lies above it, and of
the rows with that very score each task gives the smallest ids that could still be needed. No round moves a vector or an id.

Two searches: positives (same label, one window over all scores that occur) and negatives (other labels, a window per
positive). Tasks hold a bounded chunk of rows and go through the anchors block by block, a stated query set against all
rows; anchors and windows are read from the shared folder. Of a chunk's counts only the first digits up to the k-th
row of that chunk are sent: the k-th of all rows can't lie lower, so the sums are right where they are looked at.

Scores are products of integers, exact in double precision while squared norms are below 2^52, in 64-bit integers beyond.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite, take no part, nor do
those whose integer vector has a squared norm of 2^59 or more (its scores might not fit a long); zero and empty vectors
do; vectors are compared with those of the same length; of rows with one id that with the smallest (label, vector) stands
for it; ties go to the smaller id; a negative positive score leaves an empty window; anchors without positives, and
positives without negatives, have no row; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sized, stored, table
from .warc import file_system

POSITIVES, NEGATIVES = 5, 10
#: A score is inside a positive's window from LOW to HIGH tenths of the positive's score.
LOW, HIGH = 3, 9
DIGITS = 1024
#: Components of a chunk of rows, and scores that are held at once.
CHUNK, CELLS = 4_000_000, 2_000_000
EXACT, MOST = 2.0**52, 2.0**59


def usable(rows: DataFrame, id_col: str, label, vector: str) -> DataFrame:
    """id, label, dim, norm, v (floor(256 x), in double precision), one row an id."""
    fine = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # a floor of large doubles as long would wrap; those are whole numbers already
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * 256).cast("double")).otherwise(x * 256))
    rows = rows.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where("label is not null")
    rows = rows.withColumns({"dim": F.size("v"), "norm": F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)}).where(F.col("norm") < MOST)
    rows = stored(rows.select("id", "label", "dim", "norm", "v"), "vectors")
    again = sized(stored(rows.groupBy("id").count().where("count > 1").select("id"), "repeated"))
    one = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "dim", "norm")).alias("r")).select("id", "r.label", "r.dim", "r.norm", "r.v")
    return rows.join(again, "id", "left_anti").select("id", "label", "dim", "norm", "v").unionByName(one)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of one length each, of at most about CHUNK components; columns: id, label, dim, v."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}

    def whole(dim: int):
        size.pop(dim)
        return tuple(map(np.concatenate, zip(*held.pop(dim), strict=True)))

    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            step = max(1, CHUNK // max(1, dim))
            for lo in range(0, part.num_rows, step):
                p = part.slice(lo, step)
                held.setdefault(dim, []).append((p.column(0).to_numpy(), p.column(1).to_numpy(), p.column(3).flatten().to_numpy().reshape(p.num_rows, dim)))
                size[dim] = size.get(dim, 0) + p.num_rows * max(1, dim)
                if size[dim] >= CHUNK:
                    yield whole(dim)
        while sum(size.values()) > CHUNK:  # many lengths
            yield whole(max(size, key=size.get))
    for dim in list(held):
        yield whole(dim)


class Searches:
    """What tasks read: anchors (id, label, dim, v) with their windows (win, lo, hi, top, need), in the shared folder."""

    def __init__(self, asked: DataFrame, same: bool, exact: bool):
        self.same, self.exact = same, exact
        files = asked.inputFiles()
        self.folder = files[0].rsplit("/", 1)[0] if files else None
        if self.folder:
            file_system(self.folder)  # fails here, and not in a task

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(ids, scores, which rows count, windows) for each chunk and block of anchors; windows: per place in the list its arrays."""
        import pyarrow.dataset as ds

        for ids, labels, x in _chunks(batches):
            fs, path = file_system(self.folder)
            rows = ds.dataset(path, filesystem=fs, format="parquet")
            x = x if self.exact else x.astype(np.int64)
            size = max(1, CELLS // len(ids))
            for batch in rows.to_batches(columns=["id", "label", "v", "wins"], filter=ds.field("dim") == x.shape[1], batch_size=size, use_threads=False, batch_readahead=0, fragment_readahead=0):
                for lo in range(0, batch.num_rows, size):
                    b = batch.slice(lo, size)
                    anchor, v = b.column(0).to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, x.shape[1])
                    scores = v.astype(x.dtype) @ x.T
                    own = b.column(1).to_numpy()[:, None] == labels
                    counts = own & (anchor[:, None] != ids) if self.same else ~own
                    wins, ends = b.column(3), b.column(3).offsets.to_numpy()
                    flat = {f.name: c.to_numpy() for f, c in zip(wins.values.type, wins.values.flatten(), strict=True)}
                    for place in range(int(np.diff(ends).max(initial=0))):
                        who = np.flatnonzero(np.diff(ends) > place)
                        yield ids, scores, counts, who, anchor[who], {k: c[ends[who] + place] for k, c in flat.items()}


COUNTS, FOUND = "anchor long, win long, digit int, n long", "anchor long, win long, score long, id long"


def _count(searches: Searches, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, scores, counts, who, anchor, w in searches.scored(batches):
            s = scores[who]
            row, col = np.nonzero(counts[who] & (s >= w["lo"][:, None]) & (s <= w["hi"][:, None]) & (w["need"] > 0)[:, None])
            digit = (w["hi"][row] - s[row, col].astype(np.int64)) // step
            n = np.bincount(row * DIGITS + digit, minlength=len(who) * DIGITS).reshape(len(who), DIGITS)
            row, digit = np.nonzero((n > 0) & (np.cumsum(n, 1) - n < w["need"][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(w["win"][row]), pa.array(digit, pa.int32()), pa.array(n[row, digit], pa.int64())], names=["anchor", "win", "digit", "n"])

    return run


def _gather(searches: Searches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores, counts, who, anchor, w in searches.scored(batches):
            s = scores[who]
            row, col = np.nonzero(counts[who] & (s >= w["hi"][:, None]) & (s <= w["top"][:, None]))
            score = s[row, col].astype(np.int64)
            # of those at the last score (hi) the smallest ids, as many as are needed; of those above all
            order = np.lexsort((ids[col], score != w["hi"][row], row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            take = (score != w["hi"][row]) | (place < w["need"][row])
            row, col, score = row[take], col[take], score[take]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(w["win"][row]), pa.array(score), pa.array(ids[col])], names=["anchor", "win", "score", "id"])

    return run


def select(rows: DataFrame, windows: DataFrame, k: int, same: bool, exact: bool) -> DataFrame:
    """anchor, win, rank, score, id: the k highest scores of each window (ties: smaller ids), or all if there are fewer.

    rows: id, label, dim, norm, v; windows: anchor, win, lo, hi (scores, both inside). same: whether candidates have the
    anchor's label (without the anchor itself) or another one.
    """
    vectors = rows.select("id", "label", "dim", "v")
    state = stored(windows.where("lo <= hi").select("anchor", "win", F.col("lo").alias("floor"), F.col("hi").alias("top"), "lo", "hi", F.lit(k).cast("long").alias("need")), "windows")
    widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    rounds = 1
    while widest is not None and DIGITS**rounds <= widest:
        rounds += 1

    def asked(s: DataFrame) -> Searches:
        wins = s.groupBy("anchor").agg(F.collect_list(F.struct("win", "lo", "hi", "top", "need")).alias("wins"))  # a few an anchor
        return Searches(stored(wins.join(vectors, F.col("anchor") == F.col("id")).select("id", "label", "dim", "v", "wins"), "anchors"), same, exact)

    for r in range(rounds):
        step, searches = DIGITS ** (rounds - 1 - r), asked(state)
        found = (vectors if searches.folder else vectors.limit(0)).mapInArrow(_count(searches, step), COUNTS).groupBy("anchor", "win", "digit").agg(F.sum("n").alias("n"))
        upto = found.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor", "win").orderBy("digit")))  # DIGITS rows a window at most
        s = state.alias("s")
        hit = upto.alias("u").join(s, ["anchor", "win"]).where("upto >= need").groupBy("anchor", "win").agg(F.min(F.struct("digit", (F.col("upto") - F.col("u.n")).alias("above"))).alias("hit"))
        joined = state.where("need > 0").join(hit, ["anchor", "win"], "left")
        hi = F.col("hi") - F.col("hit.digit").cast("long") * F.lit(step).cast("long")
        # fewer than needed: all of the window counts, and its last score lies below its floor
        short = F.col("hit").isNull()
        moved = joined.select(
            "anchor", "win", "floor", "top", F.when(short, F.col("floor") - 1).otherwise(F.greatest(F.col("lo"), hi - F.lit(step - 1).cast("long"))).alias("lo"),
            F.when(short, F.col("floor") - 1).otherwise(hi).alias("hi"), F.when(short, 0).otherwise(F.col("need") - F.col("hit.above")).cast("long").alias("need"),
        )
        state = stored(moved.unionByName(state.where("need = 0")), "windows")
    searches = asked(state)
    found = (vectors if searches.folder else vectors.limit(0)).mapInArrow(_gather(searches), FOUND)
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows as usable() gives them, anchors: a condition on them."""
    rows = stored(rows, "rows")
    norm = rows.agg(F.max("norm")).first()[0] or 0.0
    exact, bound = norm < EXACT, int(norm) + 1
    all_scores = rows.where(anchors).select(F.col("id").alias("anchor"), F.lit(0).cast("long").alias("win"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    positives = stored(select(rows, all_scores, n_positives, True, exact).select("anchor", F.col("id").alias("win"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    inside = positives.where(p >= 0).select("anchor", "win", F.expr(f"(positive_score * {LOW} + 9) div 10").alias("lo"), F.expr(f"(positive_score * {HIGH}) div 10").alias("hi"))
    found = select(rows, inside, n_negatives, False, exact)
    return found.join(positives, ["anchor", "win"]).select(F.col("anchor").alias("anchor_id"), F.col("win").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(usable(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding"), F.col("id") % 100 == 0)


OP13_SQL = """
WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
g AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM g JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
