"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards by a hash of the id; a shard's task builds a tree over its distinct vectors (equal vectors
are one point with its smallest ids, as many as a query could need) and takes all queries through it, in blocks.
A node splits its points at the median distance from its vantage point. A query first goes down to the leaf on its own
side of every boundary; then it enters each half that it isn't in if (distance to the boundary) * factor <= (distance of
its k-th neighbour so far): with the factor 1 that is the triangle inequality and the search is exact, larger factors
leave out more. Distances that decide are those of the
original vectors in double precision. Each shard returns k per query, and the k smallest of those are kept.

Each vector goes through the shuffle once, to its shard, and each tree is built once. The queries are written to the
shared folder, from which every shard's task reads them block by block, a stated query set against all rows. The number of
shards follows from the number of vectors alone, so that the answer is the same on any cluster; a task holds one shard and
one block, both bounded by parameters. Tasks with several shards merge what they have found before the last shuffle.

Defined results: vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part, as
candidate or as query; vectors are compared with those of the same length; ties go to the smaller id; a query's own id
is no candidate, in any row that has it; rows that repeat id and vector are one candidate; of a query's rows the smallest
vector of each length asks; a null id is neither query
nor candidate; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .warc import file_system

#: A shard holds about SHARD_ROWS vectors; QUERY_ROWS queries go through a tree together.
K, FACTOR, LEAF, SHARD_ROWS, QUERY_ROWS = 10, 2.0, 128, 50_000, 20_000
FOUND = "query_id long, vec_id long, score double"
#: Stands for no id; greater than all.
NONE = np.iinfo(np.int64).max


def usable(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


class Tree:
    """Over the distinct rows of x, each with the ids of its copies in order (at most `most` of them)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int, leaf: int = LEAF):
        order = np.lexsort((ids, *x.T))
        ids, x = ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        again = ~new
        again[1:] &= ids[1:] == ids[:-1]  # the same id and vector once more
        ids, x, new = ids[~again], x[~again], new[~again]
        starts = np.flatnonzero(new)
        point = np.cumsum(new) - 1
        keep = np.arange(len(ids)) - starts[point] < most
        self.x, self.ids, self.leaf = x[starts], ids[keep], leaf
        self.first = np.concatenate([[0], np.cumsum(np.bincount(point[keep], minlength=len(starts)))])
        self.root = self._build(np.arange(len(self.x)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return idx
        # the point farthest from the mean: its shell distances spread most
        sub = self.x[idx]
        at = int(((sub - sub.mean(0)) ** 2).sum(1).argmax())
        d = np.sqrt(((sub - sub[at]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(idx) // 2
        mu = (d[order[half - 1]] + d[order[half]]) / 2
        return self.x[idx[at]], mu, self._build(idx[order[:half]]), self._build(idx[order[half:]])

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float):
        """(scores, ids), each queries x k, filled up with inf and NONE."""
        self.best, self.best_id = np.full((len(q), k), np.inf), np.full((len(q), k), NONE)
        self.q_norm, self.x_norm = (q**2).sum(1), (self.x**2).sum(1)
        self.q, self.qids, self.k, self.factor = q, qids, k, factor
        if len(self.x):
            everyone = np.arange(len(q))
            self.home = np.empty(len(q), np.int64)
            self._descend(self.root, everyone)
            self._visit(self.root, everyone)
        return self.best, self.best_id

    def _gap(self, node, who: np.ndarray) -> np.ndarray:
        """How far each query lies outside the boundary of the node (inside: negative)."""
        return np.sqrt(((self.q[who] - node[0]) ** 2).sum(1)) - node[1]

    def _descend(self, node, who: np.ndarray) -> None:
        """Takes each query to the leaf on its own side of every boundary, for a first idea of its neighbours."""
        if isinstance(node, np.ndarray):
            self.home[who] = node[0]
            self._leaf(node, who)
        elif len(who):
            near = self._gap(node, who) < 0
            self._descend(node[2], who[near])
            self._descend(node[3], who[~near])

    def _visit(self, node, who: np.ndarray) -> None:
        """Takes the queries to all leaves that the bound leaves open, each leaf once with all its queries."""
        if isinstance(node, np.ndarray):
            self._leaf(node, who[self.home[who] != node[0]])
        elif len(who):
            gap = self._gap(node, who)
            for side, beyond in ((node[2], gap), (node[3], -gap)):
                # the rounding of distances gets a hair's breadth to spare
                self._visit(side, who[beyond * self.factor <= self.best[who, -1] * (1 + 1e-9)])

    def _leaf(self, idx: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        # a product tells which pairs could be near enough; those alone are measured
        limit, norms = self.best[who, -1] ** 2, self.q_norm[who][:, None] + self.x_norm[idx]
        row, col = np.nonzero(norms - 2 * self.q[who] @ self.x[idx].T <= limit[:, None] + 1e-9 * norms)
        d = np.sqrt(((self.q[who[row]] - self.x[idx[col]]) ** 2).sum(1))
        near = d <= self.best[who[row], -1]
        row, col, d = row[near], idx[col[near]], d[near]
        copies = self.first[col + 1] - self.first[col]
        at = np.repeat(self.first[col] - np.concatenate([[0], np.cumsum(copies)[:-1]]), copies) + np.arange(copies.sum())
        row, d, ids = np.repeat(row, copies), np.repeat(d, copies), self.ids[at]
        other = ids != self.qids[who[row]]
        row, d, ids = row[other], d[other], ids[other]
        if not len(row):
            return
        changed, place = np.unique(row, return_inverse=True)
        # each query's new candidates beside its best so far, then the k first by distance and id
        within = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.bincount(place))[:-1]])[place]
        wide = self.k + int(within.max()) + 1
        score, named = np.full((len(changed), wide), np.inf), np.full((len(changed), wide), NONE)
        score[:, : self.k], named[:, : self.k] = self.best[who[changed]], self.best_id[who[changed]]
        score[place, self.k + within], named[place, self.k + within] = d, ids
        order = np.lexsort((named, score), axis=1)[:, : self.k]
        self.best[who[changed]], self.best_id[who[changed]] = np.take_along_axis(score, order, 1), np.take_along_axis(named, order, 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each (shard, dim), which are the first two columns and in whose order the rows come."""
    now, held = None, []
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            if held and tuple(key[lo]) != now:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
            now, part = tuple(key[lo]), batch.slice(lo, hi - lo)
            held.append((part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(hi - lo, -1)))
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of each query (fewer, if there aren't as many)."""
    v, q = usable(vectors, id_col, vector), usable(queries, id_col, vector)
    shards = shards or max(1, -(-v.count() // shard_rows))
    asked = stored(q.groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v")), "queries")
    files = asked.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else None
    if folder:
        file_system(folder)  # fails here, and not in a task, where the shared folder is one that only Spark reads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        for ids, x in _shards(batches):
            tree = Tree(ids, x, k + 1)
            fs, path = file_system(folder)
            rows = ds.dataset(path, filesystem=fs, format="parquet")
            for batch in rows.to_batches(columns=["id", "v"], filter=ds.field("dim") == x.shape[1], batch_size=query_rows, use_threads=False, batch_readahead=0, fragment_readahead=0):
                if batch.num_rows:
                    qids = batch.column(0).to_numpy()
                    score, found = tree.search(qids, batch.column(1).flatten().to_numpy().reshape(len(qids), -1), k, factor)
                    full = found != NONE
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, k)[full.ravel()]), pa.array(found[full]), pa.array(score[full])], names=["query_id", "vec_id", "score"])

    dealt = v.select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "id", "v")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "dim") if folder else dealt.limit(0)
    found = dealt.mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
