"""Linear heads, calibration and distances between sets of embeddings, with pyspark.ml."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.functions import scoring

from . import heads
from .evaluate import roc_auc
from .shared import cut_lineage, numbered_within


def fit_head(rows: DataFrame, vector: str, y: str, c: float = 1.0):
    """Logistic regression with an L2 penalty of 1/c and classes weighed to balance; (coefficients, intercept)."""
    n, n1 = rows.agg(F.count("*"), F.sum(F.col(y))).first()
    if not n or n1 in (0, n, None):
        raise ValueError("both classes are needed")
    weight = F.when(F.col(y) == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1)))
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(y).cast("double").alias("label"), weight.alias("w"))
    fitted = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=200, tol=1e-9).fit(data)
    return fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def head_frame(spark, coefficients: list[float], intercept: float, a: float | None = None, b: float | None = None) -> DataFrame:
    """A head as a table of one row, to be stored as Parquet."""
    return spark.createDataFrame([(coefficients, intercept, a, b)], "coefficients array<double>, intercept double, a double, b double")


def with_score(rows: DataFrame, vector: str, coefficients: list[float], intercept: float) -> DataFrame:
    weights = F.array(*map(F.lit, coefficients))
    return rows.withColumn("z", scoring.dot(F.col(vector), weights) + intercept).withColumn("score", scoring.sigmoid(F.col("z")))


def fit_scores(rows: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    return with_score(rows, vector, *fit_head(rows, vector, y)).select(key, y, F.round("score", 5).alias("score"))


def platt_fit(rows: DataFrame) -> DataFrame:
    """a and b of a sigmoid over z, and whether the fit is degenerate (rows: y, z)."""
    n = rows.count()
    data = rows.select(array_to_vector(F.array(F.col("z"))).alias("features"), F.col("y").cast("double").alias("label"))
    m = LogisticRegression(regParam=1 / (1e6 * n), standardization=False, maxIter=200, tol=1e-10).fit(data)
    a, b = float(m.coefficients[0]), float(m.intercept)
    pos, neg = rows.agg(F.avg(F.when(F.col("y") == 1, F.col("z"))), F.avg(F.when(F.col("y") == 0, F.col("z")))).first()
    return rows.sparkSession.createDataFrame([(a, b, a <= 0.05 or (pos or 0.0) <= (neg or 0.0))], "a double, b double, degenerate boolean")


def isotonic(rows: DataFrame, key: str) -> DataFrame:
    """Scores put in order by isotonic regression on y; scores outside the fitted range are clipped."""
    data = rows.select(key, "y", "score", F.col("y").cast("double").alias("label"), array_to_vector(F.array("score")).alias("features"))
    m = IsotonicRegression().fit(data)
    return m.transform(data).select(key, "y", "score", F.col("prediction").alias("calibrated"))


def leave_one_out(rows: DataFrame, group: str, key: str, vector: str, y: str, threshold: float = 0.5) -> DataFrame:
    """Recall and precision on each group by a head fitted on the others, all heads in the same steps; a null group is in the training rows of all.

    A group that no head could be fitted for, since the others have one class alone, has no row.
    """
    scored = heads.out_of_fold(heads.by_source(rows, group), "fold", vector, y).where("score is not null")
    hit, pos = F.col("score") >= threshold, F.col(y) == 1
    out = scored.groupBy(group).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~pos).alias("n_neg"))
    tp = F.col("tp")
    recall = F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn")))
    return out.select(group, "tp", "fp", "fn", "n_neg", recall.alias("recall"), F.when((tp + F.col("fp") > 0) & (F.col("n_neg") >= 3), tp / (tp + F.col("fp"))).alias("precision"))


def cross_validated_auc(rows: DataFrame, key: str, vector: str, y: str, folds: int = 5) -> DataFrame:
    """Area under the ROC curve of out-of-fold scores; rows are dealt to folds in order within each class, heads are fitted in the same steps."""
    dealt = numbered_within(rows, y, [F.xxhash64(F.lit(1202), key), F.col(key)], "_rn", "_n").withColumn("fold", ((F.col("_rn") - 1) % folds).cast("int")).drop("_rn", "_n")
    scored = heads.out_of_fold(dealt, "fold", vector, y).where("score is not null")
    auc = roc_auc(scored.select(F.col(y).alias("y"), "score"))
    return auc.select(F.round("auc", 6).alias("auc"), F.lit(folds).alias("folds"))


def _between(r) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the pairs of two blocks, and whether each pair counts: once, and never a key with itself."""
    x, y = (np.frombuffer(v).reshape(n, -1) for v, n in ((r.v, r.n), (r.v2, r.n2)))
    d2 = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d2 += (x[:, i, None] - y[None, :, i]) ** 2
    if r.b == r.b2:
        order = np.frombuffer(r.k, np.int64)
        return d2, order[:, None] < order[None, :]
    return d2, np.ones(d2.shape, bool)


def _middle(pairs: DataFrame) -> float | None:
    """The median of all distances above 0: 16 bits of the two middle ones are found in each pass, from counts."""
    ranks, prefixes = None, [0, 0]
    for shift in (48, 32, 16, 0):
        wanted = sorted(set(prefixes))

        def run(batches, wanted=wanted, shift=shift):
            counts = np.zeros((len(wanted), 1 << 16), np.int64)
            for batch in batches:
                for r in batch.itertuples(index=False):
                    d2, on = _between(r)
                    bits = d2[on & (d2 > 0)].view(np.int64) >> shift
                    for i, p in enumerate(wanted):
                        counts[i] += np.bincount(bits[bits >> 16 == p] & 0xFFFF, minlength=1 << 16)
            for p, c in zip(wanted, counts, strict=True):
                at = c.nonzero()[0]
                yield pd.DataFrame({"prefix": np.full(len(at), p), "bits": at, "n": c[at]})

        counts = np.zeros((len(wanted), 1 << 16), np.int64)
        for r in pairs.mapInPandas(run, "prefix long, bits long, n long").groupBy("prefix", "bits").agg(F.sum("n").alias("n")).collect():
            counts[wanted.index(r["prefix"]), r["bits"]] = r["n"]
        if ranks is None:
            n = int(counts.sum())
            if not n:
                return None
            ranks = [(n - 1) // 2, n // 2]
        for i in range(2):
            upto = counts[wanted.index(prefixes[i])].cumsum()
            bits = int(np.searchsorted(upto, ranks[i], "right"))
            ranks[i] -= int(upto[bits - 1]) if bits else 0
            prefixes[i] = prefixes[i] << 16 | bits
    return float(np.array(prefixes, np.int64).view(np.float64).mean())


def mmd2(rows: DataFrame, first, key: str, vector: str, block: int = 500) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel at the median distance, between all rows of two sets.

    Vectors are dealt to blocks by a hash of the key. Tasks go through pairs of blocks and give counts and sums, so no
    pair of vectors becomes a row. It is exact and so goes through all pairs, five times: made for the samples of some
    10,000 vectors that such distances are reported for, not for whole collections.
    """
    rows = rows.select(F.col(key).alias("k"), first.alias("a"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        order = part["k"].rank(method="dense").to_numpy(np.int64)
        v = np.array(part["v"].tolist(), np.float64)
        return pd.DataFrame({"b": part["b"].iloc[:1], "n": [len(part)], "k": [order.tobytes()], "a": [part["a"].to_numpy(bool).tobytes()], "v": [v.tobytes()]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks))).groupBy("b").applyInPandas(packed, "b long, n long, k binary, a binary, v binary")
    dealt = cut_lineage(dealt)
    both = rows.sparkSession.range(blocks * blocks).select(F.expr(f"id div {blocks}").alias("b"), (F.col("id") % blocks).alias("b2")).where("b <= b2")
    other = dealt.select(F.col("b").alias("b2"), F.col("n").alias("n2"), F.col("a").alias("a2"), F.col("v").alias("v2"))
    pairs = both.join(dealt, "b").join(other, "b2").select("b", "n", "k", "a", "v", "b2", "n2", "a2", "v2")
    mid = _middle(pairs)

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                d2, on = _between(r)
                k, a, a2 = np.exp(-d2 / mid), np.frombuffer(r.a, bool)[:, None], np.frombuffer(r.a2, bool)[None, :]
                yield pd.DataFrame([[x for c in (on & a & a2, on & ~a & ~a2, on & (a != a2)) for x in (float(k[c].sum()), int(c.sum()))]], columns=names)

    names = ["s0", "n0", "s1", "n1", "s2", "n2"]
    if mid is None:
        return rows.sparkSession.createDataFrame([(None,)], "mmd2 double")
    mean = lambda i: F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}"))
    return pairs.mapInPandas(run, "s0 double, n0 long, s1 double, n1 long, s2 double, n2 long").agg((mean(0) + mean(1) - 2 * mean(2)).alias("mmd2"))


def zero_shot(rows: DataFrame, vector: str, solar: list[float], other: list[float], group: str) -> DataFrame:
    """Per group the highest margin between the cosines to two prompt vectors."""
    margin = scoring.cosine(F.col(vector), F.array(*map(F.lit, solar))) - scoring.cosine(F.col(vector), F.array(*map(F.lit, other)))
    return rows.groupBy(group).agg(F.max(margin).alias("margin"))


__all__ = ["cross_validated_auc", "fit_head", "fit_scores", "head_frame", "isotonic", "leave_one_out", "mmd2", "platt_fit", "with_score", "zero_shot"]
