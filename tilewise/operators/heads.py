"""Many logistic fits at once: one per group over a score, or one per fold over vectors, in steps that all of them share.

A Newton step needs sums over rows alone, so each step is one pass over the data for all fits together; the number of jobs
follows from the slowest fit, not from how many there are. Sums are made in the tasks; nothing grows with the rows on
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import scoring

from .shared import BROADCAST_ROWS, cut_lineage, numbered, sized

MIN_SLOPE, MIN_POSITIVES = 0.05, 5
#: Folds that are fitted together; more are done in several rounds.
FOLDS_AT_ONCE = 64


#: The lengths of a step that are tried at once.
LENGTHS = (1.0, 0.5, 0.25, 1 / 16, 1 / 256)


def _sums(a: Column, b: Column, c: float) -> Column:
    """Loss, gradient and Hessian of the sigmoid of a z + b over the rows of y, z and w, without overflow; a's penalty is added later."""
    m = a * F.col("z") + b
    p, w = scoring.sigmoid(m), F.col("w")
    d, h = w * (p - F.col("y")), w * p * (1 - p)
    loss = w * (F.greatest(m, F.lit(0.0)) - F.col("y") * m + F.log1p(F.exp(-F.abs(m))))
    return F.struct(*[F.sum(x).alias(n) for n, x in (("loss", loss), ("ga", d * F.col("z")), ("gb", d), ("haa", h * F.col("z") * F.col("z")), ("hab", h * F.col("z")), ("hbb", h))])


def fit_platt(rows: DataFrame, group: str, c: float = 1e6, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """group, n_pos, n_neg, a, b: for each group the sigmoid of a z + b over y (0 or 1), with an L2 penalty of 1/c on a.

    a and b are null where a group has one class alone. Equal rows are counted first. A step's length is that of LENGTHS with
    the lowest loss, per group; the sums for the next step are made in the same pass. Rows with a null y or z, or a z that isn't
    finite, take no part; null is a group. The sums of a group come in any order, which moves the last bits of a fit.
    """
    fine = F.col("y").isNotNull() & F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))
    rows = rows.where(fine).groupBy(F.col(group).alias("g"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")).agg(F.count("*").cast("double").alias("w"))
    rows = cut_lineage(rows)
    sizes = cut_lineage(rows.groupBy("g").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).cast("long").alias("n_pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).cast("long").alias("n_neg")))
    fits = sizes.where("n_pos > 0 and n_neg > 0").select(F.col("g").alias("_g"), *[F.lit(0.0).alias(n) for n in ("a", "b", "da", "db")], F.lit(None).cast("double").alias("gain"))
    small = sizes.count() <= BROADCAST_ROWS
    fits, lengths = cut_lineage(fits), (0.0,)
    for _ in range(most):
        at = [(F.col("a") - t * F.col("da"), F.col("b") - t * F.col("db")) for t in lengths]
        met = rows.join(F.broadcast(fits) if small else fits, F.col("g").eqNullSafe(F.col("_g")))
        tried = met.groupBy("_g", "a", "b", "da", "db").agg(*[_sums(*x, c).alias(f"s{i}") for i, x in enumerate(at)])
        best = F.array_min(F.array(*[F.struct((F.col(f"s{i}.loss") + a * a / (2 * c)).alias("loss"), a.alias("a"), b.alias("b"), F.col(f"s{i}").alias("s")) for i, (a, b) in enumerate(at)]))
        s = tried.select("_g", best.alias("x")).select("_g", "x.a", "x.b", "x.s.*")
        s = s.withColumns({"ga": F.col("ga") + F.col("a") / c, "haa": F.col("haa") + 1 / c, "hbb": F.col("hbb") + 1e-12})
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        step = s.withColumns({"da": (F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / det, "db": (F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / det})
        fits, lengths = cut_lineage(step.select("_g", "a", "b", "da", "db", (F.col("da") * F.col("ga") + F.col("db") * F.col("gb")).alias("gain"))), LENGTHS
        worst = fits.agg(F.max(F.when(F.isnan("gain"), 0.0).otherwise(F.abs("gain")))).first()[0]
        if worst is None or worst < tolerance:
            break
    # the last step is below what is asked for, and makes it quadratically smaller
    found = fits.select("_g", (F.col("a") - F.col("da")).alias("a"), (F.col("b") - F.col("db")).alias("b"))
    return sizes.join(F.broadcast(found) if small else found, F.col("g").eqNullSafe(F.col("_g")), "left").select(F.col("g").alias(group), "n_pos", "n_neg", "a", "b")


def calibrate(rows: DataFrame, group: str, threshold: float = C.HIGH, min_slope: float = MIN_SLOPE, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """group, status, n_pos, n_neg, a, b, brier, tp, fp, fn, precision, recall: each group's calibrated scores on its own rows (y, z).

    uncalibrated_low_n: fewer positives than that; calibration_not_estimable: one class alone, a slope of min_slope or less,
    or positives that don't score above negatives once calibrated; such groups have no figures beyond the slope. Negatives
    that are a random sample may hold a few positives, so precision is a lower bound.
    """
    fits = cut_lineage(fit_platt(rows, group))
    one = fits.select(F.col(group).alias("_g"), "a", "b")
    p = scoring.sigmoid(F.col("a") * F.col("z") + F.col("b"))
    pos, hit = F.col("y") == 1, F.col("p") >= threshold
    scored = rows.join(sized(one), F.col(group).eqNullSafe(F.col("_g"))).withColumn("p", p).where("p is not null and y is not null and not isnan(p)")
    sums = scored.groupBy("_g").agg(F.avg(F.when(pos, F.col("p"))).alias("mp"), F.avg(F.when(~pos, F.col("p"))).alias("mn"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    out = fits.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left")
    status = F.when(F.col("n_pos") < min_positives, "uncalibrated_low_n").when(F.coalesce((F.col("a") <= min_slope) | (F.col("mp") <= F.col("mn")), F.lit(True)), "calibration_not_estimable").otherwise("calibrated")
    good = lambda c: F.when(F.col("status") == "calibrated", c)
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return out.withColumn("status", status).select(group, "status", "n_pos", "n_neg", "a", good(F.col("b")).alias("b"), good(F.col("brier")).alias("brier"), good(tp).alias("tp"), good(fp).alias("fp"), good(fn).alias("fn"), good(share(tp, tp + fp)).alias("precision"), good(share(tp, tp + fn)).alias("recall"))


def _steps(rows: DataFrame, held: list[int], w: np.ndarray, weights: np.ndarray, c: float) -> dict[int, tuple[float, np.ndarray]]:
    """fold -> (loss, Newton direction) at w (folds x (dim + 1)); rows: fold, y, v. One job; a fold's sums meet in one task and only its direction leaves it."""
    dim = w.shape[1] - 1
    size = 2 + dim + (dim + 1) ** 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(held), size))
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y = batch.column(0).fill_null(-1).to_numpy(), batch.column(1).to_numpy()
            x = np.concatenate([batch.column(2).flatten().to_numpy().reshape(len(y), dim), np.ones((len(y), 1))], 1)
            m = x @ w.T
            for i, k in enumerate(held):
                z = m[:, i]
                cw = np.where(fold == k, 0.0, np.where(y == 1, weights[i, 1], weights[i, 0]))
                p = np.exp(-np.logaddexp(0.0, -z))
                sums[i, 0] += (cw * (np.logaddexp(0.0, z) - y * z)).sum()
                sums[i, 1 : dim + 2] += x.T @ (cw * (p - y))
                sums[i, dim + 2 :] += (x.T @ (x * (cw * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["k", "s"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + s.values.to_numpy()
        penalty = np.append(np.full(dim, 1 / c), 0.0)
        found = []
        for k, s in total.items():
            own = w[held.index(k)]
            gradient, hessian = s[1 : dim + 2] + penalty * own, s[dim + 2 :].reshape(dim + 1, dim + 1) + np.diag(penalty + 1e-10)
            found.append([s[0] + (penalty * own * own).sum() / 2, *np.linalg.solve(hessian, gradient)])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["k", "s"])

    schema = "k int, s array<double>"
    sums = rows.select("fold", "y", "v").mapInArrow(partial, schema).repartition(len(held), "k").mapInArrow(solve, schema)
    return {r["k"]: (r["s"][0], np.array(r["s"][1:])) for r in sums.collect()}  # a row a fold


def fit_folds(rows: DataFrame, folds: list[int], c: float = 1.0, tolerance: float = 1e-9, most: int = 60) -> dict[int, list[float]]:
    """fold -> coefficients and intercept of a head fitted on all rows (fold, y, v) of other folds; None where those have one class alone.

    L2 penalty of 1/c on the coefficients, classes weighed to balance. A step that makes a fold's loss grow is halved, until it doesn't.
    """
    counts: dict[int | None, list[int]] = {r["fold"]: [r["n0"], r["n1"]] for r in rows.groupBy("fold").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()}
    total = np.array(list(counts.values()) or [[0, 0]]).sum(0)
    left = {k: total - counts.get(k, [0, 0]) for k in folds}
    fits: dict[int, list[float] | None] = {k: None for k in folds}
    held = [k for k in folds if left[k].min() > 0]
    if not held:
        return fits
    dim = rows.select(F.max(F.size("v"))).first()[0]
    weights = np.array([left[k].sum() / (2 * left[k]) for k in held])
    w, before, back = np.zeros((len(held), dim + 1)), np.full(len(held), np.inf), np.zeros((len(held), dim + 1))
    for _ in range(most):
        found = _steps(rows, held, w, weights, c)
        done = True
        for i, k in enumerate(held):
            loss, direction = found[k]
            if loss > before[i] * (1 + 1e-12):
                w[i], done = (w[i] + back[i]) / 2, False
                continue
            before[i], back[i] = loss, w[i]
            w[i] = w[i] - direction
            done &= bool(np.abs(direction).max() < tolerance * max(1.0, np.abs(w[i]).max()))
        if done:
            break
    return fits | {k: x.tolist() for k, x in zip(held, w, strict=True)}


def _usable(rows: DataFrame, vector: str, y: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return rows.where(F.col(y).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))


def out_of_fold(rows: DataFrame, fold: str, vector: str, y: str, c: float = 1.0) -> DataFrame:
    """rows with score: the probability by the head that was fitted without the row's fold (whole numbers, of which there are few).

    score is null where the other folds have one class alone. Rows with a null label, vector or component are left out;
    a null fold is in the training rows of every head and has no score.
    """
    rows = cut_lineage(_usable(rows, vector, y))
    data = cut_lineage(rows.select(F.col(fold).cast("int").alias("fold"), F.col(y).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("v")))
    folds = sorted(r[0] for r in data.select("fold").where("fold is not null").distinct().collect())
    parts = []
    for lo in range(0, len(folds), FOLDS_AT_ONCE):
        some = folds[lo : lo + FOLDS_AT_ONCE]
        parts += fit_folds(data, some, c).items()
    heads = rows.sparkSession.createDataFrame([(k, w[:-1] if w else None, w[-1] if w else None) for k, w in parts], "_fold int, _w array<double>, _b double")
    scored = rows.join(F.broadcast(heads), F.col(fold) == F.col("_fold"))  # a row a fold
    return scored.withColumn("score", scoring.sigmoid(scoring.dot(F.col(vector), F.col("_w")) + F.col("_b"))).drop("_fold", "_w", "_b")


def by_source(rows: DataFrame, source: str) -> DataFrame:
    """rows with fold: the place of their source among the sources, for leaving out one source at a time."""
    sources = numbered(rows.select(source).where(F.col(source).isNotNull()).distinct(), [F.col(source)], "fold").withColumn("fold", F.col("fold").cast("int"))
    return rows.join(sized(cut_lineage(sources.withColumnRenamed(source, "_source"))), F.col(source) == F.col("_source"), "left").drop("_source")
