"""Evaluation of scores against labels, folds and held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewise.functions import scoring

from .shared import cut_lineage, numbered_within, running, sized


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _prf(rows: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def prf_at(scores: DataFrame, threshold: float) -> DataFrame:
    """scores: y (0/1), score. One row: tp, fp, fn, tn, precision, recall, f1 (null where undefined)."""
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.count_if(c)
    return _prf(scores.agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn")))


def by_score(scores: DataFrame) -> DataFrame:
    """Each distinct score as a threshold, with its own pos and neg: counts by running sums over the grouped scores."""
    per = scores.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    total = per.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = running(per, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}).crossJoin(F.broadcast(total))
    return rows.select(F.col("score").alias("threshold"), "pos", "neg", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))


def best_f1(scores: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest such on a tie."""
    return _prf(by_score(scores).drop("pos", "neg")).orderBy(F.desc_nulls_last("f1"), "threshold").limit(1)


def sweep(scores: DataFrame, steps: int = 100) -> DataFrame:
    """Thresholds 0 to 1 in equal steps. Scores are binned first, so that the sweep costs one pass and a sum over bins."""
    spark = scores.sparkSession
    # the largest k with k / steps <= score
    k = F.least(F.lit(steps), F.floor(F.col("score") * steps + 1e-9)).cast("int")
    k = F.when(k / F.lit(float(steps)) > F.col("score"), k - 1).otherwise(F.when((k + 1) / F.lit(float(steps)) <= F.col("score"), k + 1).otherwise(k))
    bins = scores.where("score >= 0").groupBy(k.alias("k")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(bins, "k", "left").na.fill(0).withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)})
    total = scores.agg(F.count_if(F.col("y") == 1).alias("all_pos"), F.count_if(F.col("y") == 0).alias("all_neg"))
    rows = rows.crossJoin(F.broadcast(total)).select((F.col("k") / F.lit(float(steps))).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    return _prf(rows)


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids over the distinct scores."""
    rows = by_score(scores)
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    # the point before a score has the counts without those of the score itself
    area = ratio(F.col("neg"), n_neg) * (ratio(F.col("tp"), n_pos) + ratio(F.col("tp") - F.col("pos"), n_pos)) / 2
    return rows.agg(F.sum(area).alias("auc"), F.count("*").alias("points"))


def reliability(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per bin of scores; bins without rows are left out."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("observed"), F.count("*").alias("n"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"), F.count("*").alias("n"))


def source_max(rows: DataFrame, source: str = "src") -> DataFrame:
    """Per source: highest and mean score, count, and the label of its first row (by ord)."""
    return rows.groupBy(source).agg(F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.count("*").alias("n"), F.min_by("y", "ord").alias("y"))


def folds(sources: DataFrame, k: int = 5) -> DataFrame:
    """Sources (src, y) of each class dealt to k folds in order."""
    return numbered_within(sources, "y", [F.col("src")], "_rn", "_n").withColumn("fold", (F.col("_rn") - 1) % k).drop("_rn", "_n")


def holdout(sources: DataFrame, share: float = 0.2, seed: int = 4242, at_least: int = 0) -> DataFrame:
    """Sources (src, y) of each class in the order of a hash; the first share of them is held out, if there are enough."""
    rows = numbered_within(sources, "y", [F.xxhash64(F.lit(seed), "src"), F.col("src")], "_rn", "_n")
    return rows.withColumn("held_out", (F.col("_n") >= at_least) & (F.col("_rn") <= F.floor(F.col("_n") * share + 0.5))).drop("_rn", "_n")


def five_numbers(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Minimum, nearest-rank quartiles (places 0, n/4, n/2, 3n/4) and maximum per group, without the rows whose x is null.

    Equal values are counted first; the running counts are over distinct values, whatever a group's size.
    """
    per = rows.where(F.col(x).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    upto = cut_lineage(running(per, [F.col("_g"), F.col("_x")], {"_upto": F.col("_c")}))
    sizes = sized(cut_lineage(upto.groupBy(F.col("_g").alias("_h")).agg(F.min(F.col("_upto") - F.col("_c")).alias("_before"), F.sum("_c").alias("n"))))
    ranked = upto.join(sizes, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_last", F.col("_upto") - F.col("_before"))
    # the value at a place is the smallest one that reaches beyond it
    at = lambda place: F.min(F.when(F.col("_last") > place, F.col("_x")))
    n = F.col("n")
    out = ranked.groupBy(F.col("_g").alias(group), "n").agg(F.min("_x").alias("low"), at(F.floor(n / 4)).alias("q1"), at(F.floor(n / 2)).alias("median"), at(F.floor(n * 3 / 4)).alias("q3"), F.max("_x").alias("high"))
    return out.select(group, "low", "q1", "median", "q3", "high", "n")


def centroid(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group as rows (group, dim, mean)."""
    return rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def _apart_from(c: DataFrame, group: str, reference) -> DataFrame:
    """Cosine and Euclidean distance of the centroids in c (group, dim, mean) from that of the reference group."""
    ref = c.where(F.col(group) == reference).select("dim", F.col("mean").alias("ref"))
    sums = c.where(F.col(group) != reference).join(ref, "dim").groupBy(group).agg(F.sum(F.col("mean") * F.col("ref")).alias("ab"), F.sum(F.pow("mean", F.lit(2))).alias("aa"), F.sum(F.pow("ref", F.lit(2))).alias("bb"), F.sum(F.pow(F.col("mean") - F.col("ref"), 2)).alias("dd"))
    return sums.select(group, (F.lit(1.0) - F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"), F.sqrt("dd").alias("euclidean"))


def centroid_shift(rows: DataFrame, group: str, vector: str, reference) -> DataFrame:
    """Cosine and Euclidean distance of each group's centroid from the reference group's."""
    return _apart_from(centroid(rows, group, vector), group, reference)


def domain_shift(rows: DataFrame, group: str, vector: str, reference, anchor) -> DataFrame:
    """group, n, cosine, euclidean, geo_cosine, floor, verdict of every group but the two: how far its vectors lie from those that were trained on.

    cosine and euclidean: between its centroid and the reference's; geo_cosine: between its centroid and the anchor's, which
    is of the same place as the reference but scanned as the groups are; floor: the anchor's own cosine distance, which the
    verdict measures geo_cosine against. Centroids are made once, in one pass. Without reference or anchor there are no rows.
    """
    c = cut_lineage(centroid(rows, group, vector))
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    trained, scanned = cut_lineage(_apart_from(c, group, reference)), _apart_from(c, group, anchor).select(group, F.col("cosine").alias("geo_cosine"))
    floor = trained.where(F.col(group) == anchor).select(F.col("cosine").alias("floor"))  # one row
    out = n.join(trained, group).join(scanned, group).where(~F.col(group).isin(reference, anchor)).crossJoin(F.broadcast(floor))
    return out.select(group, "n", "cosine", "euclidean", "geo_cosine", "floor", scoring.shift_verdict(F.col("geo_cosine"), F.col("floor")).alias("verdict"))


def audit(results: DataFrame, expected: DataFrame, limit: float) -> DataFrame:
    """Per audit group: expected and judged counts, false positives, share, and whether to roll back."""
    got = results.groupBy("grp").agg(F.count("*").alias("judged"), F.count_if(F.col("label") == "fp").alias("fp"))
    rows = expected.groupBy("grp").agg(F.count("*").alias("expected")).join(got, "grp", "left").na.fill(0)
    rows = rows.withColumns({"missing": F.col("expected") - F.col("judged"), "fp_share": ratio(F.col("fp"), F.col("judged"))})
    return rows.withColumn("decision", F.when(F.col("fp_share") >= limit, "rollback").otherwise("keep"))


def operating_points(scores: DataFrame, fixed: float = 0.85) -> DataFrame:
    """point, threshold, tp, fp, fn, tn, precision, recall, f1: what a head may be run at; a point that no threshold meets has no row.

    high_precision: the lowest distinct score with a precision of 0.90 and a recall of 0.50 or more; target: the lowest
    step of the sweep with 0.99 and 0.50; deployed: the fixed threshold.
    """
    first = lambda rows, name, p: _prf(rows).where((F.col("precision") >= p) & (F.col("recall") >= 0.5)).orderBy("threshold").limit(1).withColumn("point", F.lit(name))
    steps = sweep(scores).drop("precision", "recall", "f1")
    rows = first(by_score(scores).drop("pos", "neg"), "high_precision", 0.9).unionByName(first(steps, "target", 0.99))
    return rows.unionByName(prf_at(scores, fixed).withColumns({"threshold": F.lit(fixed), "point": F.lit("deployed")}))


def worst(rows: DataFrame, key: str, n: int = 15) -> DataFrame:
    """The n negatives with the highest scores and the n positives with the lowest: y, key, score, rank; ties to the smaller key."""
    parts = [rows.where(F.col("y") == y).select("y", key, "score").orderBy(order, key).limit(n) for y, order in ((0, F.desc("score")), (1, F.asc("score")))]
    w = Window.partitionBy("y").orderBy(F.when(F.col("y") == 0, -F.col("score")).otherwise(F.col("score")), key)  # over 2n rows
    return parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(w))
