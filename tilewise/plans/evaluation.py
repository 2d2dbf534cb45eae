"""Queries over scores, embeddings, signals and pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewise import config as C
from tilewise.functions import geo, scoring, text
from tilewise.operators import composite, evaluate, gates, model, raster

from . import geography as G

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SIGNALS = """sig AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal END AS nir, s_acctbal * (s_suppkey % 7) AS swir, s_suppkey % 13 * 1e0 AS lst, 5e0 AS nightlight FROM supplier),
st AS (SELECT avg(nir) an, stddev_samp(nir) sn, avg(swir) aw, stddev_samp(swir) sw, avg(lst) al, stddev_samp(lst) sl FROM sig),
z AS (SELECT k, (nir - an) / sn AS z_nir, (swir - aw) / sw AS z_swir, (lst - al) / sl AS z_lst, 0e0 AS z_nightlight FROM sig, st),
c AS (SELECT *, coalesce(z_nir, 0) * -4e-1 + coalesce(z_swir, 0) * -3e-1 + coalesce(z_lst, 0) * -2e-1 + coalesce(z_nightlight, 0) * 1e-1 AS composite FROM z)"""


def _composite(spark, d):
    k = F.col("s_suppkey")
    sig = G.table(spark, d, "supplier").select(k.alias("k"), F.when(k % 11 != 0, F.col("s_acctbal")).alias("nir"), (F.col("s_acctbal") * (k % 7)).alias("swir"), (k % 13 * F.lit(1.0)).alias("lst"), F.lit(5.0).alias("nightlight"))
    z = composite.with_z(sig, ["nir", "swir", "lst", "nightlight"])
    return z.withColumn("composite", scoring.composite(*[F.col(f"z_{c}") for c in ("nir", "swir", "lst", "nightlight")]))


@query(f"WITH {_SIGNALS} SELECT k, round(z_nir, 6) AS z_nir, round(z_swir, 6) AS z_swir, round(z_lst, 6) AS z_lst, z_nightlight FROM z")
def q_zscore(spark, d):
    return _rounded(_composite(spark, d).select("k", "z_nir", "z_swir", "z_lst", "z_nightlight"))


@query(f"WITH {_SIGNALS} SELECT k, round(composite, 6) AS composite, CASE WHEN composite >= 1 THEN 'strong' WHEN composite >= 5e-1 THEN 'above average' WHEN composite > -5e-1 THEN 'near baseline' WHEN composite > -1 THEN 'below baseline' ELSE 'well below baseline' END AS band FROM c ORDER BY c.composite DESC, k LIMIT 5")
def q_composite_top5(spark, d):
    rows = composite.top(_composite(spark, d), 5, "composite", "k")
    return rows.select("k", F.round("composite", 6).alias("composite"), scoring.composite_band(F.col("composite")).alias("band"))


@query(f"WITH {_SIGNALS} SELECT round(avg(composite), 6) AS mean, round(max(composite), 6) AS max, round(min(composite), 6) AS min, count(composite) AS n FROM c")
def q_composite_summary(spark, d):
    return _rounded(composite.summary(_composite(spark, d), "composite"))


_PIX = "pix AS (SELECT user_id AS px, event_type AS band, value, ts, event_id % 12 AS scl, (event_id * 5) % 32 AS qa FROM events)"


def _pixels(spark, d):
    k = F.col("event_id")
    return G.table(spark, d, "events").select(F.col("user_id").alias("px"), F.col("event_type").alias("band"), "value", "ts", (k % 12).alias("scl"), (k * 5 % 32).alias("qa"))


@query(f"WITH {_PIX} SELECT px, band, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM pix WHERE scl NOT IN (1, 3, 8, 9, 10) GROUP BY px, band")
def q_median_composite(spark, d):
    rows = _pixels(spark, d).where(raster.clear_by_class(F.col("scl")))
    return _rounded(raster.median_composite(rows, ["px", "band"]))


@query(f"WITH {_PIX} SELECT band, round(sum(value::DECIMAL(18,4))::DOUBLE / count(*), 6) AS mean, count(*) AS n FROM pix WHERE qa & 8 = 0 AND qa & 16 = 0 GROUP BY band")
def q_masked_mean(spark, d):
    rows = _pixels(spark, d).where(raster.clear_by_bits(F.col("qa")))
    return rows.groupBy("band").agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("*"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {_PIX}, w AS (SELECT *, day(ts) % 3 = 0 AS cur, day(ts) % 3 = 1 AS base FROM pix), g AS (SELECT px % 40 AS city, band, quantile_cont(value, 0.5) FILTER (cur) AS a, quantile_cont(value, 0.5) FILTER (base) AS b, count(*) FILTER (cur) AS n_now, count(*) FILTER (base) AS n_before FROM w WHERE cur OR base GROUP BY 1, 2) SELECT city, band, n_now, n_before, round(a - b, 6) AS delta FROM g")
def q_baseline_delta(spark, d):
    rows = _pixels(spark, d).withColumn("city", F.col("px") % 40)
    out = raster.signal_delta(rows, ["city", "band"], F.dayofmonth("ts") % 3 == 0, F.dayofmonth("ts") % 3 == 1)
    return out.select("city", "band", "n_now", "n_before", F.round("delta", 6).alias("delta"))


_GRIDPIX = "g AS (SELECT py, px, sum(v) AS value FROM (SELECT (l_orderkey % 40) AS py, (l_partkey % 40) AS px, l_quantity * (1 + l_orderkey % 3) AS v FROM lineitem) GROUP BY py, px)"


def _grid_pixels(spark, d):
    rows = G.table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("py"), (F.col("l_partkey") % 40).alias("px"), (F.col("l_quantity") * (1 + F.col("l_orderkey") % 3)).alias("v"))
    return rows.groupBy("py", "px").agg(F.sum("v").alias("value"))


_DISC = "(VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) o(dy, dx)"


@query(f"WITH {_GRIDPIX}, f AS (SELECT a.py, a.px, any_value(a.value) AS value, avg(b.value) AS focal FROM g a, {_DISC}, g b WHERE b.py = a.py + dy AND b.px = a.px + dx GROUP BY a.py, a.px) SELECT py, px, round(focal, 6) AS focal, value - focal < -150 AS is_low FROM f")
def q_focal_anomaly(spark, d):
    return raster.anomaly(_grid_pixels(spark, d), 1, 150.0).select("py", "px", F.round("focal", 6).alias("focal"), "is_low")


@query(f"WITH {_GRIDPIX}, e AS (SELECT a.py, a.px, min(b.value) AS value FROM g a, {_DISC}, g b WHERE b.py = a.py + dy AND b.px = a.px + dx GROUP BY a.py, a.px) SELECT a.py, a.px, max(b.value) AS value FROM e a, {_DISC}, e b WHERE b.py = a.py + dy AND b.px = a.px + dx GROUP BY a.py, a.px")
def q_opening(spark, d):
    return raster.opening(_grid_pixels(spark, d), 1)


_SETPIX = "s AS (SELECT DISTINCT event_id * 7919 % 176 AS py, event_id * 104729 % 94 AS px FROM events WHERE event_id * 31 % 1000 >= 650)"


@query(f"""WITH RECURSIVE {_SETPIX}, n AS (SELECT py * 100 + px AS id, py, px FROM s), e AS (SELECT a.id AS a, b.id AS b FROM n a, n b WHERE abs(a.py - b.py) <= 1 AND abs(a.px - b.px) <= 1),
r AS (SELECT id, id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), m AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT root // 100 AS part_py, count(*) AS pixels FROM m GROUP BY root""")
def q_components(spark, d):
    rows = G.log(spark, d).where("score >= 0.65").select(F.col("iy").alias("py"), F.col("ix").alias("px"))
    return raster.connected_parts(rows).groupBy("part_py", "part_px").agg(F.count("*").alias("pixels")).select("part_py", "pixels")


_WC = "wc AS (SELECT l_partkey % 176 AS iy, l_suppkey % 94 AS ix, CASE WHEN l_linenumber % 5 = 0 THEN 50 ELSE 10 END AS cls FROM lineitem), fr AS (SELECT iy, ix, avg(CASE WHEN cls = 50 THEN 1e0 ELSE 0e0 END) AS fraction, count(*) AS n FROM wc GROUP BY iy, ix)"


def _fractions(spark, d):
    rows = G.table(spark, d, "lineitem").select((F.col("l_partkey") % 176).alias("iy"), (F.col("l_suppkey") % 94).alias("ix"), F.when(F.col("l_linenumber") % 5 == 0, 50).otherwise(10).alias("cls"))
    return raster.built_up(rows, ["iy", "ix"])


@query(f"WITH {_WC} SELECT iy, ix, round(fraction, 6) AS fraction, n FROM fr WHERE fraction >= 5e-2")
def q_builtup_keep(spark, d):
    return _fractions(spark, d).where(F.col("fraction") >= C.BUILT_UP_KEEP).select("iy", "ix", F.round("fraction", 6).alias("fraction"), "n")


@query(f"WITH {G.DET}, {_WC} SELECT ord, round(fraction, 6) AS fraction FROM det LEFT JOIN fr USING (iy, ix) WHERE tier = 'high' AND (fraction IS NULL OR fraction < 5e-2)")
def q_prefilter_recall(spark, d):
    high = G.det(spark, d).where("tier = 'high'").select("ord", "iy", "ix")
    return raster.dropped_by_prefilter(high, _fractions(spark, d), ["iy", "ix"]).select("ord", F.round("fraction", 6).alias("fraction"))


_W = "[" + ", ".join(f"{((i * 37) % 19 - 9)} / 10e0" for i in range(64)) + "]"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * {_W}[i]))"


def _weights():
    return F.array(*[F.lit(((i * 37) % 19 - 9) / 10.0) for i in range(64)])


@query(f"SELECT vec_id, round({_DOT} + 25e-2, 6) AS z, round(1 / (1 + exp(-({_DOT} + 25e-2))), 6) AS p FROM embeddings")
def q_linear_score(spark, d):
    e = G.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(scoring.dot(F.col("embedding"), _weights()) + 0.25, 6).alias("z"), F.round(scoring.linear_score(F.col("embedding"), _weights(), F.lit(0.25)), 6).alias("p"))


@query(f"SELECT vec_id, round(1 / (1 + exp(-(12544e-4 * ({_DOT} + 25e-2) + 4527e-4))), 6) AS p FROM embeddings")
def q_platt(spark, d):
    e = G.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(scoring.linear_score(F.col("embedding"), _weights(), F.lit(0.25), F.lit(1.2544), F.lit(0.4527)), 6).alias("p"))


_SWEEP = "SELECT threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif(tp / nullif(tp + fp, 0)::DOUBLE + tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM"
_COUNTS = "SELECT {t} AS threshold, count(*) FILTER (score >= {t} AND y = 1) AS tp, count(*) FILTER (score >= {t} AND y = 0) AS fp, count(*) FILTER (score < {t} AND y = 1) AS fn, count(*) FILTER (score < {t} AND y = 0) AS tn FROM scores"


@query(f"WITH {G.SCORES}, c AS ({_COUNTS.format(t='(i / 100e0)')}, range(101) r(i) GROUP BY i) {_SWEEP} c")
def q_sweep_101(spark, d):
    return _rounded(evaluate.sweep(G.scores(spark, d)))


@query(f"WITH {G.SCORES}, t AS (SELECT DISTINCT score AS th FROM scores), c AS ({_COUNTS.format(t='th')}, t GROUP BY th) {_SWEEP} c ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1")
def q_best_f1(spark, d):
    return _rounded(evaluate.best_f1(G.scores(spark, d)))


@query(f"WITH {G.SCORES}, c AS ({_COUNTS.format(t='0.85e0')}) SELECT * EXCLUDE (threshold) FROM ({_SWEEP} c)")
def q_prf_at(spark, d):
    return _rounded(evaluate.prf_at(G.scores(spark, d), 0.85))


@query(f"WITH {G.SCORES}, g AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scores GROUP BY score), c AS (SELECT score, sum(p) OVER w / (SELECT sum(p) FROM g) AS tpr, sum(n) OVER w / (SELECT sum(n) FROM g) AS fpr FROM g WINDOW w AS (ORDER BY score DESC)), l AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS fp0 FROM c) SELECT round(sum((fpr - fp0) * (tpr + tp0) / 2), 6) AS auc, count(*) AS points FROM l")
def q_roc_auc(spark, d):
    return _rounded(evaluate.roc_auc(G.scores(spark, d)))


@query(f"WITH {G.SCORES} SELECT least(floor(score * 10), 9)::INT AS bin, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS observed, count(*) AS n FROM scores GROUP BY 1")
def q_reliability(spark, d):
    return _rounded(evaluate.reliability(G.scores(spark, d)))


@query(f"WITH {G.SCORES} SELECT round(avg(pow(score - y, 2)), 6) AS brier, count(*) AS n FROM scores")
def q_brier(spark, d):
    return _rounded(evaluate.brier(G.scores(spark, d)))


@query(f"WITH {G.SCORES} SELECT src, max(score) AS max_score, round(avg(score), 6) AS mean_score, count(*) AS n, arg_min(y, ord) AS y FROM scores GROUP BY src")
def q_source_max(spark, d):
    return _rounded(evaluate.source_max(G.scores(spark, d)))


@query(f"WITH {G.SCORES}, s AS (SELECT src, arg_min(y, ord) AS y FROM scores GROUP BY src) SELECT src, y, (row_number() OVER (PARTITION BY y ORDER BY src) - 1) % 5 AS fold FROM s")
def q_folds(spark, d):
    return evaluate.folds(evaluate.source_max(G.scores(spark, d)).select("src", "y"))


@query("WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT grp, min(x) AS low, max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = n // 2) AS median, max(x) FILTER (i = 3 * n // 4) AS q3, max(x) AS high, count(*) AS n FROM r GROUP BY grp")
def q_five_num(spark, d):
    return evaluate.five_numbers(G.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), "grp", "l_extendedprice")


@query("SELECT l_linestatus AS band, l_returnflag AS inside, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1, 2")
def q_channel_stats(spark, d):
    p = lambda x: F.percentile("l_quantity", F.lit(x))
    return G.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("band"), F.col("l_returnflag").alias("inside")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_pop("l_quantity"), 6).alias("std"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"))


@query("""WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i), r AS (SELECT i, m FROM x WHERE label = 0),
s AS (SELECT label, sum(x.m * r.m) AS ab, sum(x.m * x.m) AS aa, sum(r.m * r.m) AS bb, sum(pow(x.m - r.m, 2)) AS dd FROM x JOIN r USING (i) WHERE label <> 0 GROUP BY label) SELECT label, round(1 - ab / sqrt(aa * bb), 6) AS cosine, round(sqrt(dd), 6) AS euclidean, CASE WHEN 1 - ab / sqrt(aa * bb) <= 5e-2 + 5e-3 THEN 'within-envelope' WHEN 1 - ab / sqrt(aa * bb) > 5e-2 + 3e-2 THEN 'severe-OOD' ELSE 'moderate-shift' END AS verdict FROM s""")
def q_centroid_shift(spark, d):
    rows = evaluate.centroid_shift(G.table(spark, d, "embeddings"), "label", "embedding", 0)
    return rows.select("label", F.round("cosine", 6).alias("cosine"), F.round("euclidean", 6).alias("euclidean"), scoring.shift_verdict(F.col("cosine"), F.lit(0.05)).alias("verdict"))


@query("""WITH s AS (SELECT vec_id, embedding, label = 0 AS a FROM embeddings WHERE label IN (0, 1)),
p AS (SELECT x.a AS ax, y.a AS ay, list_sum(list_transform(range(1, 65), lambda i: pow(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE, 2))) AS d2 FROM s x JOIN s y ON x.vec_id < y.vec_id), m AS (SELECT quantile_cont(d2, 0.5) AS med FROM p WHERE d2 > 0), k AS (SELECT ax, ay, exp(-d2 / med) AS k FROM p, m)
SELECT round(avg(k) FILTER (ax AND ay) + avg(k) FILTER (NOT ax AND NOT ay) - 2 * avg(k) FILTER (ax <> ay), 6) AS mmd2 FROM k""")
def q_mmd(spark, d):
    rows = G.table(spark, d, "embeddings").where("label in (0, 1)")
    return _rounded(model.mmd2(rows, F.col("label") == 0, "vec_id", "embedding"))


@query()
def q_fit_lr(spark, d):
    return model.fit_scores(G.table(spark, d, "embeddings").withColumn("y", (F.col("label") < 3).cast("double")), "vec_id", "embedding", "y")


@query()
def q_fit_isotonic(spark, d):
    return model.isotonic(G.scores(spark, d), "ord")


@query()
def q_loro(spark, d):
    e = G.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 2).cast("double").alias("y"), (F.col("vec_id") % 4).cast("string").alias("region"))
    return model.leave_one_out(e, "region", "vec_id", "embedding", "y")


@query()
def q_domain_auc(spark, d):
    e = G.table(spark, d, "embeddings").where("label in (0, 1)").withColumn("y", (F.col("label") == 1).cast("double"))
    return model.cross_validated_auc(e, "vec_id", "embedding", "y")


@query()
def q_platt_fit(spark, d):
    return model.platt_fit(G.scores(spark, d).withColumn("z", F.col("score")))


@query("SELECT source AS src, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(b.text) = lower(d.text)) GROUP BY source")
def q_holdout_antijoin(spark, d):
    """Documents whose whole text is no benchmark text, by source."""
    k = F.sha2(F.lower("text"), 256).alias("k")
    docs = G.table(spark, d, "documents").select(F.col("source").alias("src"), k)
    return docs.join(G.table(spark, d, "benchmark").select(k).distinct(), "k", "left_anti").groupBy("src").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT doc_id % 7 AS grp, CASE WHEN toxic = 1 THEN 'fp' ELSE 'tp' END AS label FROM labels), e AS (SELECT doc_id % 7 AS grp, count(*) AS expected FROM documents GROUP BY 1), g AS (SELECT grp, count(*) AS judged, count(*) FILTER (label = 'fp') AS fp FROM a GROUP BY grp) SELECT grp, expected, coalesce(judged, 0) AS judged, coalesce(fp, 0) AS fp, expected - coalesce(judged, 0) AS missing, round(fp / judged::DOUBLE, 6) AS fp_share, CASE WHEN fp / judged::DOUBLE >= 5e-2 THEN 'rollback' ELSE 'keep' END AS decision FROM e LEFT JOIN g USING (grp)")
def q_audit(spark, d):
    got = G.table(spark, d, "labels").select((F.col("doc_id") % 7).alias("grp"), F.when(F.col("toxic") == 1, "fp").otherwise("tp").alias("label"))
    return _rounded(evaluate.audit(got, G.table(spark, d, "documents").select((F.col("doc_id") % 7).alias("grp")), C.ROLLBACK_SHARE))


@query("SELECT p_partkey AS k, CASE WHEN b > 25 AND b < 140 AND bl - r > -25 AND bl - r < 60 THEN true ELSE false END AS panel, round(greatest(0e0, 1 - 5e-1 * abs(b - 70) / 60 - 5e-1 * abs(bl - r - 8) / 30), 6) AS score FROM (SELECT *, (r + g + bl) / 3 AS b FROM (SELECT p_partkey, (p_partkey * 7) % 200 * 1e0 AS r, (p_partkey * 11) % 200 * 1e0 AS g, (p_partkey * 13) % 200 * 1e0 AS bl FROM part))")
def q_panel_color(spark, d):
    k = F.col("p_partkey")
    r, g, b = ((k * m % 200 * F.lit(1.0)) for m in (7, 11, 13))
    return G.table(spark, d, "part").select(k.alias("k"), scoring.looks_like_panel(r, g, b).alias("panel"), F.round(scoring.panel_color_score(r, g, b), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN m[1] IS NULL OR m[1] = '' THEN 'ncr' ELSE m[1] END AS stratum FROM (SELECT doc_id, [regexp_extract(s, '^reg(?:pos|fp|ground)_(.*)_[^_]*$', 1)] AS m FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'regpos_' || source || '_0001' WHEN 1 THEN 'regfp_big_' || lang || '_2' ELSE source END AS s FROM documents))")
def q_stratum(spark, d):
    k = F.col("doc_id") % 3
    src = F.when(k == 0, F.concat(F.lit("regpos_"), F.col("source"), F.lit("_0001"))).when(k == 1, F.concat(F.lit("regfp_big_"), F.col("lang"), F.lit("_2"))).otherwise(F.col("source"))
    return G.table(spark, d, "documents").select("doc_id", text.stratum(src).alias("stratum"))


@query("SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    e = G.table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total")).select(F.col("window.start").alias("starts"), "event_type", "n", "total")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, k AS session, count(*) AS n, min(ts) AS starts, max(ts) AS ends FROM g GROUP BY 1, 2")
def ext_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    rows = G.table(spark, d, "events").withColumn("new", (before.isNull() | (F.col("ts") > before + F.expr("interval 30 minutes"))).cast("long"))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("starts"), F.max("ts").alias("ends"))


@query(f"WITH {G.LOG} SELECT count(*) AS n, count(*) FILTER (NOT fetch_ok) AS failed, count(*) FILTER (NOT fetch_ok) > 2e-1 * count(*) AS degraded FROM log")
def q_gate_degraded(spark, d):
    bad = F.count_if(~F.col("fetch_ok"))
    return G.log(spark, d).agg(F.count("*").alias("n"), bad.alias("failed"), (bad > F.lit(C.DEGRADED_SHARE) * F.count("*")).alias("degraded"))


@query("SELECT s_suppkey AS k, rule FROM (SELECT s_suppkey, unnest(list_filter([CASE WHEN s_suppkey % 17 = 0 THEN 'no name' END, CASE WHEN s_suppkey % 13 = 0 THEN 'z isn''t finite' END, CASE WHEN s_suppkey % 13 <> 0 AND abs(s_acctbal / 1000) > 5 THEN 'z out of bounds' END], lambda x: x IS NOT NULL)) AS rule FROM supplier)")
def q_gate_quarter(spark, d):
    k = F.col("s_suppkey")
    rows = G.table(spark, d, "supplier").select(k.alias("k"), F.when(k % 17 != 0, F.col("s_name")).alias("name"), F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal") / 1000).alias("z"))
    return gates.violations(rows, "k", gates.quarter_rules(["z"]))


@query("SELECT DISTINCT printf('N%02dE%03d', floor(lat / 3)::INT * 3, floor(lon / 3)::INT * 3) AS raster_tile FROM (SELECT 45e-1 + event_id % 15 AS lat, 1165e-1 + event_id % 11 AS lon FROM events)")
def q_raster_tiles(spark, d):
    k = F.col("event_id")
    return G.table(spark, d, "events").select(geo.raster_tile(F.lit(4.5) + k % 15, F.lit(116.5) + k % 11).alias("raster_tile")).distinct()
