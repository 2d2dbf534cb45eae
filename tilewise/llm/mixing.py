"""Mixing sources to target weights, with DataFrame functions alone.

Words are summed per source, each source gets a target and a rate (target over size), and each document is emitted
floor(rate) times plus once more if a number that follows from a hash of seed and document lies below the fraction.

Targets share `budget` times all words by weight; none exceeds `cap` times its source's words, and what is over goes to
the others by weight until none exceeds. That fixed point is one water level: with the sources in order of cap over
weight, the first k are full and the others get level times weight. It is found with running sums over one row per source.

Defined results: null texts have no words; the null source is a source of its own, after all others; a source without
words gets the target 0 and its documents one copy or none by the rate 0 (none); an empty table gives an empty one;
repeated rows share one draw; other columns are carried by `mix` and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, key_uniform, sized, stored, table

WEIGHTS, BUDGET, CAP, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 7


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size (a row per source). Adds weight, target and rate; weights repeat over the sources by code point, null last."""
    # The windows below run over one row per source, never over documents.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    limit = F.lit(float(cap)) * F.col("source_size")
    by_room = Window.orderBy(F.col("room"), F.col("source").isNull(), F.col("source"))
    before, every = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        weighed.withColumn("limit", limit).withColumn("room", F.col("limit") / F.col("weight"))
        .withColumn("wanted", F.least(F.lit(float(budget)) * F.sum("source_size").over(every), F.sum("limit").over(every)))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        # the first source, in order of room, that the level of the rest doesn't fill
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(every)["level"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"))


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """_row (all columns of docs), size, source_size, target, copies: a row per document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    body, name = F.col("_row").getField(text), F.col("_row").getField(source)
    # salted partial sums aren't needed: the map side sums each source before the shuffle
    sizes = rows.groupBy(name.alias("source")).agg(F.sum(n_words(body)).alias("source_size"))
    plan = sized(stored(source_targets(sizes, weights, budget, cap), "rates").withColumnRenamed("source", "_source"))
    draw = key_uniform(F.col("_row").getField(id_col), name, body, seed=seed)
    whole = F.floor(F.col("rate"))
    joined = rows.join(plan, name.eqNullSafe(F.col("_source")), "left")
    return joined.select("_row", n_words(body).alias("size"), "source_size", "target", (whole + (draw < F.col("rate") - whole).cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mixture takes it."""
    rows = with_copies(docs, **options).where("copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_copies(table(spark, sf_dir, "documents")).select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
