"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each step looks only at what the step before left in a group of two or more; whole texts are hashed for those alone.
Text never crosses a shuffle: the groups are counted over (length), (length, prefix hash) and (length, prefix hash,
whole hash), with partial sums on the map side, and the last, small table of groups is joined back.

Defined results: a null text counts as empty; texts are compared byte by byte, with no change; a null id loses to any
other id; rows that repeat both id and text belong to one group, and `drop_copies` keeps one of them; an empty table
gives an empty one; other columns, whatever their names, are carried by `drop_copies` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored, table

#: Characters that the middle step hashes.
PREFIX = 128
KEYS = ["_len", "_prefix", "_full"]


def _steps(docs: DataFrame, text: str, id_col: str, prefix: int) -> tuple[DataFrame, DataFrame]:
    """(documents that may have copies: id and keys; groups: keys, keep_id, group_size, ties)."""
    body: Column = F.coalesce(F.col(text), F.lit(""))
    # 1. by length
    lengths = stored(docs.groupBy(F.octet_length(body).alias("_len")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "lengths")
    left = docs.select(F.col(id_col).alias("_id"), body.alias("_text")).withColumn("_len", F.octet_length("_text"))
    left = left.join(sized(lengths), "_len", "left_semi")
    # 2. by length and prefix
    left = left.withColumn("_prefix", F.xxhash64(F.substring("_text", 1, prefix)))
    prefixes = stored(left.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "prefixes")
    left = left.join(sized(prefixes), ["_len", "_prefix"], "left_semi")
    # 3. the whole text, for the rows that are left
    left = stored(left.select("_id", "_len", "_prefix", F.sha2(F.encode("_text", "UTF-8"), 256).alias("_full")), "hashes")
    groups = (
        left.groupBy(*KEYS, "_id").agg(F.count("*").alias("_n"))
        .groupBy(*KEYS).agg(F.max(F.struct("_id", "_n")).alias("_top"), F.sum("_n").alias("group_size")).where("group_size > 1")
        .select(*KEYS, F.col("_top._id").alias("keep_id"), "group_size", F.col("_top._n").alias("ties"))
    )
    return left, stored(groups, "groups")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """Groups of two or more equal texts: length, prefix hash, sha256, keep_id (largest id), group_size, ties (rows with that id)."""
    return _steps(docs, text, id_col, prefix)[1].toDF("n_bytes", "prefix_hash", "text_sha256", "keep_id", "group_size", "ties")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256; a document alone keeps itself."""
    groups = exact_groups(docs, text, id_col, prefix)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), F.octet_length(body).alias("n_bytes"), F.xxhash64(F.substring(body, 1, prefix)).alias("prefix_hash"), F.sha2(F.encode(body, "UTF-8"), 256).alias("text_sha256"))
    rows = rows.join(sized(groups.drop("ties"), 100_000), ["n_bytes", "prefix_hash", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return rows.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", prefix: int = PREFIX) -> DataFrame:
    """The rows of docs without copies: of equal texts the row with the largest id stays, with all its columns."""
    names, groups = docs.columns, exact_groups(docs, text, id_col, prefix)
    body = F.coalesce(F.col(text), F.lit(""))
    keys = groups.select(F.col("n_bytes").alias("_len"), F.col("prefix_hash").alias("_prefix"), F.col("text_sha256").alias("_full"), F.col("keep_id").alias("_keep"), F.col("ties").alias("_ties"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.octet_length(body).alias("_len"), F.xxhash64(F.substring(body, 1, prefix)).alias("_prefix"))
    rows = rows.withColumn("_full", F.sha2(F.encode(F.coalesce(F.col("_row").getField(text), F.lit("")), "UTF-8"), 256))
    rows = rows.join(sized(keys, 100_000), KEYS, "left").where(F.col("_ties").isNull() | F.col("_row").getField(id_col).eqNullSafe(F.col("_keep")))
    # repeated rows: one of those with the largest id, chosen by their other columns
    once = rows.where("_ties is null or _ties = 1").select("_row.*")
    if groups.where("ties > 1").isEmpty():
        return once
    again = rows.where("_ties > 1").groupBy(*KEYS).agg(F.max_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return once.unionByName(again)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
