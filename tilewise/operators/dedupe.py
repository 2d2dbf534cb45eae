"""Dedupe by key, by rounded place and by source, and set operations on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise import config as C

from .shared import first_per


def keep_first(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    return first_per(df, [key], [F.col(ord_col)])


def keep_last(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    return first_per(df, [key], [F.desc(ord_col)])


def scored(log: DataFrame) -> DataFrame:
    """Records of a scan that were fetched and have a score."""
    return log.where(F.col("fetch_ok") & F.col("score").isNotNull())


def by_place(df: DataFrame, ord_col: str, digits: int) -> DataFrame:
    """The first row of each rounded (lat, lon)."""
    place = lambda c: F.floor(F.col(c) * 10**digits + 0.5)
    return first_per(df.withColumns({"_y": place("lat"), "_x": place("lon")}), ["_y", "_x"], [F.col(ord_col)]).drop("_y", "_x")


def by_priority(parts: list[tuple[str, DataFrame]], key: str, ord_col: str) -> DataFrame:
    """One row per key out of several sources, the earlier source first; adds source."""
    tagged = [df.withColumns({"source": F.lit(name), "_p": F.lit(i)}) for i, (name, df) in enumerate(parts)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return first_per(union, [key], [F.col("_p"), F.col(ord_col)]).drop("_p")


def set_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key of either side once: kept, dropped or added."""
    sides = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    return sides.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n")).select(key, F.when(F.expr("o + n = 2"), "kept").when(F.col("o") == 1, "dropped").otherwise("added").alias("change"))


def version_delta(old: DataFrame, new: DataFrame, tier_of) -> DataFrame:
    """tile_id, old_score, new_score, gain of the tiles of both whose tier changed."""
    both = old.select("tile_id", F.col("score").alias("old_score")).join(new.select("tile_id", F.col("score").alias("new_score")), "tile_id")
    both = both.withColumns({"old_tier": tier_of(F.col("old_score")), "new_tier": tier_of(F.col("new_score")), "gain": F.col("new_score") - F.col("old_score")})
    return both.where("old_tier <> new_tier")


def newly_promoted(old: DataFrame, new: DataFrame) -> DataFrame:
    """High tiles of new that weren't high, or weren't there, in old."""
    both = new.where(F.col("score") >= C.HIGH).join(old.select("tile_id", F.col("score").alias("old_score")), "tile_id", "left")
    return both.where(F.coalesce("old_score", F.lit(0.0)) < C.HIGH)


def dedupe_grouped(df: DataFrame, keys: list[Column], ord_col: str) -> DataFrame:
    return first_per(df, keys, [F.col(ord_col)])
