"""Standardised signals and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_z(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with z_<column>: against the sample deviation of all values that aren't null.

    Fewer than two values give null; no variance gives 0, for rows without a value as well. The statistics are one row,
    joined to all.
    """
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("n", F.count), ("avg", F.avg), ("sd", F.stddev_samp))])
    both = rows.crossJoin(F.broadcast(stats))
    z = lambda c: F.when(F.col(f"_n_{c}") < 2, None).when(F.col(f"_sd_{c}") <= 0, 0.0).otherwise((F.col(c) - F.col(f"_avg_{c}")) / F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)))
    return both.select(*rows.columns, *[z(c).alias(f"z_{c}") for c in columns])


def summary(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.min(column).alias("min"), F.count(column).alias("n"))


def top(rows: DataFrame, k: int, column: str, tie: str, descending: bool = True) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), tie).limit(k)


def min_max(rows: DataFrame, column: str) -> DataFrame:
    lo_hi = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled: Column = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return rows.crossJoin(F.broadcast(lo_hi)).withColumn(f"{column}_scaled", scaled).drop("_lo", "_hi")
