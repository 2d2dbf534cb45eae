"""Helpers of the operators: written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000


_local: list[str] = []
_written: list = []


def _shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own on a local master."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tilewise-"))
    return _local[0]


def new_path(spark: SparkSession, what: str = "rows") -> str:
    """A path in the shared folder that no other call gets; it goes with release()."""
    path = f"{_shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append(lambda: hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True))
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again, so that its size is that of its files and no executor is needed for it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Deletes what was written so far; DataFrames that read it can't be used any more."""
    while _written:
        try:
            _written.pop()()
        except Exception:  # noqa: BLE001  the JVM is gone; a folder of our own goes below
            continue
    while _local:
        shutil.rmtree(_local.pop(), ignore_errors=True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows; it is counted, so it should be cheap or written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order, which has to be total for a defined result."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with running sums (name -> column) in the given order, up to and with each row.

    Rows are range-partitioned by the order and summed within partitions; the partitions' totals, one row each, give what
    lies before them. No task sees all rows.
    """
    ranged = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumns({"_pid": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    here = Window.partitionBy("_pid").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(F.broadcast(offsets), "_pid")  # one row per partition
    return rows.select(*df.columns, *[(F.sum(f"_v_{n}").over(here) + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list, name: str = "row") -> DataFrame:
    """df with the place of each row, from 1, in a total order."""
    return running(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def numbered_within(df: DataFrame, group: str, order: list, name: str = "row", size: str = "size") -> DataFrame:
    """df with the place of each row, from 1, in a total order within its group, and the group's size; of groups there are few, of any size."""
    rows = numbered(df, [F.col(group), *order], "_at")
    groups = sized(rows.groupBy(F.col(group).alias("_group")).agg((F.min("_at") - 1).alias("_before"), F.count("*").alias(size)))
    return rows.join(groups, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_at") - F.col("_before")).select(*df.columns, name, size)
