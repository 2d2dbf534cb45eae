"""Scan logs as a stream: records once per tile, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.functions import scoring
from tilewise.sources.readers import SCAN


def scan_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Records of JSON Lines files as they arrive; malformed lines come out with a null tile_id and are left out."""
    rows = spark.readStream.schema(SCAN + ", ts timestamp").option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.where("tile_id is not null")


def once_per_tile(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The first record of each tile; state older than `late` is let go, so a tile may come again after that."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tile_id"])


def tier_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by tier and time window, closed once the watermark has passed."""
    tier = F.coalesce(scoring.tier(F.col("score")), F.lit("below"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), tier.alias("tier")).agg(F.count("*").alias("n"))


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, each record exactly once across restarts; processes what is there and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, floor: float | None = None):
    """Keeps the last record of each tile under path, batch by batch; processes what is there and stops.

    A batch is written to a folder of its own, named by its number, in place of what may be there from an attempt that
    didn't end: a batch that comes again changes nothing. Records below the floor aren't kept, so that their tiles are
    scored again; a tile's record within a batch is the last by ts, then the highest score.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch if floor is None else batch.where(F.col("score") >= floor)
        last = rows.where("tile_id is not null").groupBy("tile_id").agg(F.max(F.struct("ts", "score", F.struct(*batch.columns).alias("r"))).alias("x")).select("x.r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema: str = SCAN + ", ts timestamp") -> DataFrame:
    """What upsert_stream keeps: each tile's record of the latest batch that has one, with that batch's number."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    columns = [c for c in rows.columns if c != "tile_id"]
    return rows.groupBy("tile_id").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("tile_id", "r.*")
