"""Published tables in versions: a table is written beside the last one, checked, and then named as the current one.

A version is a folder of JSON Lines with a _meta object beside it. Readers follow one small file, which is replaced as a
whole, so they see the last version until the next one is complete; a write that fails at any step leaves them there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CURRENT = "_current"


def _path(spark: SparkSession, path: str):
    """(file system, Hadoop path)."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """The file in one step: under another name first, then renamed over the old one."""
    fs, at = _path(spark, path)
    own = _path(spark, f"{path}-{uuid.uuid4().hex}")[1]
    out = fs.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(own), fs.makeQualified(at), options)


def write_version(df: DataFrame, path: str, name: str, order: list) -> int:
    """The rows as JSON Lines in a total order over the files; their number, as counted while they were written."""
    seen = Observation()
    df.repartitionByRange(*order).sortWithinPartitions(*order).observe(seen, F.count("*").alias("n")).write.json(f"{path}/{name}/rows")
    return seen.get["n"]


def check_version(spark: SparkSession, path: str, name: str, schema: str, n: int) -> None:
    found = spark.read.schema(schema).json(f"{path}/{name}/rows").count()
    if found != n:
        raise ValueError(f"{path}/{name}: {found} of {n} rows can be read")


def publish(df: DataFrame, path: str, order: list, meta: dict | None = None, name: str | None = None) -> str:
    """Writes df as the next version of the table at path and makes it the current one; its name.

    order: columns that give a total order. meta goes into the version's _meta, with the number of rows and the version
    that was current before. df may come from the current version (a rewrite with more columns, say): that one stays as it is.
    """
    spark, name = df.sparkSession, name or f"v-{uuid.uuid4().hex}"
    last = current(spark, path)
    n = write_version(df, path, name, order)
    check_version(spark, path, name, df._jdf.schema().toDDL(), n)
    _write(spark, f"{path}/{name}/_meta.json", json.dumps({**(meta or {}), "count": n, "before": last, "schema": df._jdf.schema().toDDL()}, sort_keys=True))
    _write(spark, f"{path}/{CURRENT}", name)
    return name


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version, if there is one."""
    return _read(spark, f"{path}/{CURRENT}")


def meta(spark: SparkSession, path: str, name: str | None = None) -> dict:
    return json.loads(_read(spark, f"{path}/{name or current(spark, path)}/_meta.json") or "{}")


def read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The rows of the current version, or of an earlier one by its name."""
    name = name or current(spark, path)
    if name is None:
        raise FileNotFoundError(f"{path} has no current version")
    return spark.read.schema(meta(spark, path, name)["schema"]).json(f"{path}/{name}/rows")


def write_split(df: DataFrame, keep: Column, path: str) -> dict[str, int]:
    """Rows that are kept and rows that aren't in one pass over df, under path/kept=true and path/kept=false; how many there are of each.

    A null condition keeps nothing. The counts come from the write itself.
    """
    seen = Observation()
    rows = df.withColumn("kept", F.coalesce(keep, F.lit(False)))
    rows.observe(seen, F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped")).write.partitionBy("kept").parquet(path)
    return {k: seen.get[k] for k in ("kept", "skipped")}


def planned(df: DataFrame, keep: Column) -> dict[str, int]:
    """What write_split would count, without writing."""
    hit = F.coalesce(keep, F.lit(False))
    return df.agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("skipped")).first().asDict()


def split_side(spark: SparkSession, path: str, schema: str, kept: bool) -> DataFrame:
    """One side of what write_split wrote; the schema is that of the rows, so that a side without rows can be read."""
    return spark.read.schema(f"{schema}, kept boolean").parquet(path).where(F.col("kept") == kept).drop("kept")
