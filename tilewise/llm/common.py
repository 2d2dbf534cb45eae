"""What the operators of this subpackage share: the shared folder, written tables and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many rows of at most this width.
BROADCAST_ROWS, BROADCAST_ROW_BYTES = 400_000, 64
#: The words of the contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

_local: list[str] = []
_written: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tilewise-")
        _local.append(found)
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets; it goes with release(), at the latest when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, conf = hadoop.getFileSystem, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            fs(conf).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            if (p := urlparse(path)).scheme in ("", "file"):
                shutil.rmtree(p.path, ignore_errors=True)

    _written.append(drop)
    return path


@atexit.register
def release() -> None:
    """Deletes all tables that this driver has written so far; DataFrames that read them can't be used any more."""
    while _written:
        _written.pop()()


@atexit.register
def _drop_local() -> None:
    for p in _local:
        shutil.rmtree(p, ignore_errors=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder: later reads need no executor that made it."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() wrote, before release() would; df, and what was made of it and not stored, can't be used any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored df with a broadcast hint if its count permits; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def key_uniform(*cols, seed: int = 0):
    """A number in [0, 1) that follows from the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") * F.lit(2.0**-53)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
