"""Gates: queries that return one row per violation, and checks that refuse to publish."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise import config as C


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null isn't broken."""
    broken = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def quarter_rules(metrics: list[str]) -> dict[str, Column]:
    out = {"no name": F.col("name").isNull() | (F.col("name") == "")}
    for m in metrics:
        out |= {f"{m} isn't finite": not_finite(F.col(m)), f"{m} out of bounds": ~not_finite(F.col(m)) & (F.abs(F.col(m)) > C.Z_BOUND)}
    return out


def building_rules() -> dict[str, Column]:
    ring = F.col("ring")
    return {
        "ring too short": F.size(ring) < 4, "ring isn't closed": (F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), "no area": F.col("footprint_m2") <= 0,
        "panel over footprint": F.col("panel_m2") > F.col("footprint_m2") + 1, "confidence": (F.col("confidence") < 0) | (F.col("confidence") > 1), "no segment": F.col("n_segments") < 1,
    }


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def residential_leaks(buildings: DataFrame) -> DataFrame:
    return buildings.where(F.coalesce(F.col("is_residential"), F.lit(False)) | F.coalesce(F.col("building_type").isin(*C.RESIDENTIAL), F.lit(False)))


def private_keys(features: DataFrame, key: str, properties: str) -> DataFrame:
    """Features whose properties (JSON text) have keys that may not be published."""
    found = F.array_intersect(F.json_object_keys(F.col(properties)), F.array(*map(F.lit, C.PRIVATE_KEYS)))
    return features.select(key, F.explode(found).alias("private_key"))


def tariff_rules() -> dict[str, Column]:
    return {
        "month": ~F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "rate out of range": ~F.col("rate").between(1.0, 50.0),
        "band": (F.col("low") > F.col("mid")) | (F.col("mid") > F.col("high")),
    }


def refuse_degraded(log: DataFrame, share: float = C.DEGRADED_SHARE) -> DataFrame:
    """log, if no more than this share of its records failed; else an error."""
    n, bad = log.agg(F.count("*"), F.count_if(~F.coalesce(F.col("fetch_ok"), F.lit(False)))).first()
    if n and bad / n > share:
        raise ValueError(f"{bad} of {n} records failed")
    return log


#: Bytes of a file that are read at once.
RANGE = 8 << 20


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """file (relative to path), length, sha256 of every file below a folder; content is read by tasks, range by range."""
    from pyarrow import fs

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                where, at = fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with where.open_input_stream(at) as f:
                    while part := f.read(RANGE):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], names=["path", "length", "sha256"])

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, entries = [], where.listFiles(root, True)  # names and lengths alone; Spark's own file sources leave out empty files
    while entries.hasNext():
        entry = entries.next()
        files.append((re.sub(r"^file:/+", "file:///", entry.getPath().toString()), entry.getLen()))
    rows = spark.createDataFrame(files, "path string, length long").mapInArrow(hashed, "path string, length long, sha256 string")
    top = re.escape(root.toUri().getPath().rstrip("/"))
    return rows.select(F.regexp_extract("path", f"{top}/(.*)$", 1).alias("file"), "length", "sha256")


def compare_folders(spark: SparkSession, one: str, other: str) -> DataFrame:
    """file, rule of each file that isn't the same in both: missing (in other), extra (not in one) or different."""
    a, b = file_sums(spark, one), file_sums(spark, other)
    both = a.alias("a").join(b.alias("b"), "file", "full_outer")
    rule = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "extra").when(F.col("a.sha256") != F.col("b.sha256"), "different")
    return both.select("file", rule.alias("rule")).where("rule is not null")


def release(spark: SparkSession, folder: str, expected: DataFrame, mirror: str | None = None) -> DataFrame:
    """file, rule of everything that keeps a folder from being released; no row means that it may be.

    expected: file, sha256 (a pin; null: any content), at_least (bytes; null: one). Files are missing, too short or not what
    they are pinned to; and, where a mirror is given, missing there, extra there or different.
    """
    found = file_sums(spark, folder)
    met = expected.alias("e").join(found.alias("f"), "file", "left")
    rules = {"missing": F.col("f.sha256").isNull(), "too short": F.col("f.length") < F.coalesce(F.col("e.at_least"), F.lit(1)), "not as pinned": F.col("f.sha256") != F.col("e.sha256")}
    out = violations(met, "file", rules)
    if mirror:
        out = out.unionByName(compare_folders(spark, folder, mirror).select("file", F.concat(F.lit("mirror: "), "rule").alias("rule")))
    return out
