"""Writers: feature collections, counts, manifests and CSV, in files that can be re-read by any tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_features(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One JSON text per row: a GeoJSON feature whose properties are the other columns."""
    props = F.struct(*[F.col(c) for c in df.columns if c not in (lon, lat)])
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value"))


def write_features(df: DataFrame, path: str, **names) -> None:
    """A folder of GeoJSON Lines, written by all tasks."""
    point_features(df, **names).write.mode("overwrite").text(path)


#: Features of a layer in one value.
MOST_FEATURES = 200_000


def feature_collection(df: DataFrame, meta: dict, most: int = MOST_FEATURES, **names) -> DataFrame:
    """A published layer as one JSON text with a _meta object. For layers made for a browser: it is one value, so more features than `most` are an error.

    Larger layers go to write_features or versions.publish, which all tasks write.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a layer of more than {most} features is no single value; write it with write_features")
    features = point_features(df, **names).agg(F.array_sort(F.collect_list("value")).alias("f"))
    head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], F.size("f").alias("count")))
    return features.select(F.concat(F.lit('{"type":"FeatureCollection","_meta":'), head, F.lit(',"features":['), F.array_join("f", ","), F.lit("]}")).alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
