"""Pixel tables: composites over time, masks, neighbourhoods and connected parts.

A pixel table has one row per scene, pixel and band (py, px, ...); neighbourhood operators take one row per pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise import config as C

from .links import components
from .shared import cut_lineage, sized


def median_composite(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def clear_by_class(scl: Column) -> Column:
    return ~scl.isin(*C.CLOUD_CLASSES)


def clear_by_bits(qa: Column) -> Column:
    mask = sum(1 << b for b in C.CLOUD_BITS)
    return qa.bitwiseAND(F.lit(mask)) == 0


def signal_delta(pixels: DataFrame, keys: list[str], current: Column, baseline: Column, value: str = "value") -> DataFrame:
    """Median of the current window less that of the baseline window; null if either has no scene."""
    med = lambda w: F.percentile(F.when(w, F.col(value)), F.lit(0.5))
    rows = pixels.where(current | baseline).groupBy(*keys).agg(med(current).alias("now"), med(baseline).alias("before"), F.count_if(current).alias("n_now"), F.count_if(baseline).alias("n_before"))
    return rows.withColumn("delta", F.when((F.col("n_now") > 0) & (F.col("n_before") > 0), F.col("now") - F.col("before")))


def built_up(pixels: DataFrame, keys: list[str], cls: str = "cls") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.when(F.col(cls) == C.BUILT_UP_CLASS, 1.0).otherwise(0.0)).alias("fraction"), F.count("*").alias("n"))


def dropped_by_prefilter(tiles: DataFrame, fractions: DataFrame, keys: list[str], keep: float = C.BUILT_UP_KEEP) -> DataFrame:
    """Tiles that the built-up filter would lose: below the cut, or not in it at all."""
    rows = tiles.join(fractions.select(*keys, "fraction"), keys, "left")
    return rows.where(F.col("fraction").isNull() | (F.col("fraction") < keep))


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def focal(pixels: DataFrame, radius: int, agg, value: str = "value") -> DataFrame:
    """agg over the disc around each pixel that exists: each pixel is sent to its neighbours' places and summed up there."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(radius)])
    sent = pixels.select("py", "px", F.col(value).alias("v"), F.explode(offsets).alias("o")).select((F.col("py") + F.col("o.dy")).alias("py"), (F.col("px") + F.col("o.dx")).alias("px"), "v")
    return pixels.join(sent.groupBy("py", "px").agg(agg("v").alias("focal")), ["py", "px"])


def anomaly(pixels: DataFrame, radius: int, below: float) -> DataFrame:
    """Pixels that lie under the mean of their disc by more than `below`."""
    rows = focal(pixels, radius, F.avg)
    return rows.withColumn("is_low", F.col("value") - F.col("focal") < -below)


def opening(pixels: DataFrame, radius: int) -> DataFrame:
    """Erosion, then dilation."""
    eroded = focal(pixels, radius, F.min).select("py", "px", F.col("focal").alias("value"))
    return focal(eroded, radius, F.max).select("py", "px", F.col("focal").alias("value"))


def _label_block(block: pd.DataFrame) -> pd.DataFrame:
    """part_py, part_px of each pixel: the first pixel of its part within the block."""
    block = block.sort_values(["py", "px"], ignore_index=True)
    y, x = block["py"].to_numpy(), block["px"].to_numpy()
    new = np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1))[: len(y)]
    at = np.flatnonzero(new)  # the runs of pixels in a row, in order
    row, lo, hi = y[at].tolist(), x[at].tolist(), x[np.append(at[1:], len(y)) - 1].tolist()
    parent = list(range(len(at)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    above = 0
    for i in range(len(at)):
        while above < i and (row[above] < row[i] - 1 or row[above] == row[i] - 1 and hi[above] < lo[i] - 1):
            above += 1
        j = above
        while j < i and row[j] == row[i] - 1 and lo[j] <= hi[i] + 1:
            one, two = find(i), find(j)
            parent[max(one, two)] = min(one, two)
            j += 1
    first = at[np.array([find(i) for i in range(len(at))], np.int64)][np.cumsum(new) - 1]
    return block.assign(part_py=y[first], part_px=x[first])


def connected_parts(pixels: DataFrame, block: int = 256) -> DataFrame:
    """py, px, part_py, part_px of the set pixels (py, px), joined over sides and corners; a part is named by its first pixel.

    Squares of block x block pixels are labelled in tasks of their own, whatever a part's size; then the labels that touch
    over the edge of a square are joined as links between labels. Coordinates are within 32 bits; a pixel with a null one is in no part.
    """
    square = [F.floor(F.col(c) / block).cast("long").alias(f"_{c}") for c in ("py", "px")]
    rows = pixels.select(F.col("py").cast("long"), F.col("px").cast("long")).where("py is not null and px is not null").distinct().select("py", "px", *square)
    labelled = cut_lineage(rows.groupBy("_py", "_px").applyInPandas(_label_block, "py long, px long, _py long, _px long, part_py long, part_px long").select("py", "px", "part_py", "part_px"))
    name = F.shiftleft("part_py", 32) + F.col("part_px") + (1 << 31)  # in the order of (part_py, part_px)
    place = lambda c: F.pmod(c, F.lit(block))
    rim = labelled.where(place("py").isin(0, block - 1) | place("px").isin(0, block - 1)).withColumn("part", name)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = rim.select("py", "px", F.col("part").alias("a"), F.explode(steps).alias("s")).select((F.col("py") + F.col("s.dy")).alias("py"), (F.col("px") + F.col("s.dx")).alias("px"), "a")
    links = sent.join(rim.select("py", "px", F.col("part").alias("b")), ["py", "px"]).where("a <> b").select("a", "b").distinct()
    named = labelled.withColumn("node", name).join(sized(components(links)), "node", "left").withColumn("part", F.coalesce("component", "node"))
    return named.select("py", "px", F.shiftright("part", 32).alias("part_py"), (F.col("part").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).alias("part_px"))


def largest_parts(parts: DataFrame, low: int, high: int, top: int) -> DataFrame:
    """Parts with more than low and fewer than high pixels: size and centre of the largest."""
    rows = parts.groupBy("part_py", "part_px").agg(F.count("*").alias("pixels"), F.avg("py").alias("cy"), F.avg("px").alias("cx")).where((F.col("pixels") > low) & (F.col("pixels") < high))
    return rows.orderBy(F.desc("pixels"), "part_py", "part_px").limit(top)


def fingerprint(pixels: DataFrame, keys: list[str], nir: float = -250.0, swir: float = -250.0) -> DataFrame:
    """keys of the built-up pixels (keys, band, delta, built) whose nir and swir both fell by more than that; one band alone says little."""
    wide = pixels.where("built").groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("delta"))).alias(b) for b in ("nir", "swir")])
    return wide.where((F.col("nir") < nir) & (F.col("swir") < swir))
