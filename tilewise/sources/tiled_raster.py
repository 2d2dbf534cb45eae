"""Rasters as files of square tiles, read through a Python data source that opens only what filters leave.

A tile is one file, <path>/<band>/y<row>_x<column>.npy, an array of tile x tile values in which NaN is no pixel. Tasks
write them, each under a name of its own first, so a repeated task changes nothing. The source has a partition for each
file; filters on band, ty and tx (tile row and column) and on py and px reach it before any file is opened.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

TILE = 256
ROWS = "band string, ty int, tx int, py long, px long, value double, error string"


def _file_system(path: str):
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def write_tiles(pixels: DataFrame, path: str, tile: int = TILE) -> DataFrame:
    """Writes pixels (band, py, px, value; one row a pixel and band) and returns what was written: band, ty, tx, n."""

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        band, ty, tx = key
        grid = np.full((tile, tile), np.nan)
        grid[rows["py"].to_numpy() - ty * tile, rows["px"].to_numpy() - tx * tile] = rows["value"].to_numpy()
        where, folder = _file_system(f"{path}/{band}")
        where.create_dir(folder, recursive=True)
        name, own = f"{folder}/y{ty}_x{tx}.npy", f"{folder}/_{uuid.uuid4().hex}"
        with where.open_output_stream(own) as f:
            np.save(f, grid)
        where.move(own, name)
        return pd.DataFrame({"band": [band], "ty": [ty], "tx": [tx], "n": [len(rows)]})

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = pixels.where("py is not null and px is not null and value is not null").select(F.col("band").cast("string").alias("band"), F.col("py").cast("long"), F.col("px").cast("long"), F.col("value").cast("double"), at("py").alias("ty"), at("px").alias("tx"))
    return rows.groupBy("band", "ty", "tx").applyInPandas(put, "band string, ty int, tx int, n long")


class TilePartition(InputPartition):
    def __init__(self, band: str, ty: int, tx: int, file: str):
        self.band, self.ty, self.tx, self.file = band, ty, tx, file


class TileReader(DataSourceReader):
    def __init__(self, path: str, tile: int):
        self.path, self.tile, self.filters = path, tile, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """All filters are applied to the rows as well; those that are understood here choose the files."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in {(c,) for c in ("band", "ty", "tx", "py", "px")}:
                self.filters.append(f)
            yield f

    def _wanted(self, band: str, ty: int, tx: int) -> bool:
        spans = {"band": (band, band), "ty": (ty, ty), "tx": (tx, tx), "py": (ty * self.tile, (ty + 1) * self.tile - 1), "px": (tx * self.tile, (tx + 1) * self.tile - 1)}
        for f in self.filters:
            low, high = spans[f.attribute[0]]
            values = f.value if isinstance(f, In) else (f.value,)
            if isinstance(f, (EqualTo, In)):
                fits = any(low <= v <= high for v in values)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                fits = high > f.value or isinstance(f, GreaterThanOrEqual) and high == f.value
            else:
                fits = low < f.value or isinstance(f, LessThanOrEqual) and low == f.value
            if not fits:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """A partition for each file, from its name alone."""
        where, folder = _file_system(self.path)
        out = []
        for entry in where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            named = re.search(r"([^/]+)/y(-?\d+)_x(-?\d+)\.npy$", entry.path)
            if named and self._wanted(named[1], int(named[2]), int(named[3])):
                out.append(TilePartition(named[1], int(named[2]), int(named[3]), entry.path))
        return out or [InputPartition(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("band", pa.string()), ("ty", pa.int32()), ("tx", pa.int32()), ("py", pa.int64()), ("px", pa.int64()), ("value", pa.float64()), ("error", pa.string())])
        if not isinstance(partition, TilePartition):
            return  # there are no files
        where, _ = _file_system(self.path)
        try:
            with where.open_input_file(partition.file) as f:
                grid = np.load(f)
            if grid.shape != (self.tile, self.tile):
                raise ValueError(f"a tile of {grid.shape}")
            y, x = np.nonzero(~np.isnan(grid))
            rows, error = [y + partition.ty * self.tile, x + partition.tx * self.tile, grid[y, x]], None
        except Exception as e:  # noqa: BLE001  a tile that can't be read is a row that says so
            rows, error = [None, None, None], f"{type(e).__name__}: {e}"
        n = 1 if error else len(rows[0])
        columns = [pa.array([v] * n, t) for v, t in ((partition.band, pa.string()), (partition.ty, pa.int32()), (partition.tx, pa.int32()))]
        columns += [pa.nulls(n, t) if error else pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([error] * n, pa.string())], schema=schema)


class TiledRaster(DataSource):
    """spark.read.format("tiled_raster").option("tile", 256).load(path): ROWS; a tile that can't be read is one row with its error."""

    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("tile", TILE)))


def read_tiles(spark: SparkSession, path: str, tile: int = TILE, where: Column | None = None) -> DataFrame:
    """ROWS of the tiles under a path; `where` should be given here, so that it reaches the source."""
    spark.dataSource.register(TiledRaster)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    rows = spark.read.format("tiled_raster").option("tile", tile).load(path)
    return rows if where is None else rows.where(where)


def window_share(cells: DataFrame, tiles: DataFrame, keys: list[str], of_class: float, tile: int = TILE) -> DataFrame:
    """keys, n, share: the share of a class among the pixels of each cell's window (keys, y0, y1, x0, x1; both ends inside).

    cells go to the tiles that their windows meet and to the pixels there. A cell none of whose tiles exist has a null share
    (it is kept by a prefilter); one with a tile that can't be read has 1.0; one without pixels in its tiles has 0.0.
    """
    to = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int")))
    asked = cells.select(*keys, "y0", "y1", "x0", "x1").withColumn("ty", to("y0", "y1")).withColumn("tx", to("x0", "x1"))
    # windows and pixels meet in squares of 16 x 16 pixels, so that a tile isn't one key
    square = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 16).cast("long"), F.floor(F.col(b) / 16).cast("long")))
    near = cells.select(*keys, "y0", "y1", "x0", "x1").withColumn("_sy", square("y0", "y1")).withColumn("_sx", square("x0", "x1"))
    pixels = tiles.where("error is null").select("py", "px", "value", F.floor(F.col("py") / 16).cast("long").alias("_sy"), F.floor(F.col("px") / 16).cast("long").alias("_sx"))
    inside = F.col("py").between(F.col("y0"), F.col("y1")) & F.col("px").between(F.col("x0"), F.col("x1"))
    counts = near.join(pixels, ["_sy", "_sx"]).where(inside).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value") == of_class).alias("hits"))
    state = tiles.groupBy("ty", "tx").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    known = asked.join(state, ["ty", "tx"]).groupBy(*keys).agg(F.max("bad").alias("bad"))
    share = F.when(F.col("bad"), 1.0).when(F.col("bad").isNotNull(), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)))
    return cells.select(*keys).join(known, keys, "left").join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"))
