"""Matrices, cubes, rasters and flat binary tables as stored data. Formats that need a library that isn't here are read as the columns that they hold, from Parquet."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder's path in spark.checkpoint.dir, which driver and executors share; in a local session without one, in a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.get(context.applicationId) or _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def name_columns(matrix: DataFrame, data: str, names: dict[str, int]) -> DataFrame:
    """A positional matrix, one array a row, as named columns."""
    return matrix.select(*[F.get(data, i).alias(n) for n, i in names.items()])


def optional_columns(cube: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """A cube's keys and variables; those that it lacks are null."""
    return cube.select(*keys, *[F.col(c) if c in cube.columns else F.lit(None).cast("double").alias(c) for c in wanted])


def leaves(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of every table of a store."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def read_raster(files: DataFrame, width: int, every: int = 1, flip: bool = True, missing: float = -9999.0) -> DataFrame:
    """Little-endian float32 rasters (path, content) of rows of `width`: (path, ix, iy, v), each `every`-th row and column, rows counted from the bottom with flip; missing values are absent."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                grid = np.frombuffer(content, "<f4", len(content) // 4 // width * width).reshape(-1, width)[::every, ::every]
                grid = grid[::-1] if flip else grid
                iy, ix = np.nonzero(grid != np.float32(missing))
                yield pd.DataFrame({"path": path, "ix": ix.astype(np.int64), "iy": iy.astype(np.int64), "v": grid[iy, ix].astype(float)})

    return files.mapInPandas(decode, "path string, ix long, iy long, v double")


def write_flat(df: DataFrame, key: str, order: list[str], values: list[str], dtype: str = "<f8") -> DataFrame:
    """Flat binary tables (path, content): per key the rows in order, each the values one after the other; dtype may be big-endian."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({"path": [str(pdf[key].iloc[0])], "content": [np.ascontiguousarray(pdf[values].to_numpy(dtype)).tobytes()]})

    return df.groupBy(key).applyInPandas(pack, "path string, content binary")


def read_flat(files: DataFrame, values: list[str], dtype: str = "<f8") -> DataFrame:
    """The rows of flat binary tables: path, rowno, values."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = np.frombuffer(content, dtype).reshape(-1, len(values)).astype(float)
                yield pd.DataFrame({"path": path, "rowno": np.arange(len(rows), dtype=np.int64), **{v: rows[:, i] for i, v in enumerate(values)}})

    return files.mapInPandas(unpack, "path string, rowno long, " + ", ".join(f"{v} double" for v in values))


def stored(df: DataFrame, by: list[str] | None = None, order: list[str] | None = None, mode: str = "errorifexists", path: str | None = None, codec: str = "zstd") -> str:
    """Writes a table, one folder per value of `by`, rows in `order` within a file; returns its path."""
    path = path or scratch(df.sparkSession)
    if by:
        df = df.repartition(*by)
    if order:
        df = df.sortWithinPartitions(*(by or []), *order)
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def cleaned(v: Column, most: float = 5.0) -> Column:
    """0 for what is missing or beyond `most`."""
    return F.when(F.abs(v) > most, 0.0).otherwise(F.coalesce(v, F.lit(0.0)))


def laser_points(df: DataFrame) -> DataFrame:
    """Laser rows: seconds since 2000 of the serial day, longitudes from 0 to 360, both tides added to the elevation."""
    return df.withColumn("secs00", (F.col("day") - 730486.0) * 86400).withColumn("lon", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))).withColumn("elev", F.col("elev") + F.col("ocean_tide") + F.col("load_tide"))


def side_by_side(parts: list[DataFrame], rowno: str) -> DataFrame:
    """Tables of equal numbers of rows, joined by an explicit row number."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, rowno)
    return out


def database(df: DataFrame, seconds: str, since: int = 1985) -> DataFrame:
    """Rows without a null or NaN, with year, month and season (its first month) of their time."""
    whole = df.na.drop("any")
    ts = F.lit(f"{since}-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(seconds).cast("decimal(20,6)"))
    m = F.month(ts)
    return whole.withColumn("year", F.year(ts)).withColumn("month", m).withColumn("season", F.when(m.isin(12, 1, 2), 12).otherwise(F.floor(m / 3) * 3))
