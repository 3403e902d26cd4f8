"""Tides from gridded constituents: bilinear interpolation with a land mask, and harmonic prediction.

Both are Column expressions and equi-joins on cell numbers; a grid of constituents in long form (iy, ix, constituent, re, im) stays a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Angular speed in degrees an hour of the main constituents.
SPEEDS = {
    "m2": 28.9841042, "s2": 30.0, "n2": 28.4397295, "k2": 30.0821373, "k1": 15.0410686, "o1": 13.9430356, "p1": 14.9589314, "q1": 13.3986609,
}


def grid_place(lon: Column, lat: Column, left: float, bottom: float, dx: float, dy: float) -> tuple[Column, Column]:
    """(i, j): fractional row and column of a place in a grid whose first centre lies half a cell inside its corner."""
    return (lat - bottom) / dy - 0.5, (lon - left) / dx - 0.5


def interpolate_constituents(
    points: DataFrame, grid: DataFrame, keys: list[str], rows: int, columns: int, least: float = 0.5, periodic: bool = False
) -> DataFrame:
    """Per point and constituent: re, im (bilinear over the valid corners, weights renormalised) and frac, the weight of the valid corners.

    points: keys, i, j. grid: iy, ix, constituent, re, im, only valid cells as rows. A point outside the grid or with a null place has no rows, and neither has one
    whose frac is not over `least`. Columns wrap where the grid is periodic. Each point goes to its four corners: one equi-join, one aggregation on the point.
    """
    i, j = F.col("i"), F.pmod(F.col("j"), F.lit(float(columns))) if periodic else F.col("j")
    p = points.select(*keys, i.alias("i"), j.alias("j"), F.floor(i).alias("i0"), F.floor(j).alias("j0")).where(F.col("i0").between(0, rows - 2))
    p = p if periodic else p.where(F.col("j0").between(0, columns - 2))
    up, right = F.col("i") - F.col("i0"), F.col("j") - F.col("j0")
    corners = [
        F.struct(
            (F.col("i0") + a).alias("iy"),
            F.pmod(F.col("j0") + b, F.lit(columns)).alias("ix"),
            ((up if a else 1 - up) * (right if b else 1 - right)).alias("w"),
        )
        for a in (0, 1)
        for b in (0, 1)
    ]
    p = p.select(*keys, F.explode(F.array(*corners)).alias("c")).select(*keys, "c.*")
    g = p.join(grid.select("iy", "ix", "constituent", "re", "im"), ["iy", "ix"]).where("w > 0").groupBy(*keys, "constituent")
    w = F.sum("w")
    return g.agg((F.sum(F.col("w") * F.col("re")) / w).alias("re"), (F.sum(F.col("w") * F.col("im")) / w).alias("im"), w.alias("frac")).where(F.col("frac") > least)


def predict_heights(constituents: DataFrame, keys: list[str], hours: str, only: list[str] | None = None) -> DataFrame:
    """height per key: the sum over constituents of re * cos(speed * t) + im * sin(speed * t), t in hours.

    constituents: keys, constituent, re, im, hours. Nodal factors are left at 1. Constituents without a known speed are skipped, and so are those outside `only`.
    """
    speed = F.lit(None).cast("double")
    for name, value in SPEEDS.items():
        if only is None or name in only:
            speed = F.when(F.col("constituent") == name, F.lit(value)).otherwise(speed)
    angle = F.radians(F.pmod(speed * F.col(hours), F.lit(360.0)))
    c = constituents.withColumn("_angle", angle).where("_angle IS NOT NULL")
    return c.groupBy(*keys).agg(F.sum(F.col("re") * F.cos("_angle") + F.col("im") * F.sin("_angle")).alias("height"))
