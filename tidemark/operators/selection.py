"""Selections, projections, partitions and unions of points, cells and files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_bounds(left: float, right: float, bottom: float, top: float) -> None:
    """Raises ValueError unless a region has a width, a height, and ends on the sphere."""
    if not (-180 <= left < right <= 360 and -90 <= bottom < top <= 90):
        raise ValueError(f"not a region: {left}, {right}, {bottom}, {top}")


def valid_bounds(left: Column, right: Column, bottom: Column, top: Column) -> Column:
    """The same as a condition."""
    return left.between(-180, 360) & right.between(-180, 360) & (left < right) & bottom.between(-90, 90) & top.between(-90, 90) & (bottom < top)


def open_box(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], inside: bool = True) -> DataFrame:
    """Points strictly inside or strictly outside a box (west, east, south, north): those on its border are in neither."""
    w, e, s, n = box
    if inside:
        return points.where((F.col(x) > w) & (F.col(x) < e) & (F.col(y) > s) & (F.col(y) < n))
    return points.where((F.col(x) < w) | (F.col(x) > e) | (F.col(y) < s) | (F.col(y) > n))


def null_beyond(x: Column, most: float) -> Column:
    return F.when(F.abs(x) <= most, x)


def mark_missing(x: Column, mark: float = 999999.0) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(mark))


def error_root(df: DataFrame, x: str, most: float) -> DataFrame:
    """Rows with 0 <= x <= most, and x as its root."""
    return df.where(F.col(x).between(0, most)).withColumn(x, F.sqrt(x))


def without_cells(cells: DataFrame, places: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Cells (ix, iy from 0) but those nearest to the places (x, y)."""
    gone = places.select(F.rint((F.col("x") - x0) / dx - 0.5).cast("long").alias("_gx"), F.rint((F.col("y") - y0) / dy - 0.5).cast("long").alias("_gy")).distinct()
    return cells.join(gone, (F.col("ix") == F.col("_gx")) & (F.col("iy") == F.col("_gy")), "left_anti")


def numbered_join(a: DataFrame, b: DataFrame, number: str) -> DataFrame:
    """Tables side by side, row by row of an explicit row number."""
    return a.join(b, number)


def subset(cells: DataFrame, x: tuple[int, int], y: tuple[int, int], values: list[str]) -> DataFrame:
    """Cells of closed ranges of ix and iy; values of the ranges' first and last ix become null."""
    border = F.col("ix").isin(*x)
    return cells.where(F.col("ix").between(*x) & F.col("iy").between(*y)).withColumns({v: F.when(~border, F.col(v)) for v in values})


def own_sector(points: DataFrame, path: str, lon: str, n: int) -> DataFrame:
    """Of points of overlapping sector files, those in the half-open sector that the last two digits in their file's path name."""
    sector = F.element_at(F.regexp_extract_all(path, F.lit(r"(\d\d)"), F.lit(1)), -1).cast("int")
    x = F.pmod(F.col(lon), F.lit(360.0))
    return points.withColumn("sector", sector).where((x >= (F.col("sector") - 1) * (360.0 / n)) & (x < F.col("sector") * (360.0 / n)))


def place_subgrid(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Cells of a subgrid with centres lon, lat, as whole indices of the full grid whose first cell begins at (x0, y0)."""
    at = lambda c, a, s: F.rint((F.round(c, 6) - a) / s - 0.5).cast("long")
    return cells.withColumn("ix", at("lon", x0, dx)).withColumn("iy", at("lat", y0, dy))


def on_full_grid(cells: DataFrame, grid: DataFrame, values: list[str]) -> DataFrame:
    """Every cell and time of a full grid (t, ix, iy), with the subgrids' values where they have any."""
    return grid.join(cells.select("t", "ix", "iy", *values), ["t", "ix", "iy"], "left")


def in_months(df: DataFrame, date: str, first: int, last: int) -> DataFrame:
    """Rows of months first .. last of each year, and the year."""
    return df.where(F.month(date).between(first, last)).withColumn("year", F.year(date))


def in_intervals(df: DataFrame, date: str, intervals: list[tuple[str, str]]) -> DataFrame:
    """Rows with each closed interval of dates that holds them, named by its middle date. The list is short and given."""
    spans = F.array(*[F.struct(F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for a, b in intervals])
    out = df.withColumn("_i", F.explode(F.filter(spans, lambda s: F.col(date).cast("date").between(s["a"], s["b"]))))
    return out.withColumn("middle", F.date_add(F.col("_i.a"), F.floor(F.datediff(F.col("_i.b"), F.col("_i.a")) / 2).cast("int"))).drop("_i")


def epoch(date: Column, by: str) -> Column:
    """month or season (its first month) without the year, or the year."""
    m = F.month(date)
    return {"month": m, "year": F.year(date), "season": F.when(m.isin(12, 1, 2), 12).otherwise((F.floor(m / 3) * 3).cast("int"))}[by]


def reference_frame(df: DataFrame, cell: str, diagonal: float | None = 0.0) -> DataFrame:
    """Long rows (cell, t_ref, t, h) with a diagonal row t = t_ref for every reference epoch, of a value or null."""
    own = df.select(cell, "t_ref").distinct().select(cell, "t_ref", F.col("t_ref").alias("t"), F.lit(diagonal).cast("double").alias("_d"))
    return df.select(cell, "t_ref", "t", "h").join(own, [cell, "t_ref", "t"], "full").select(cell, "t_ref", "t", F.when(F.col("t") == F.col("t_ref"), F.col("_d")).otherwise(F.col("h")).alias("h"))


def dense_frame(df: DataFrame, cell: str, t: str, value: str) -> DataFrame:
    """Every cell at every epoch, null where it has no row: a frame of series as long rows."""
    every = df.select(cell).distinct().crossJoin(F.broadcast(df.select(t).distinct()))
    return every.join(df.select(cell, t, value), [cell, t], "left")


def sorted_files(paths: DataFrame, path: str) -> DataFrame:
    """Files with their place in the order of the two dates in their names, then of the names. One row per file: a window over names, not over data."""
    first, second = (F.regexp_extract(path, r"(\d{8})_(\d{8})", k) for k in (1, 2))
    keyed = paths.withColumn("time1", first).withColumn("time2", second)
    return keyed.withColumn("place", F.row_number().over(Window.orderBy("time1", "time2", path)))


def renamed(path: Column, shift: int) -> Column:
    """A file name with its region number _NN_ moved by shift and its suffix replaced."""
    number = F.regexp_extract(path, r"_(\d\d)_", 1)
    new = F.lpad((number.cast("int") + shift).cast("string"), 2, "0")
    return F.regexp_replace(F.regexp_replace(path, F.concat(F.lit("_"), number, F.lit("_")), F.concat(F.lit("_"), new, F.lit("_"))), F.lit(r"\.h5$"), F.lit(".parquet"))
