"""Compositions for series and grids: post-processing, trends, regional series, corrections by trends, along-track smoothing, backscatter by any mode."""

from __future__ import annotations

from math import ceil, exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fits
from .series import backscatter_constant, step_filter
from .spatial import bilinear


def trend_blocks(df: DataFrame, cell: str, t: str, v: str, blocks: int = 4, least: int = 8) -> DataFrame:
    """(cell, block, slope): the line's slope in each of `blocks` runs of floor(n / blocks) of a series' n epochs, null under `least` values. The last run goes on to the last epoch but one, as the method has it."""
    w = Window.partitionBy(cell)
    i = F.row_number().over(w.orderBy(t)) - 1
    d = df.withColumn("_i", i).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_w", F.floor(F.col("_n") / blocks))
    d = d.withColumn("block", F.least(F.floor(F.col("_i") / F.col("_w")), F.lit(blocks - 1))).where((F.col("block") < blocks - 1) | (F.col("_i") < F.col("_n") - 1))
    return d.groupBy(cell, "block").agg(F.when(F.count(v) >= least, F.regr_slope(v, t)).alias("slope"))


def line(df: DataFrame, cell: str, t: str, v: str) -> DataFrame:
    """Adds line: the least-squares line of each series at its epochs; null under two values."""
    w = Window.partitionBy(cell)
    ok = F.count(v).over(w) >= 2
    return df.withColumn("line", F.when(ok, F.regr_slope(v, t).over(w) * F.col(t) + F.regr_intercept(v, t).over(w)))


def trends(df: DataFrame, cell: str, t: str, v: str, dt: float = 0.25) -> DataFrame:
    """Series referenced to their mean, three fits (lasso and polynomial by folds, line), their rates (end to end), and the lasso curve's derivative with its rate: one row per cell and epoch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[t].to_numpy(float), pdf[v].to_numpy(float)
        y = y - np.nanmean(y) if (~np.isnan(y)).any() else y
        ok = ~np.isnan(y)
        out = {"cell": pdf[cell], "t": pdf[t], "v": y}
        out["lasso"] = fits.lasso_by_folds(x, y)
        out["poly"] = np.polyval(fits.polynomial_by_folds(x, y)[1], x)
        out["line"] = np.polyval(np.polyfit(x[ok], y[ok], 1), x) if ok.sum() >= 2 else np.full(len(x), np.nan)
        span = x[-1] - x[0] if len(x) > 1 else np.nan
        for k in ("lasso", "poly", "line"):
            out[f"{k}_rate"] = (out[k][-1] - out[k][0]) / span
        out["derivative"] = np.gradient(out["lasso"], dt) if len(x) > 1 else np.full(len(x), np.nan)
        out["derivative_rate"] = (out["derivative"][-1] - out["derivative"][0]) / span
        return pd.DataFrame(out)

    names = ["v", "lasso", "poly", "line", "lasso_rate", "poly_rate", "line_rate", "derivative", "derivative_rate"]
    return fits.per_series(df, cell, [t], run, "cell long, t long, " + ", ".join(f"{n} double" for n in names))


def post_process(df: DataFrame, cell: str, t: str, v: str, e: str, span: tuple[float, float], bad: list, delta: float = 3.0, window: int = 15, k: float = 3.0, share: float = 0.7) -> DataFrame:
    """The chain of filters of a cube of series: epochs strictly within span; cells in `bad` become null; steps over delta are taken off; peaks beyond k deviations of the trend go, again and again;
    series with less than `share` of their epochs go; what is left is referenced to its mean; errors without a value become null."""
    d = df.where((F.col(t) > span[0]) & (F.col(t) < span[1])).withColumn("_bad", F.col(cell).isin(bad))
    stepped = step_filter(d.where(F.col(v).isNotNull() & ~F.col("_bad")).select(cell, t, v), cell, t, v, delta, window).select(cell, t, F.col("filtered").alias("_f"))

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf[cell], "t": pdf[t], "_p": fits.drop_peaks(pdf[t].to_numpy(float), pdf["_f"].to_numpy(float), k)})

    kept = fits.per_series(stepped, cell, [t], peaks, "cell long, t long, _p double").select("cell", "t", F.nanvl("_p", F.lit(None).cast("double")).alias("_p"))
    d = d.join(kept.withColumnRenamed("cell", "_c").withColumnRenamed("t", "_t"), (F.col(cell) == F.col("_c")) & (F.col(t) == F.col("_t")), "left")
    w = Window.partitionBy(cell)
    value = F.when(F.count("_p").over(w) / F.count(F.lit(1)).over(w) >= share, F.col("_p"))
    d = d.withColumn("_q", value).withColumn("_q", F.col("_q") - F.avg("_q").over(w))
    return d.select(cell, t, F.col("_q").alias(v), F.when(F.col("_q").isNotNull(), F.col(e)).alias(e))


def regional_series(cells: DataFrame, regions: DataFrame, t: str, v: str, area: str) -> DataFrame:
    """(region, t, mean, to_mean): area-weighted means of the cells in a region's boxes (region, x1, x2, y1, y2, closed; a region may have several), 0 where a region has no value, and the same less its mean over time.

    A cell in two boxes of a region counts once. 0 counts as missing.
    """
    own = cells.join(F.broadcast(regions), F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))).dropDuplicates(["region", "x", "y", t])
    x = F.when(F.col(v) != 0, F.col(v))
    m = own.groupBy("region", t).agg(F.coalesce(F.sum(F.col(area) * x) / F.sum(F.when(x.isNotNull(), F.col(area))), F.lit(0.0)).alias("mean"))
    return m.withColumn("to_mean", F.col("mean") - F.avg("mean").over(Window.partitionBy("region")))


def regional_areas(cells: DataFrame, regions: DataFrame, sampled: Column, area: str) -> DataFrame:
    """(region, area, sampled, percent, n): the area of a region's cells, the part of it that is sampled, and the number of sampled cells."""
    own = cells.join(F.broadcast(regions), F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))).dropDuplicates(["region", "x", "y"])
    g = own.groupBy("region").agg(F.sum(area).alias("area"), F.sum(F.when(sampled, F.col(area)).otherwise(0.0)).alias("sampled"), F.count(F.when(sampled, 1)).alias("n"))
    return g.withColumn("percent", 100 * F.col("sampled") / F.col("area"))


def fill_nearest(points: DataFrame, grid: DataFrame, x: str, y: str, least: float = 1.0 - 1e-9) -> DataFrame:
    """Adds value: the bilinear value where all four neighbours have one (or `least` of their weights), else that of the nearest node, null if it has none."""
    linear = bilinear(points, grid, x, y, least).withColumnRenamed("value", "_linear")
    near = linear.withColumn("_ix", F.rint(x).cast("long")).withColumn("_iy", F.rint(y).cast("long"))
    g = grid.where("v IS NOT NULL").select(F.col("ix").cast("long").alias("_gx"), F.col("iy").cast("long").alias("_gy"), F.col("v").alias("_near"))
    j = near.join(g, (F.col("_ix") == F.col("_gx")) & (F.col("_iy") == F.col("_gy")), "left")
    return j.select(*points.columns, F.coalesce("_linear", "_near").alias("value"))


def back_fill(cells: DataFrame, v: str, across: str, along: str) -> DataFrame:
    """Null values from the next one along an axis."""
    w = Window.partitionBy(across).orderBy(along).rowsBetween(0, Window.unboundedFollowing)
    return cells.withColumn(v, F.first(v, True).over(w))


def normalised_gaussian(grid: DataFrame, v: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Smooths v over (ix, iy) with Gaussian weights, over the cells that have values: weights are normalised over them."""
    r = int(ceil(truncate * sigma))
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(exp(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-r, r + 1)])
    g = grid.where(F.col(v).isNotNull()).select("ix", "iy", F.col(v).alias("_v"), F.lit(1.0).alias("_w"))
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        moved = g.withColumn("_s", F.explode(kernel))
        g = moved.groupBy((F.col(axis) + F.col("_s.k")).alias(axis), other).agg(F.sum(F.col("_v") * F.col("_s.w")).alias("_v"), F.sum(F.col("_w") * F.col("_s.w")).alias("_w"))
    return grid.join(g, ["ix", "iy"], "left").withColumn(v, F.col("_v") / F.col("_w")).drop("_v", "_w")


def correct_by_trends(cells: DataFrame, pressure: DataFrame, level: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Cells (ix, iy, gx, gy, rate) less the pressure trend (interpolated) and the sea-level trend (interpolated, filled from the nearest node, then along iy, then smoothed): adds corrected.

    pressure and level are grids (ix, iy, v) in whose units gx and gy are.
    """
    p = bilinear(cells, pressure, "gx", "gy").withColumnRenamed("value", "_pressure")
    s = fill_nearest(p, level, "gx", "gy").withColumnRenamed("value", "_level")
    s = normalised_gaussian(back_fill(s, "_level", "ix", "iy"), "_level", sigma)
    return s.withColumn("corrected", F.col("rate") - F.col("_pressure") - F.col("_level")).drop("_pressure", "_level")


def smooth_along(points: DataFrame, track: str, order: list[str], values: list[str], checked: str, sigma: float = 1.0, times: float = 3.0, truncate: float = 3.0) -> DataFrame:
    """Values smoothed along a track by Gaussian weights over rows (normalised at the ends), without points whose own `checked` value is over `times` deviations from the smooth one, nor points at the smooth place (the
    other values) of the point before."""
    w = Window.partitionBy(track).orderBy(*order)
    r = int(ceil(truncate * sigma))
    out = points
    for v in values:
        total, mass = F.lit(0.0), F.lit(0.0)
        for k in range(-r, r + 1):
            x, weight = F.lag(v, -k).over(w) if k else F.col(v), exp(-0.5 * (k / sigma) ** 2)
            total, mass = total + F.coalesce(x * weight, F.lit(0.0)), mass + F.when(x.isNotNull(), weight).otherwise(0.0)
        out = out.withColumn(f"{v}_smooth", total / mass)
    gap = F.col(checked) - F.col(f"{checked}_smooth")
    far = F.abs(gap) > times * F.stddev_pop(gap).over(Window.partitionBy(track))
    again = F.lit(True)
    for v in values:
        if v != checked:
            again = again & (F.lag(f"{v}_smooth").over(w) == F.col(f"{v}_smooth"))
    return out.withColumn("_far", far).withColumn("_again", F.coalesce(again, F.lit(False))).where("NOT _far AND NOT _again").drop("_far", "_again")


def refine(grid: DataFrame, factor: int = 3) -> DataFrame:
    """A grid (ix, iy, v) at `factor` times its resolution, bilinear between nodes: jx, jy count the fine nodes, and coarse node k is fine node k * factor."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = grid.select("ix", "iy", F.explode(steps).alias("_a"), "v").select("ix", "iy", "_a", F.explode(steps).alias("_b"))
    fine = fine.select((F.col("ix") * factor + F.col("_a")).alias("jx"), (F.col("iy") * factor + F.col("_b")).alias("jy"))
    out = bilinear(fine.withColumn("gx", F.col("jx") / factor).withColumn("gy", F.col("jy") / factor), grid, "gx", "gy", 1.0 - 1e-9)
    return out.select("jx", "jy", F.col("value").alias("v")).where("v IS NOT NULL")


def backscatter_variable(df: DataFrame, keys: list[str], t: str, h: str, g: str, points: int = 9) -> DataFrame:
    """Adds r, s and h_corr with correlation and slope of a window of `points` rows around each row; rows nearer to an end have those of the nearest full window. Corrections as in backscatter_constant."""
    w = Window.partitionBy(*keys).orderBy(t)
    frame = w.rowsBetween(-(points // 2), points // 2)
    use = F.col(h).isNotNull() & F.col(g).isNotNull() & (F.col(h) != 0) & (F.col(g) != 0)
    y, x = F.when(use, F.col(h)), F.when(use, F.col(g))
    whole = F.count(F.lit(1)).over(frame) == points
    d = df
    for name, f in (("r", F.corr(x, y)), ("s", F.regr_slope(y, x)), ("_h0", F.regr_intercept(y, x))):
        d = d.withColumn(f"_{name}", F.when(whole, f.over(frame)))
    for name in ("r", "s", "_h0"):
        before = F.last(f"_{name}", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(f"_{name}", True).over(w.rowsBetween(0, Window.unboundedFollowing))
        d = d.withColumn(name, F.coalesce(before, after))
    s = F.greatest(F.lit(-0.2), F.least(F.lit(0.7), F.col("s")))
    fixed = F.when(F.abs("r") >= 0.2, F.col(h) - s * F.col(g) + F.col("_h0")).otherwise(F.col(h))
    return d.withColumn("h_corr", fixed).drop("_r", "_s", "__h0", "_h0")


def backscatter(df: DataFrame, mode: str, cell: str, t: str, h: str, g: str, interval: str = "part") -> DataFrame:
    """The correction by mode: one fit a cell (constant), one an interval of time (interval), or a sliding one (variable)."""
    if mode == "variable":
        return backscatter_variable(df, [cell], t, h, g)
    if mode not in ("constant", "interval"):
        raise ValueError(f"no such mode: {mode}")
    return backscatter_constant(df, [cell] if mode == "constant" else [cell, interval], h, g)


def calibrated_error(df: DataFrame) -> DataFrame:
    """Adds e: of errors e1, e2, e3 and numbers n1, n2, n3 of three instruments, the mean of what an epoch has, but in the overlap of 2 and 3 (else of 1 and 2) the weighted one, whose second term stands outside the
    root, as the method computes it; and n, the numbers' mean."""
    has = [F.col(f"e{k}").isNotNull() for k in (1, 2, 3)]

    def merged(a, b):
        total = F.col(f"n{a}") + F.col(f"n{b}")
        wa, wb = F.col(f"n{a}") / total, F.col(f"n{b}") / total
        return F.sqrt(wa * wa * F.col(f"e{a}") * F.col(f"e{a}")) + wb * wb * F.col(f"e{b}") * F.col(f"e{b}")

    mean = lambda c: sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k in (1, 2, 3)), F.lit(0.0)) / F.nullif(sum((F.col(f"{c}{k}").isNotNull().cast("int") for k in (1, 2, 3)), F.lit(0)), F.lit(0))
    return df.withColumn("e", F.when(has[1] & has[2], merged(2, 3)).when(has[0] & has[1], merged(1, 2)).otherwise(mean("e"))).withColumn("n", mean("n"))
