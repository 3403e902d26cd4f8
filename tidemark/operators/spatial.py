"""Joins with lookups, windows, sectors, masks and neighbours; covariances; stencils on grids. Joins between large sides are equi-joins on buckets."""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .within import class_products


def window_join(points: DataFrame, t: str, windows: DataFrame, bucket: float) -> DataFrame:
    """Points with every window (name, t1, t2) that holds them, closed at both ends: an equi-join on time buckets, then the exact test. A point on a border falls in both windows."""
    own = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t1") / bucket), F.floor(F.col("t2") / bucket))))
    return points.withColumn("_b", F.floor(F.col(t) / bucket)).join(own, "_b").where(F.col(t).between(F.col("t1"), F.col("t2"))).drop("_b")


def moving_windows(first: int, last: int, length: int, step: int) -> Column:
    """The windows [s, s + length] with s = first, first + step, ... that begin by `last`, as an array of structs."""
    return F.transform(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(step).cast("long")), lambda s: F.struct(s.alias("t1"), (s + length).alias("t2")))


def sector_join(points: DataFrame, lon: str, n: int, buffer: float = 0.0) -> DataFrame:
    """Points with the sectors 1 .. n of 360 degrees (0 to 360, closed ends, widened by `buffer`) that hold them, round the circle. Each point names its sectors; no join."""
    if n < 1:
        raise ValueError("at least one sector")
    width = 360.0 / n
    x = F.pmod(F.col(lon), F.lit(360.0))
    low = F.floor((x - buffer) / width)
    low = F.when((x - buffer) / width == low, low - 1).otherwise(low)
    every = F.transform(F.sequence(low, F.floor((x + buffer) / width)), lambda k: (F.pmod(k, F.lit(n)) + 1).cast("int"))
    return points.withColumn("sector", F.explode(F.array_distinct(every)))


def mask_flag(points: DataFrame, x: str, y: str, mask: DataFrame, bounds: tuple[int, int, int, int]) -> DataFrame:
    """Adds flag of the mask cell (ix, iy) nearest to (x, y) in km; places outside take the nearest edge cell."""
    x0, x1, y0, y1 = bounds
    ix = F.greatest(F.least(F.rint(x), F.lit(float(x1))), F.lit(float(x0))).cast("int")
    iy = F.greatest(F.least(F.rint(y), F.lit(float(y1))), F.lit(float(y0))).cast("int")
    return points.withColumn("ix", ix).withColumn("iy", iy).join(mask.select("ix", "iy", "flag"), ["ix", "iy"], "left")


def mask_border(mask: DataFrame, buffer: int = 3) -> DataFrame:
    """Adds border: whether any cell within `buffer` rows and columns has another flag. Two one-dimensional passes over the mask, done once for all points."""
    wide = Window.partitionBy("iy").orderBy("ix").rangeBetween(-buffer, buffer)
    high = Window.partitionBy("ix").orderBy("iy").rangeBetween(-buffer, buffer)
    m = mask.withColumn("_lo", F.min("flag").over(wide)).withColumn("_hi", F.max("flag").over(wide))
    return m.withColumn("border", (F.min("_lo").over(high) != F.max("_hi").over(high)).cast("int")).drop("_lo", "_hi")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Adds to each row of left the value of the row of right with the same key and the nearest time; the earlier of two equally near. One sort of the union, no range join."""
    u = left.withColumn("_l", F.lit(1)).unionByName(right.select(key, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_r")).withColumn("_l", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_l")
    before = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    u = u.withColumn("_p", before).withColumn("_n", after).where("_l = 1")
    pick = F.when(F.col("_p").isNull() | (F.col("_n.t") - F.col(t) < F.col(t) - F.col("_p.t")), F.col("_n")).otherwise(F.col("_p"))
    return u.withColumn("_k", pick).withColumn("nearest_t", F.col("_k.t")).withColumn("nearest_v", F.col("_k.v")).drop("_l", "_r", "_p", "_n", "_k")


def circle_join(nodes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of a node (node, nx, ny) and a point (x, y) within `radius`, closed: nodes name the tiles around them, points their own."""
    near = F.sequence(F.lit(-1), F.lit(1))
    a = nodes.withColumn("_tx", F.explode(F.transform(near, lambda k: F.floor(F.col("nx") / radius) + k))).withColumn(
        "_ty", F.explode(F.transform(near, lambda k: F.floor(F.col("ny") / radius) + k))
    )
    b = points.withColumn("_tx", F.floor(F.col("x") / radius)).withColumn("_ty", F.floor(F.col("y") / radius))
    j = a.join(b, ["_tx", "_ty"]).drop("_tx", "_ty").withColumn("distance", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    return j.where(F.col("distance") <= radius)


def square_join(nodes: DataFrame, points: DataFrame, side: float) -> DataFrame:
    """Pairs of a node and a point at most side / 2 away in x and in y."""
    half = side / 2
    return circle_join(nodes, points, half * 2**0.5).where((F.abs(F.col("nx") - F.col("x")) <= half) & (F.abs(F.col("ny") - F.col("y")) <= half))


def pairs_within(points: DataFrame, reach: float) -> DataFrame:
    """Every unordered pair of points (id, x, y, v) at most `reach` apart, once, and each point with itself: a_id, b_id, a_v, b_v, distance.

    A point asks its own tile and the four neighbouring tiles of one half plane; the order of a pair in one tile is part of the join.
    """
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    tile = lambda c: F.floor(F.col(c) / reach)
    a = points.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "v")]).withColumn("_o", F.explode(half))
    a = a.withColumn("_tx", tile("a_x") + F.col("_o.i")).withColumn("_ty", tile("a_y") + F.col("_o.j"))
    b = points.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "v")]).withColumn("_ux", tile("b_x")).withColumn("_uy", tile("b_y"))
    other = (F.col("_o.i") != 0) | (F.col("_o.j") != 0)
    j = a.join(b, (F.col("_tx") == F.col("_ux")) & (F.col("_ty") == F.col("_uy")) & (other | (F.col("a_id") <= F.col("b_id"))))
    j = j.withColumn("distance", F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
    return j.where(F.col("distance") <= reach).select("a_id", "b_id", "a_v", "b_v", "distance")


def covariance(points: DataFrame, width: float, classes: int) -> DataFrame:
    """Empirical covariance: the mean product of values of all pairs (self pairs too) per distance class 0 .. classes - 1, and their number; class k holds distances from (k - 1/2) * width on.

    points: x, y, v. No pair is a row: pairs of a class are counted and summed by ranges (operators/within.py).
    """
    found = class_products(points, width, classes)
    every = points.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    return every.join(found, "class", "left").select("class", F.coalesce("cov", F.lit(0.0)).alias("cov"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, least: float = 0.5) -> DataFrame:
    """Adds value: the bilinear mean of the grid's (ix, iy, v) four neighbours of (x, y) in grid units, over those that have values; null if their weights sum to less than `least`.

    The grid is gathered into blocks of four corners; each point then looks one block up, so that equal points stay apart.
    """
    corner = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    g = grid.where("v IS NOT NULL").withColumn("_k", F.explode(corner)).select((F.col("ix") - F.col("_k.a")).cast("long").alias("_bx"), (F.col("iy") - F.col("_k.b")).cast("long").alias("_by"), "_k", "v")
    value = lambda a, b: F.max(F.when((F.col("_k.a") == a) & (F.col("_k.b") == b), F.col("v"))).alias(f"_v{a}{b}")
    g = g.groupBy("_bx", "_by").agg(*[value(a, b) for a in (0, 1) for b in (0, 1)])
    p = points.withColumn("_px", F.floor(x).cast("long")).withColumn("_py", F.floor(y).cast("long"))
    j = p.join(g, (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by")), "left")
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    total, mass = F.lit(0.0), F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            w = (fx if a else 1 - fx) * (fy if b else 1 - fy)
            v = F.col(f"_v{a}{b}")
            total, mass = total + F.coalesce(w * v, F.lit(0.0)), mass + F.when(v.isNotNull(), w).otherwise(0.0)
    out = F.when(mass >= least, total / mass)
    return j.withColumn("value", out).select(*points.columns, "value")


def gaussian(grid: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Smooths v over (ix, iy), each direction in turn; missing cells count as 0 and stay missing. Cells beyond the grid count as 0 too."""
    r = int(ceil(truncate * sigma))
    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    weights = [x / sum(weights) for x in weights]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("w")) for k, x in zip(range(-r, r + 1), weights, strict=True)])
    g = grid.where("v IS NOT NULL")
    for axis in ("ix", "iy"):
        other = "iy" if axis == "ix" else "ix"
        g = g.withColumn("_s", F.explode(kernel)).groupBy((F.col(axis) + F.col("_s.k")).alias(axis), other).agg(F.sum(F.col("v") * F.col("_s.w")).alias("v"))
    return grid.select("ix", "iy", F.col("v").alias("_own")).join(g, ["ix", "iy"], "left").select("ix", "iy", F.when(F.col("_own").isNotNull(), F.col("v")).alias("v"))


def laplace(grid: DataFrame) -> DataFrame:
    """One masked smoothing step: the mean of a cell's row mean and column mean over itself and its neighbours with values."""
    w = lambda a, b: Window.partitionBy(a).orderBy(b).rangeBetween(-1, 1)
    g = grid.where("v IS NOT NULL")
    return g.withColumn("v", (F.avg("v").over(w("iy", "ix")) + F.avg("v").over(w("ix", "iy"))) / 2)
