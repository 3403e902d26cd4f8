"""Time series per grid cell, in long form: referencing of several reference epochs, weighted averages, calibration of instruments, filters.

A table of referenced series has columns cell, t_ref, t, h (value), e (error), n (observations); an absent row is a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mirror(df: DataFrame, cell: str, signs: dict[str, int]) -> DataFrame:
    """Adds (t, t_ref) for each (t_ref, t), its columns times their sign; measured rows win over mirrored ones."""
    swapped = df.select(cell, F.col("t").alias("t_ref"), F.col("t_ref").alias("t"), *[(F.col(c) * s).alias(c) for c, s in signs.items()], F.lit(1).alias("_r"))
    both = df.select(cell, "t_ref", "t", *signs, F.lit(0).alias("_r")).unionByName(swapped)
    cols = F.min_by(F.struct(*signs), F.col("_r")).alias("v")
    return both.groupBy(cell, "t_ref", "t").agg(cols).select(cell, "t_ref", "t", *[F.col(f"v.{c}").alias(c) for c in signs])


def add_diagonal(df: DataFrame, cell: str, values: dict[str, Column]) -> DataFrame:
    """Adds the missing rows t = t_ref of every series, with given values (0 for changes)."""
    own = df.select(cell, "t_ref").distinct().withColumn("t", F.col("t_ref")).join(df.where("t = t_ref").select(cell, "t_ref"), [cell, "t_ref"], "left_anti")
    return df.select(cell, "t_ref", "t", *values).unionByName(own.select(cell, "t_ref", "t", *[v.alias(k) for k, v in values.items()]))


def select_reference(df: DataFrame, cell: str, dynamic: bool = True) -> DataFrame:
    """Per cell the reference series: the one with most values (the earliest of equals), or the earliest."""
    n = df.groupBy(cell, "t_ref").agg(F.count("h").alias("n"))
    best = F.max_by("t_ref", F.struct("n", -F.col("t_ref"))) if dynamic else F.min("t_ref")
    return n.where("n > 0").groupBy(cell).agg(best.alias("ref"))


def reference_by_offset(df: DataFrame, cell: str, dynamic: bool = True) -> DataFrame:
    """Adds to every series the mean of (reference - series) over common epochs; series without a common epoch go.

    Errors: sqrt(mean of the reference's errors over common epochs squared + own squared). Numbers of 0: the rounded mean of both series' mean numbers over common epochs.
    """
    ref = select_reference(df, cell, dynamic)
    r = df.join(ref, cell).where("t_ref = ref").select(cell, "ref", "t", F.col("h").alias("h_r"), F.col("e").alias("e_r"), F.col("n").alias("n_r"))
    common = df.join(r, [cell, "t"]).where("h IS NOT NULL AND h_r IS NOT NULL")
    off = common.groupBy(cell, "t_ref").agg(
        F.first("ref").alias("ref"),
        F.avg(F.col("h_r") - F.col("h")).alias("offset"),
        F.avg("e_r").alias("e_off"),
        F.bround((F.avg("n_r") + F.avg("n")) / 2).alias("n_off"),
    )
    own = F.col("t_ref") == F.col("ref")
    return df.join(off, [cell, "t_ref"]).select(
        cell, "t_ref", "t", (F.col("h") + F.col("offset")).alias("h"),
        F.when(own, F.col("e")).otherwise(F.sqrt(F.pow("e_off", F.lit(2)) + F.pow("e", F.lit(2)))).alias("e"),
        F.when(~own & (F.col("n") == 0), F.col("n_off")).otherwise(F.col("n").cast("double")).alias("n"),
    )


def reference_by_first(df: DataFrame, cell: str) -> DataFrame:
    """Adds to every series but the first one the first series' value at that series' reference epoch; errors in quadrature, numbers added."""
    w = Window.partitionBy(cell)
    df = df.withColumn("first", F.min("t_ref").over(w))
    r = df.where("t_ref = first").select(cell, F.col("t").alias("t_ref"), F.col("h").alias("h_r"), F.col("e").alias("e_r"), F.col("n").alias("n_r"))
    own = F.col("t_ref") == F.col("first")
    return df.join(r, [cell, "t_ref"], "left").select(
        cell, "t_ref", "t",
        F.when(own, F.col("h")).otherwise(F.col("h") + F.col("h_r")).alias("h"),
        F.when(own, F.col("e")).otherwise(F.sqrt(F.pow("e_r", F.lit(2)) + F.pow("e", F.lit(2)))).alias("e"),
        F.when(own, F.col("n")).otherwise(F.col("n") + F.col("n_r")).cast("double").alias("n"),
    )


def weighted_average(df: DataFrame, cell: str) -> DataFrame:
    """Per cell and epoch: the average of all series weighted by numbers (0 counts as 1), its error, and the mean number. The weights' sum includes rows without a value."""
    n = F.when(F.col("n") == 0, 1).otherwise(F.col("n"))
    d = df.withColumn("_n", n)
    total = F.sum("_n")
    return d.groupBy(cell, "t").agg(
        (F.sum(F.col("_n") * F.col("h")) / total).alias("h"),
        (F.sqrt(F.sum(F.pow(F.col("_n") * F.col("e"), F.lit(2)))) / total).alias("e"),
        F.avg("n").alias("n"),
    )


def average_cell(df: DataFrame, cell: str, dynamic: bool = True) -> DataFrame:
    """The whole averaging of one instrument: mirror, diagonal, reference by offset, weighted average."""
    full = mirror(df, cell, {"h": -1, "e": 1, "n": 1})
    full = add_diagonal(full, cell, {"h": F.lit(0.0), "e": F.lit(0.0), "n": F.lit(0).cast("long")})
    return weighted_average(reference_by_offset(full, cell, dynamic), cell)


def pivot_sats(df: DataFrame, cell: str, t: str, value: str, sats: list[str]) -> DataFrame:
    return df.groupBy(cell, t).pivot("sat", sats).agg(F.first(value))


def calibrate(df: DataFrame, cell: str, t: str) -> DataFrame:
    """Three instruments s1, s2, s3 (values) with numbers n1, n2, n3 in columns: offsets on the overlaps, then the weighted merge. Cells where either overlap is empty get null.

    In an overlap of all three, the weight of (s2, s3) multiplies the merge of (s1, s2), as the method has it.
    """
    w = Window.partitionBy(cell)
    o12 = F.avg(F.col("s1") - F.col("s2")).over(w)
    o23 = F.avg(F.col("s2") - F.col("s3")).over(w)
    d = df.withColumn("o12", o12).withColumn("o23", o23)
    d = d.withColumn("x2", F.col("s2") + F.col("o12")).withColumn("x3", F.col("s3") + F.col("o12") + F.col("o23"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(1.0))
    add = lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    first = add(share("n1", "n2") * F.col("s1"), share("n2", "n1") * F.col("x2"))
    merged = add(share("n2", "n3") * first, share("n3", "n2") * F.col("x3"))
    ok = F.col("o12").isNotNull() & F.col("o23").isNotNull()
    return d.select(cell, t, F.when(ok, F.col("s1")).alias("s1"), F.when(ok, F.col("x2")).alias("s2"), F.when(ok, F.col("x3")).alias("s3"), F.when(ok, merged).alias("xcal"))


def calibrate_simple(df: DataFrame, cell: str, t: str) -> DataFrame:
    """Sequential offsets and the unweighted mean of what each epoch has."""
    w = Window.partitionBy(cell)
    d = df.withColumn("x2", F.col("s2") + F.avg(F.col("s1") - F.col("s2")).over(w))
    d = d.withColumn("x3", F.col("s3") + F.avg(F.col("x2") - F.col("s3")).over(w))
    vals = [F.col(c) for c in ("s1", "x2", "x3")]
    n = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
    return d.select(cell, t, (sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0)) / F.nullif(n, F.lit(0))).alias("mean"))


def backscatter_constant(df: DataFrame, keys: list[str], h: str, g: str) -> DataFrame:
    """Adds r (correlation), s (slope of h over g) and h_corr = h - s * g + h0 per group; pairs with null or 0 don't count. No correction under two pairs, without
    correlation or at |r| < 0.2; s is clamped to -0.2 .. 0.7 for the correction."""
    w = Window.partitionBy(*keys)
    use = F.col(h).isNotNull() & F.col(g).isNotNull() & (F.col(h) != 0) & (F.col(g) != 0)
    y, x = F.when(use, F.col(h)), F.when(use, F.col(g))
    d = df.withColumn("r", F.corr(x, y).over(w)).withColumn("s", F.regr_slope(y, x).over(w)).withColumn("_h0", F.regr_intercept(y, x).over(w))
    s = F.greatest(F.lit(-0.2), F.least(F.lit(0.7), F.col("s")))
    fixed = F.when(F.abs("r") >= 0.2, F.col(h) - s * F.col(g) + F.col("_h0")).otherwise(F.col(h))
    return d.withColumn("h_corr", F.when(F.col(g).isNull() & (F.abs("r") >= 0.2), None).otherwise(fixed)).drop("_h0")


def step_filter(df: DataFrame, series: str, t: str, v: str, delta: float = 3.0, window: int = 7) -> DataFrame:
    """Adds filtered: v without steps. Steps are changes over `delta` between centred running medians (ends repeated), summed up and taken off all that follows."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    n = window // 2
    w = Window.partitionBy(series).orderBy(t)
    frame = w.rowsBetween(-n, n)
    # the repeated ends are as many copies of the end value as the frame lacks rows
    i, m = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(series))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_i", i).withColumn("_n", m).withColumn("_a", F.first(v).over(whole)).withColumn("_z", F.last(v).over(whole))
    d = d.withColumn("_f", F.collect_list(v).over(frame))
    padded = F.concat(
        F.array_repeat("_a", F.greatest(F.lit(n + 1) - F.col("_i"), F.lit(0))), F.col("_f"), F.array_repeat("_z", F.greatest(F.col("_i") + n - F.col("_n"), F.lit(0)).cast("int"))
    )
    d = d.withColumn("median", F.element_at(F.array_sort(padded), n + 1))
    jump = F.col("median") - F.lag("median").over(w)
    d = d.withColumn("_jump", F.when(F.abs(jump) > delta, jump).otherwise(0.0))
    return d.withColumn("filtered", F.col(v) - F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_n", "_a", "_z", "_f", "_jump")


def gradient(v: Column, w, dt: float) -> Column:
    """Centred differences over rows `dt` apart, one-sided at the ends."""
    nxt, prev = F.lead(v).over(w), F.lag(v).over(w)
    return F.when(nxt.isNull(), (v - prev) / dt).when(prev.isNull(), (nxt - v) / dt).otherwise((nxt - prev) / (2 * dt))


def rolling_mean(v: Column, w, half: int) -> Column:
    """Centred mean over 2 * half + 1 rows; null where the frame is not full."""
    frame = w.rowsBetween(-half, half)
    return F.when(F.count(v).over(frame) == 2 * half + 1, F.avg(v).over(frame))


def area_mean(df: DataFrame, keys: list[str], value: str, area: str) -> DataFrame:
    """Area-weighted mean per key; 0 counts as missing, and a key without values gets 0."""
    x = F.when(F.col(value) != 0, F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col(area) * x) / F.sum(F.when(x.isNotNull(), F.col(area))), F.lit(0.0)).alias("mean"))


def resample(df: DataFrame, series: str, t: str, v: str, step: int) -> DataFrame:
    """Linear interpolation of each series (whole numbers t) to multiples of `step` within its range."""
    w = Window.partitionBy(series).orderBy(t)
    s = df.where(F.col(v).isNotNull()).select(series, t, v, F.lead(t).over(w).alias("_t2"), F.lead(v).over(w).alias("_v2"))
    first = F.ceil(F.col(t) / step) * step
    last = F.when(F.col("_t2").isNull(), F.col(t)).otherwise(F.col("_t2") - 1)
    s = s.where(first <= last).withColumn("_at", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))))
    value = F.when(F.col("_at") == F.col(t), F.col(v)).otherwise(F.col(v) + (F.col("_v2") - F.col(v)) * (F.col("_at") - F.col(t)) / (F.col("_t2") - F.col(t)))
    return s.select(series, F.col("_at").alias(t), value.alias(v))
