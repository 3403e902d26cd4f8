"""Grid-cell statistics of elevation pairs: binning, robust editing, class statistics, and the flagship composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch


def digit(x: Column, start: float, step: float) -> Column:
    """The number of the half-open bin [start + (i - 1) * step, start + i * step) that holds x, from 1 on."""
    return F.floor((x - start) / step).cast("int") + 1


def bin_centre(i: Column, start: float, step: float) -> Column:
    return start + (i - 0.5) * step


SMALL = 1 << 16  # rows of a group that one task may hold


def _saved(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_medians(rows: DataFrame, keys: list[str], value: str, small: int = SMALL, bins: int = 64) -> DataFrame:
    """keys, median: of every group's values, exactly; nulls and NaN are skipped, null keys are a group.

    A group of up to `small` values is one aggregation. In a larger one the two middle ranks are searched for without gathering it: its range is cut into `bins`, counts, least and largest
    value per bin are summed up in every task before they move, and the bin that holds the rank is the next range, until its values are equal or at most `small`, which are then sorted. So the rows of a popular
    group stay spread over all tasks; only the ranges are joined to them.
    """
    v = F.col("_v")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    hot = _saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_n") > small))
    own = [F.col(c).alias(f"_k_{c}") for c in keys]
    drop = [f"_k_{c}" for c in keys]
    if hot.limit(1).count() == 0:
        return rows.groupBy(*keys).agg(F.median("_v").alias("median"))
    cold = rows.join(hot.select(*own), _on(keys, "_k_"), "left_anti").groupBy(*keys).agg(F.median("_v").alias("median"))
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    targets = hot.withColumn("_rank", F.explode(ranks)).withColumn("_left", F.col("_n")).withColumn("_at", F.col("_rank"))
    targets = _saved(targets.select(*own, "_rank", "_at", "_left", "_lo", "_hi"))
    found = []
    while True:
        settled = targets.where("_lo = _hi").select(*drop, "_rank", F.col("_lo").alias("_m"))
        few = targets.where(f"_lo < _hi AND _left <= {small}")
        open_ = targets.where(f"_lo < _hi AND _left > {small}")
        within = lambda t: rows.join(t, _on(keys, "_k_")).where(v.between(F.col("_lo"), F.col("_hi")))
        values = within(few).groupBy(*drop, "_rank", "_at").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
        found += [settled, values.select(*drop, "_rank", F.get("_s", F.col("_at").cast("int")).alias("_m"))]
        if open_.limit(1).count() == 0:
            break
        # halves, so that a range over all doubles doesn't overflow
        part = F.floor((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)
        sums = within(open_).withColumn("_bin", F.least(F.lit(bins - 1), part)).groupBy(*drop, "_rank", "_at", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*drop, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = sums.withColumn("_b", before).where((F.col("_b") <= F.col("_at")) & (F.col("_at") < F.col("_b") + F.col("_c")))
        targets = _saved(held.select(*drop, "_rank", (F.col("_at") - F.col("_b")).alias("_at"), F.col("_c").alias("_left"), "_lo", "_hi"))
    middle = found[0]
    for f in found[1:]:
        middle = middle.unionByName(f)
    # the mean of the one or two middle values; halves again
    middle = middle.groupBy(*drop).agg((F.min("_m") / 2 + F.max("_m") / 2).alias("median"))
    return cold.unionByName(middle.select(*[F.col(f"_k_{c}").alias(c) for c in keys], "median"))


def bin_stats(df: DataFrame, x: str, y: str, z: str, x0: float, y0: float, dx: float, dy: float, small: int = SMALL) -> DataFrame:
    """Per cell: median, mean and number of z. Cells without rows are absent; nulls and NaN are skipped. Medians by exact_medians, so that a popular cell isn't one task."""
    keyed = df.select(digit(F.col(x), x0, dx).alias("ix"), digit(F.col(y), y0, dy).alias("iy"), F.col(z).alias("z")).where("z IS NOT NULL AND NOT isnan(z) AND ix IS NOT NULL AND iy IS NOT NULL")
    return exact_medians(keyed, ["ix", "iy"], "z", small).join(keyed.groupBy("ix", "iy").agg(F.avg("z").alias("mean"), F.count("z").alias("n")), ["ix", "iy"])


def _on(keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def sigma_cuts(df: DataFrame, keys: list[str], value: str, k: float = 3.0, population: bool = False, rounds: int = 1, least: int = 3) -> DataFrame:
    """(_k_ keys, cut, settled): per group the largest |value| that `rounds` passes of the sigma edit keep (null: all). Rows are summed up before they move; only groups are joined.

    settled tells whether the last pass changed nothing.
    """
    own = [F.col(c).alias(f"_k_{c}") for c in keys]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = None
    for _ in range(rounds):
        # rows beyond the cut stay as nulls, so that an emptied group keeps its place and its cut
        joined = rows.withColumn("cut", F.lit(None).cast("double")) if cuts is None else rows.join(cuts, _on(keys, "_k_"))
        left = F.when(F.col("cut").isNull() | (F.abs("_v") <= F.col("cut")), F.col("_v"))
        sd = F.stddev_pop("_l") if population else F.stddev_samp("_l")
        sums = joined.withColumn("_l", left).groupBy(*keys).agg(F.first("cut").alias("_b"), F.count("_l").alias("_n"), sd.alias("_s"), F.max(F.abs("_l")).alias("_m"))
        cut = F.when(F.col("_n") < least, F.col("_b")).otherwise(F.least(F.col("_b"), k * F.col("_s")))
        cuts = sums.select(*own, cut.alias("cut"), F.coalesce(F.col("_m") <= cut, F.lit(True)).alias("settled"))
    return cuts


def edit_sigma(df: DataFrame, keys: list[str], value: str, k: float = 3.0, flag: str = "ok", population: bool = False) -> DataFrame:
    """Adds `flag`: whether |value| is at most k standard deviations of its group. The cut is about zero; groups of one or two values keep all."""
    cuts = sigma_cuts(df, keys, value, k, population)
    ok = F.col(value).isNotNull() & F.coalesce(F.abs(F.col(value)) <= F.col("cut"), F.lit(True))
    return df.join(cuts, _on(keys, "_k_"), "left").withColumn(flag, ok).drop(*[f"_k_{c}" for c in keys], "cut", "settled")


def final_sigma_cuts(df: DataFrame, keys: list[str], value: str, k: float = 3.0, least: int = 3, small: int = SMALL) -> DataFrame:
    """(_k_ keys, cut): per group the largest |value| that the sigma edit keeps when it is repeated until nothing changes or fewer than `least` values are left (null: all).

    A group whose first pass changes nothing is done after it, by sums. One with up to `small` values is finished in a task; a larger one goes through passes of
    sums, each over the values that the last one left in groups that aren't settled, so its rows stay spread over the tasks, until it is down to `small`. The deviation is about
    the mean and the cut about zero, so a later cut can be wider than an earlier one: the least of all passes holds.
    """
    own = [f"_k_{c}" for c in keys]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col(value).cast("double").alias("_v"))

    def sums(left: DataFrame) -> DataFrame:
        s = left.groupBy(*own).agg(F.count("_v").alias("_n"), F.stddev_samp("_v").alias("_s"), F.max(F.abs("_v")).alias("_m"))
        cut = F.when(F.col("_n") >= least, k * F.col("_s"))
        return _saved(s.select(*own, "_n", cut.alias("cut"), F.coalesce(F.col("_m") <= cut, F.lit(True)).alias("settled")))

    def finish(pdf):
        v = pdf["_v"].to_numpy()
        cut = None
        while len(v) >= least:
            now = k * v.std(ddof=1)
            cut = now if cut is None else min(cut, now)
            kept = v[abs(v) <= cut]
            if len(kept) == len(v):
                break
            v = kept
        return pdf.iloc[:1][own].assign(cut=cut if cut is None else float(cut))

    def of(groups: DataFrame) -> DataFrame:
        g = groups.select(*[F.col(c).alias(f"_g{c}") for c in own], "cut")
        on = F.lit(True)
        for c in own:
            on = on & F.col(c).eqNullSafe(F.col(f"_g{c}"))
        return rows.join(g, on).where(F.abs("_v") <= F.col("cut")).select(*own, "_v")

    first = sums(rows)
    cuts = first.select(*own, "cut")
    open_ = first.where("NOT settled")
    schema = rows.select(*own).schema.add("cut", "double")
    while True:
        few = of(open_.where(F.col("_n") <= small))
        cuts = cuts.unionByName(few.groupBy(*own).applyInPandas(finish, schema))
        open_ = open_.where(F.col("_n") > small)
        if open_.limit(1).count() == 0:
            break
        rows = _saved(of(open_))
        now = sums(rows)
        cuts = cuts.unionByName(now.select(*own, "cut"))
        open_ = now.where("NOT settled")
    return cuts.groupBy(*own).agg(F.min("cut").alias("cut"))


def edit_sigma_repeated(df: DataFrame, keys: list[str], value: str, k: float = 3.0, flag: str = "ok", small: int = SMALL) -> DataFrame:
    """edit_sigma again on what is left, until nothing changes in a group or fewer than three values are left, however many passes that takes (final_sigma_cuts)."""
    cuts = final_sigma_cuts(df, keys, value, k, small=small)
    ok = F.col(value).isNotNull() & F.coalesce(F.abs(F.col(value)) <= F.col("cut"), F.lit(True))
    return df.join(cuts, _on(keys, "_k_"), "left").withColumn(flag, ok).drop(*[f"_k_{c}" for c in keys], "cut")


def _edit_dealt(df: DataFrame, keys: list[str], value: str, k: float, rounds: int) -> DataFrame:
    """The edit as windows, for rows that are dealt by (a part of) the keys already."""
    w, left = Window.partitionBy(*keys), F.col(value)
    for i in range(rounds):
        n, sd = F.count(left).over(w), F.stddev_samp(left).over(w)
        df = df.withColumn(f"_left{i}", F.when((n < 3) | (F.abs(left) <= k * sd), left))
        left = F.col(f"_left{i}")
    return df.withColumn("ok", left.isNotNull()).drop(*[f"_left{i}" for i in range(rounds)])


def _spread(value: Column, cls: Column) -> Column:
    """Sample deviation of a class; a tenth of the value where there is one."""
    own = F.when(cls, value)
    return F.when(F.count(own) == 1, 0.1 * F.abs(F.max(own))).otherwise(F.stddev_samp(own))


def _either(both: Column, one: Column, two: Column, n1: Column, n2: Column, use_all: bool) -> Column:
    out = F.when((n1 > 0) & (n2 > 0), both)
    return out.when(n1 > 0, one).when(n2 > 0, two) if use_all else out


def weighted_mean(value: Column, one: Column, two: Column, use_all: bool = True, median: bool = True) -> Column:
    """An aggregate: the mean of two classes' medians (or means), weighted by their numbers."""
    mid = F.median if median else F.avg
    a, b = F.when(one, value), F.when(two, value)
    n1, n2 = F.count(a), F.count(b)
    return _either((n1 * mid(a) + n2 * mid(b)) / (n1 + n2), mid(a), mid(b), n1, n2, use_all)


def ordinary_mean(value: Column, one: Column, two: Column, use_all: bool = True) -> Column:
    a, b = F.when(one, value), F.when(two, value)
    return _either((F.avg(a) + F.avg(b)) / 2, F.avg(a), F.avg(b), F.count(a), F.count(b), use_all)


def weighted_error(value: Column, one: Column, two: Column, use_all: bool = True) -> Column:
    """An aggregate: sqrt(n1 * s1**2 + n2 * s2**2) / (n1 + n2), or s / sqrt(n) of the only class."""
    n1, n2 = F.count(F.when(one, value)), F.count(F.when(two, value))
    s1, s2 = _spread(value, one), _spread(value, two)
    return _either(F.sqrt(n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2), s1 / F.sqrt(n1), s2 / F.sqrt(n2), n1, n2, use_all)


def class_difference(value: Column, one: Column, two: Column, use_all: bool = True) -> Column:
    """An aggregate: |mean1 - mean2|, or the deviation of the only class."""
    a, b = F.when(one, value), F.when(two, value)
    return _either(F.abs(F.avg(a) - F.avg(b)), _spread(value, one), _spread(value, two), F.count(a), F.count(b), use_all)


def pair_filter(sat: Column, mode1: Column, mode2: Column, border1: Column, border2: Column, tide1: Column, tide2: Column, ice_only: bool = True) -> Column:
    """Pairs off the border with tides, in ice mode (ers1, ers2; any same mode without ice_only) or fine mode (envi)."""
    both = lambda m: (mode1 == m) & (mode2 == m)
    mode = F.when(sat.isin("ers1", "ers2"), both(1) if ice_only else both(0) | both(1)).when(sat == "envi", both(0)).otherwise(False)
    return mode & (border1 == 0) & (border2 == 0) & (tide1 != -9999) & (tide2 != -9999)


def _class_stats(rows: DataFrame, cell: list[str], use_all: bool, median: bool, small: int) -> DataFrame:
    """What cell_change returns, of edited rows (cell, cls, dh, dg), by aggregations that sum up in each task and medians by exact_medians."""
    ad, da = F.col("cls") == "ad", F.col("cls") == "da"
    out = rows.groupBy(*cell).agg(
        *[f(F.when(c, F.col(v))).alias(f"_{v}_{c_}_{name}") for v in ("dh", "dg") for c_, c in (("ad", ad), ("da", da)) for name, f in (("n", F.count), ("avg", F.avg))],
        *[_spread(F.col(v), c).alias(f"_{v}_{c_}_sd") for v in ("dh", "dg") for c_, c in (("ad", ad), ("da", da))],
        F.count(F.when(ad, 1)).alias("n_ad"), F.count(F.when(da, 1)).alias("n_da"),
    ).select(*[F.col(c).alias(f"_k_{c}") for c in cell], "*").drop(*cell)
    for v in ("dh", "dg") if median else ():
        mid = exact_medians(rows, [*cell, "cls"], v, small).groupBy(*cell).agg(*[F.max(F.when(F.col("cls") == c, F.col("median"))).alias(f"_{v}_{c}_mid") for c in ("ad", "da")])
        out = mid.join(out, _on(cell, "_k_"), "right").drop(*cell)
    columns = []
    for v in ("dh", "dg"):
        n1, n2, a1, a2, s1, s2 = (F.col(f"_{v}_{c}_{k}") for k in ("n", "avg", "sd") for c in ("ad", "da"))
        m1, m2 = (F.col(f"_{v}_{c}_mid") for c in ("ad", "da")) if median else (a1, a2)
        columns += [
            _either((n1 * m1 + n2 * m2) / (n1 + n2), m1, m2, n1, n2, use_all).alias(f"{v}_mean"),
            _either(F.sqrt(n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2), s1 / F.sqrt(n1), s2 / F.sqrt(n2), n1, n2, use_all).alias(f"{v}_error"),
            _either(F.abs(a1 - a2), s1, s2, n1, n2, use_all).alias(f"{v}_error2"),
        ]
    return out.select(*[F.col(f"_k_{c}").alias(c) for c in cell], *columns, "n_ad", "n_da")


def _change_of_popular(rows: DataFrame, cell: list[str], k: float, rounds: int, use_all: bool, median: bool, small: int) -> DataFrame:
    """The edit and the statistics of cells with many rows: sums per group are joined back, and no row is gathered by its cell."""
    groups = [*cell, "cls"]
    cuts = sigma_cuts(rows, groups, "dh", k, rounds=rounds).drop("settled")
    edited = rows.join(cuts, _on(groups, "_k_")).withColumn("ok", F.coalesce(F.abs("dh") <= F.col("cut"), F.lit(True))).drop(*[f"_k_{c}" for c in groups], "cut")
    any_ok = edited.groupBy(*[F.col(c).alias(f"_k_{c}") for c in cell]).agg(F.max("ok").alias("any_ok"))
    edited = edited.join(any_ok, _on(cell, "_k_")).where("ok OR NOT any_ok").select(*groups, "dh", "dg")
    return _class_stats(_saved(edited), cell, use_all, median, small)


def cell_change(
    pairs: DataFrame, keys: list[str], x0: float, y0: float, dx: float, dy: float, most: float = 15.0, k: float = 3.0, use_all: bool = True,
    median: bool = True, rounds: int = 1, small: int = SMALL,
) -> DataFrame:
    """Elevation and backscatter change per key and cell, from filtered pairs.

    Cells of over `small` rows (a count per cell tells, before anything else) are edited and summed up without gathering them; the others as follows.

    pairs: keys, lon, lat, h1, h2, tide1, tide2, g1, g2, ftrk1, ftrk2 (0 ascending, 1 descending). dh is corrected for tides; values over `most` go, then the sigma edit per class. If it
    empties both classes of a cell, the values before it stay. dg follows dh's rows. One shuffle on (keys, cell): the edit's window, the rule and the final aggregation share it.
    """
    cell = [*keys, "iy", "ix"]
    p = pairs.select(
        *keys,
        digit(F.col("lon"), x0, dx).alias("ix"),
        digit(F.col("lat"), y0, dy).alias("iy"),
        F.when((F.col("ftrk2") == 0) & (F.col("ftrk1") == 1), "ad").when((F.col("ftrk2") == 1) & (F.col("ftrk1") == 0), "da").alias("cls"),
        ((F.col("h2") - F.col("tide2")) - (F.col("h1") - F.col("tide1"))).alias("dh"),
        (F.col("g2") - F.col("g1")).alias("dg"),
    ).where((F.abs("dh") <= most) & F.col("cls").isNotNull() & F.col("ix").isNotNull() & F.col("iy").isNotNull())
    popular = _saved(p.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select(*[F.col(c).alias(f"_k_{c}") for c in cell]))
    apart = None
    if popular.limit(1).count():
        apart = _change_of_popular(p.join(popular, _on(cell, "_k_"), "left_semi"), cell, k, rounds, use_all, median, small)
        p = p.join(popular, _on(cell, "_k_"), "left_anti")
    # dealt by the cell, so that the windows over (cell, class) and over the cell need no other exchange
    p = p.repartition(*cell)
    p = _edit_dealt(p, [*cell, "cls"], "dh", k, rounds)
    p = p.withColumn("any_ok", F.max("ok").over(Window.partitionBy(*cell))).where("ok OR NOT any_ok")
    ad, da = F.col("cls") == "ad", F.col("cls") == "da"
    aggs = []
    for v in ("dh", "dg"):
        c = F.col(v)
        aggs += [
            weighted_mean(c, ad, da, use_all, median).alias(f"{v}_mean"), weighted_error(c, ad, da, use_all).alias(f"{v}_error"),
            class_difference(c, ad, da, use_all).alias(f"{v}_error2"),
        ]
    out = p.groupBy(*cell).agg(*aggs, F.count(F.when(ad, 1)).alias("n_ad"), F.count(F.when(da, 1)).alias("n_da"))
    return out if apart is None else out.unionByName(apart)
