"""Ordered operators along tracks, and the crossover join of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch


def split_tracks(points: DataFrame, track: str, time: str, lat: str, order: list[str], gap: float = 10.0) -> DataFrame:
    """Adds segment (runs without a time gap above `gap`) and ftrk (0 ascending, 1 descending) to points of each track.

    In a segment the first smallest latitude turns the track: a segment that starts there ascends, one that ends there descends; else the part up to it has flag 0 if it starts below it
    and 1 otherwise (it cannot start below its minimum), and the part after it the other flag. The last point of a track is judged with its predecessor.
    Tracks of one point get flag null. Segments are found over all points of a track but the last one, whose flag is copied.
    """
    w = Window.partitionBy(track).orderBy(*order)
    df = points.withColumn("_last", F.lead(time).over(w).isNull()).withColumn(
        "_new", F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap), 1).otherwise(0)
    )
    df = df.withColumn("_i", F.row_number().over(w))
    df = df.withColumn("segment", F.sum(F.when(F.col("_last") & (F.col("_i") > 1), 0).otherwise(F.col("_new"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(track, "segment")
    # the last point takes no part in finding the minimum
    low = F.min(F.when(~F.col("_last"), F.struct(F.col(lat).alias("lat"), F.col("_i").alias("i")))).over(seg)
    first, end = F.min(F.when(~F.col("_last"), F.col("_i"))).over(seg), F.max(F.when(~F.col("_last"), F.col("_i"))).over(seg)
    df = df.withColumn("_low", low["i"]).withColumn("_first", first).withColumn("_end", end)
    flag = (
        F.when(F.col("_first") == F.col("_low"), 0)
        .when(F.col("_low") == F.col("_end"), 1)
        .when(F.col("_i") <= F.col("_low"), 1)
        .otherwise(0)
    )
    df = df.withColumn("_flag", flag)
    return df.withColumn("ftrk", F.when(F.col("_last"), F.lag("_flag").over(w)).otherwise(F.col("_flag"))).drop("_last", "_new", "_i", "_low", "_first", "_end", "_flag")


def along_track_difference(points: DataFrame, track: str, time: str, value: str, order: list[str], gap: float) -> DataFrame:
    """Per point but the last of a track: the next value minus this one, null across gaps of `gap` or more."""
    w = Window.partitionBy(track).orderBy(*order)
    step = F.lead(time).over(w) - F.col(time)
    return points.withColumn("dt", step).withColumn("diff", F.when(step < gap, F.lead(value).over(w) - F.col(value))).where("dt IS NOT NULL")


def along_track_slope(points: DataFrame, track: str, time: str, lon: str, lat: str, value: str, order: list[str], gap: float = 2.0) -> DataFrame:
    """Slopes in microradians between consecutive points less than `gap` apart: midpoint, mean time, azimuth from 0 to 360 (with the cosine of latitude), planar distance without it."""
    w = Window.partitionBy(track).orderBy(*order)
    nxt = lambda c: F.lead(c).over(w)
    dx, dy = nxt(lon) - F.col(lon), nxt(lat) - F.col(lat)
    far = F.hypot(dx, dy) * 111300
    az = F.degrees(F.atan2(dx * F.cos(F.radians((nxt(lat) + F.col(lat)) / 2)), dy))
    out = points.select(
        track,
        ((nxt(time) + F.col(time)) / 2).alias("time"),
        ((nxt(lon) + F.col(lon)) / 2).alias("lon"),
        ((nxt(lat) + F.col(lat)) / 2).alias("lat"),
        F.when((far > 0), (nxt(value) - F.col(value)) / far * 1e6).alias("slope"),
        F.when(az < 0, az + 360).otherwise(az).alias("azimuth"),
        (nxt(time) - F.col(time)).alias("dt"),
    )
    return out.where(F.col("dt") < gap)


def drop_repeats(points: DataFrame, track: str, columns: list[str], order: list[str]) -> DataFrame:
    """Drops rows that equal the row before in all of the columns."""
    w = Window.partitionBy(track).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return points.withColumn("_same", same & F.lag(F.lit(1)).over(w).isNotNull()).where("NOT _same").drop("_same")


def track_pairs(tracks: DataFrame, sector: str, name: str, date: str, direction: str) -> DataFrame:
    """All pairs of tracks of a sector with different dates and directions, the smaller name first."""
    a, b = tracks.alias("a"), tracks.alias("b")
    on = (F.col(f"a.{sector}") == F.col(f"b.{sector}")) & (F.col(f"a.{name}") < F.col(f"b.{name}")) & (F.col(f"a.{direction}") != F.col(f"b.{direction}")) & (
        F.col(f"a.{date}") != F.col(f"b.{date}")
    )
    return a.join(b, on).select(F.col(f"a.{sector}").alias(sector), F.col(f"a.{name}").alias("first"), F.col(f"b.{name}").alias("second"))


def segments(points: DataFrame, track: str, order: list[str], values: list[str], time: str, gap: float) -> DataFrame:
    """Consecutive points of a track less than `gap` apart as segments x1, y1, x2, y2 with values at both ends."""
    w = Window.partitionBy(track).orderBy(*order)
    cols = [F.col(track).alias("track")]
    for c in ["x", "y", time, *values]:
        cols += [F.col(c).alias(f"{c}_1"), F.lead(c).over(w).alias(f"{c}_2")]
    return points.select(*cols).where(F.col(f"{time}_2") - F.col(f"{time}_1") < gap)


def _saved(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tiles(s: DataFrame, size: float) -> DataFrame:
    """A row per tile of the plane that a segment's bounding box touches."""
    span = lambda c: F.sequence(F.floor(F.least(f"{c}_1", f"{c}_2") / size), F.floor(F.greatest(f"{c}_1", f"{c}_2") / size))
    return s.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))


def _below(s: DataFrame, cut: DataFrame, size: float) -> DataFrame:
    """Segments in the tiles (tx, ty) of `cut` as a row per part of side `size`, a quarter of the tile's, that their boxes touch."""

    def part(c: str, of: str) -> Column:
        low, high = F.floor(F.least(f"{c}_1", f"{c}_2") / size), F.floor(F.greatest(f"{c}_1", f"{c}_2") / size)
        return F.sequence(F.greatest(low, F.col(of) * 4), F.least(high, F.col(of) * 4 + 3))

    t = s.join(cut.select("tx", "ty"), ["tx", "ty"]).withColumnsRenamed({"tx": "_px", "ty": "_py"})
    return t.withColumn("tx", F.explode(part("x", "_px"))).withColumn("ty", F.explode(part("y", "_py"))).drop("_px", "_py")


def leaf_tiles(one: DataFrame, two: DataFrame, tile: float, most: int, depth: int = 6) -> tuple[DataFrame, list[DataFrame]]:
    """(level, tx, ty, a, b) of the tiles in which segments of both sides meet, with their numbers, and per level the tiles that are cut into parts of the next.

    A tile of side `tile` in which over `most` pairs of segments would meet is cut into sixteen, and so are its parts, as long as that leaves less than three quarters of the pairs or
    copies few segments (a dense place within one part). Segments that all cross one place can't be told apart by tiles, and their pairs are dealt over several tasks instead (crossovers).
    """
    box = lambda s, side: s.select("x_1", "x_2", "y_1", "y_2", F.lit(side).alias("_side"))
    now = _tiles(box(one, 1).unionByName(box(two, 0)), tile)
    leaves, heavy, cuts = None, None, []
    pairs, rows = F.col("a") * F.col("b"), F.col("a") + F.col("b")
    for level in range(depth + 1):
        work = _saved(now.groupBy("tx", "ty").agg(F.sum("_side").alias("a"), F.sum(1 - F.col("_side")).alias("b")).where("a > 0 AND b > 0"))
        if level:
            up = work.groupBy(F.floor(F.col("tx") / 4).alias("_ux"), F.floor(F.col("ty") / 4).alias("_uy")).agg(F.sum(pairs).alias("_pairs"), F.sum(rows).alias("_rows"))
            # a dense tile whose parts hold no pair is cut as well: it has no crossing
            gain = F.coalesce((F.col("_pairs") < 0.75 * pairs) | (F.col("_rows") < 1.5 * rows), F.lit(True))
            judged = _saved(heavy.join(up, (F.col("tx") == F.col("_ux")) & (F.col("ty") == F.col("_uy")), "left").select("tx", "ty", "a", "b", gain.alias("gain")))
            leaves = leaves.unionByName(judged.where("NOT gain").drop("gain").withColumn("level", F.lit(level - 1)))
            cut = judged.where("gain").select(F.col("tx").alias("_ux"), F.col("ty").alias("_uy"))
            cuts.append(judged.where("gain").select("tx", "ty"))
            work = work.join(cut, (F.floor(F.col("tx") / 4) == F.col("_ux")) & (F.floor(F.col("ty") / 4) == F.col("_uy")), "left_semi")
        large = (pairs > most) if level < depth else F.lit(False)
        some = work.where(~large).withColumn("level", F.lit(level))
        leaves, heavy = some if leaves is None else leaves.unionByName(some), work.where(large)
        if not heavy.limit(1).count():
            break
        now = _saved(_below(now, heavy, tile / 4 ** (level + 1)))
    return leaves, cuts


def _dealt(s: DataFrame, side: str, leaves: DataFrame, cuts: list[DataFrame], tile: float, most: int) -> DataFrame:
    """Segments with the leaf tiles that their boxes touch and the task that they go to there: the larger side is dealt, the other copied."""
    now = _tiles(s, tile)
    t = now.withColumn("level", F.lit(0))
    for level, cut in enumerate(cuts, 1):
        now = _below(now, cut, tile / 4**level)
        t = t.unionByName(now.withColumn("level", F.lit(level)))
    shares = F.ceil(F.col("a") * F.col("b") / most)
    t = t.join(leaves.select("level", "tx", "ty", shares.alias("_n"), ((F.col("a") >= F.col("b")) if side == "a" else (F.col("b") > F.col("a"))).alias("_split")), ["level", "tx", "ty"])
    own = F.pmod(F.xxhash64(*s.columns), F.col("_n"))
    return t.withColumn("_share", F.explode(F.when(F.col("_split"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))).drop("_n", "_split")


def crossovers(one: DataFrame, two: DataFrame, values: list[str], time: str, tile: float, most: int = 1 << 22) -> DataFrame:
    """Crossings of segments of two sets of tracks: place, and time and values of either track, linearly interpolated there.

    Segments meet in tiles (an equi-join); a crossing is kept in the tile that holds it, so that it comes once. Touching at the later end of a segment belongs to the next segment.
    Tiles in which over `most` pairs would meet are cut, and what cutting doesn't part is dealt over tasks (leaf_tiles). Segments with a null or non-finite end have no crossings.
    """
    cols = ["track", *[f"{c}_{k}" for c in ["x", "y", time, *values] for k in (1, 2)]]
    usable = " AND ".join(f"abs({c}_{k}) < double('inf')" for c in ("x", "y") for k in (1, 2))
    one, two = one.select(*cols).where(usable), two.select(*cols).where(usable)
    leaves, cuts = leaf_tiles(one, two, tile, most)
    at_tile = ["level", "tx", "ty", "_share"]
    a = _dealt(one, "a", leaves, cuts, tile, most).select(*at_tile, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = _dealt(two, "b", leaves, cuts, tile, most).select(*at_tile, *[F.col(c).alias(f"b_{c}") for c in cols])
    j = a.join(b, at_tile).where("a_track <> b_track")
    ux, uy = F.col("a_x_2") - F.col("a_x_1"), F.col("a_y_2") - F.col("a_y_1")
    vx, vy = F.col("b_x_2") - F.col("b_x_1"), F.col("b_y_2") - F.col("b_y_1")
    wx, wy = F.col("b_x_1") - F.col("a_x_1"), F.col("b_y_1") - F.col("a_y_1")
    det = ux * vy - uy * vx
    j = j.withColumn("s", F.when(det != 0, (wx * vy - wy * vx) / det)).withColumn("t", F.when(det != 0, (wx * uy - wy * ux) / det))
    j = j.where("s >= 0 AND s < 1 AND t >= 0 AND t < 1")
    at = lambda p, c, k: F.col(f"{p}_{c}_1") + F.col(k) * (F.col(f"{p}_{c}_2") - F.col(f"{p}_{c}_1"))
    out = j.withColumn("x", at("a", "x", "s")).withColumn("y", at("a", "y", "s"))

    def held(c: str, own: str) -> Column:
        """Whether the tile holds the crossing. Rounding may carry the place off the boxes of the segments, which would lose it: it is moved back for this test."""
        low = F.greatest(F.least(f"a_{c}_1", f"a_{c}_2"), F.least(f"b_{c}_1", f"b_{c}_2"))
        high = F.least(F.greatest(f"a_{c}_1", f"a_{c}_2"), F.greatest(f"b_{c}_1", f"b_{c}_2"))
        return F.floor(F.least(F.greatest(F.col(c), low), high) / (tile / F.expr("shiftleft(1L, 2 * level)"))) == F.col(own)

    out = out.where(held("x", "tx") & held("y", "ty"))
    pair: list[Column] = [F.col("a_track").alias("track1"), F.col("b_track").alias("track2"), F.col("x"), F.col("y")]
    for c in [time, *values]:
        pair += [at("a", c, "s").alias(f"{c}1"), at("b", c, "t").alias(f"{c}2")]
    return out.select(*pair)
