"""Queries of ordered operators: tracks, differences, windows, series filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..operators import tracks as T
from .views import POINTS, SERIES, points, series, tidy

_GAP = 200000.0


def split(spark, d):
    t = T.split_tracks(points(spark, d), "track", "time", "lat", ["time", "recno"], _GAP)
    return tidy(t.select("track", "recno", "segment", "ftrk"))


_SPLIT = f"""WITH {POINTS}, a AS (SELECT *, row_number() OVER w AS i, lead(time) OVER w IS NULL AS final, CASE WHEN lag(time) OVER w IS NULL OR time - lag(time) OVER w > {_GAP} THEN 1 ELSE 0 END AS fresh
  FROM pt WINDOW w AS (PARTITION BY track ORDER BY time, recno)),
b AS (SELECT *, sum(CASE WHEN final AND i > 1 THEN 0 ELSE fresh END) OVER (PARTITION BY track ORDER BY i) AS segment FROM a),
m AS (SELECT track, segment, min(i) AS i0, max(i) AS i1, min(lat) AS low FROM b WHERE NOT final GROUP BY ALL),
l AS (SELECT m.*, (SELECT min(i) FROM b WHERE b.track = m.track AND b.segment = m.segment AND NOT final AND b.lat = m.low) AS il FROM m),
f AS (SELECT b.*, CASE WHEN i0 = il THEN 0 WHEN il = i1 THEN 1 WHEN i <= il THEN 1 ELSE 0 END AS flag FROM b LEFT JOIN l USING (track, segment))
SELECT track, recno, segment::BIGINT AS segment, (CASE WHEN final THEN lag(flag) OVER (PARTITION BY track ORDER BY i) ELSE flag END)::BIGINT AS ftrk FROM f"""


def difference(spark, d):
    return tidy(T.along_track_difference(points(spark, d), "track", "time", "elev", ["time", "recno"], _GAP).select("track", "recno", "dt", "diff"))


def slope(spark, d):
    return tidy(T.along_track_slope(points(spark, d).withColumn("lat", F.col("lat") / 10), "track", "time", "lon", "lat", "elev", ["time", "recno"], _GAP).withColumn("time", F.floor("time")), 4)


_SLOPE = f"""WITH {POINTS}, a AS (SELECT track, time, lon, lat / 10 AS lat, elev, lead(time) OVER w AS t2, lead(lon) OVER w AS lon2, lead(lat / 10) OVER w AS lat2, lead(elev) OVER w AS e2
  FROM pt WINDOW w AS (PARTITION BY track ORDER BY time, recno)), b AS (SELECT *, sqrt((lon2 - lon) ** 2 + (lat2 - lat) ** 2) * 111300 AS far,
  degrees(atan2((lon2 - lon) * cos(radians((lat2 + lat) / 2)), lat2 - lat)) AS az FROM a WHERE t2 - time < {_GAP})
SELECT track, floor((t2 + time) / 2)::BIGINT AS time, round((lon2 + lon) / 2, 4) + 0.0 AS lon, round((lat2 + lat) / 2, 4) + 0.0 AS lat, round(CASE WHEN far > 0 THEN (e2 - elev) / far * 1e6 END, 4) + 0.0 AS slope,
  round(CASE WHEN az < 0 THEN az + 360 ELSE az END, 4) + 0.0 AS azimuth, round(t2 - time, 4) + 0.0 AS dt FROM b"""


def repeats(spark, d):
    return T.drop_repeats(points(spark, d), "track", ["kind"], ["time", "recno"]).select("track", "recno", "kind")


def _w():
    return Window.partitionBy("cell").orderBy("t")


def first(spark, d):
    w = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tidy(series(spark, d).select("cell", "t", (F.col("g") - F.first("g", True).over(w)).alias("to_first"), (F.col("g") - F.avg("g").over(w)).alias("to_mean")))


def first_index(spark, d):
    return tidy(series(spark, d).groupBy("cell").agg(F.min(F.when(F.col("g").isNotNull(), F.col("t"))).alias("first_t")))


def roll(spark, d):
    return tidy(series(spark, d).select("cell", "t", S.rolling_mean(F.col("v"), _w(), 3).alias("mean")))


def gradient(spark, d):
    return tidy(series(spark, d).select("cell", "t", S.gradient(F.col("v"), _w(), 0.25).alias("slope")))


def rate(spark, d):
    s = series(spark, d).groupBy("cell").agg(((F.max_by("v", "t") - F.min_by("v", "t")) / (F.max("t") - F.min("t"))).alias("rate"))
    return tidy(s)


def steps(spark, d):
    return tidy(S.step_filter(series(spark, d), "cell", "t", "v", 0.8, 5).select("cell", "t", "median", "filtered"))


_STEPS = f"""WITH {SERIES}, a AS (SELECT cell, t, v, row_number() OVER (PARTITION BY cell ORDER BY t) AS i, count(*) OVER (PARTITION BY cell) AS n FROM se),
k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k), p AS (SELECT a.cell, a.t, a.i, a.v, b.v AS x FROM a, k JOIN a AS b ON b.cell = a.cell AND b.i = least(greatest(a.i + k.k, 1), a.n)),
m AS (SELECT cell, t, i, v, median(x) AS m FROM p GROUP BY ALL), j AS (SELECT *, m - lag(m) OVER (PARTITION BY cell ORDER BY i) AS jump FROM m)
SELECT cell, t, round(m, 6) + 0.0 AS median, round(v - sum(CASE WHEN abs(jump) > 0.8 THEN jump ELSE 0 END) OVER (PARTITION BY cell ORDER BY i), 6) + 0.0 AS filtered FROM j"""


def interpolate(spark, d):
    return tidy(S.resample(series(spark, d).where("t % 5 <> 2"), "cell", "t", "v", 2))


_INTERP = f"""WITH {SERIES}, a AS (SELECT cell, t, v, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM se WHERE t % 5 <> 2 AND v IS NOT NULL WINDOW w AS (PARTITION BY cell ORDER BY t)),
g AS (SELECT DISTINCT range * 2 AS x FROM range(0, 60)) SELECT cell, x AS t, round(CASE WHEN x = a.t THEN v ELSE v + (v2 - v) * (x - a.t) / (t2 - a.t) END, 6) + 0.0 AS v
FROM a JOIN g ON x >= a.t AND (x < t2 OR (t2 IS NULL AND x = a.t))"""


def percent(spark, d):
    s = series(spark, d)
    share = F.count("g").over(Window.partitionBy("cell")) / F.count(F.lit(1)).over(Window.partitionBy("cell"))
    return tidy(s.select("cell", "t", F.when(share >= 0.98, F.col("g")).alias("g")))


def tail_difference(spark, d):
    """Mean of the last 3 values of each cell minus the first 3 of the cell after it, in place."""
    s = series(spark, d)
    a = s.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("t")))).where("r <= 3").select("cell", (4 - F.col("r")).alias("i"), "v")
    b = s.withColumn("i", F.row_number().over(_w())).where("i <= 3").select((F.col("cell") - 1).alias("cell"), "i", F.col("v").alias("w"))
    return tidy(a.join(b, ["cell", "i"]).groupBy("cell").agg(F.avg(F.col("v") - F.col("w")).alias("offset")))


def sliding(spark, d):
    """Sliding correlation and slope of v over g in frames of nine rows."""
    w = _w().rowsBetween(-4, 4)
    return tidy(series(spark, d).select("cell", "t", F.count(F.lit(1)).over(w).alias("n"), F.regr_slope("v", "g").over(w).alias("s")).where("n = 9"), 4)


def bins(spark, d):
    return tidy(series(spark, d).groupBy("cell", F.floor(F.col("t") / 3).alias("quarter")).agg(F.avg("v").alias("mean")))


def top3(spark, d):
    p = points(spark, d).groupBy("track").agg(F.count(F.when(F.col("kind") == "click", 1)).alias("n"))
    return tidy(p.orderBy(F.desc("n"), "track").limit(3))


QUERIES = [
    ("OP-WIN-TRACK", split, _SPLIT),
    ("OP-WIN-DIFF", difference, f"""WITH {POINTS}, a AS (SELECT track, recno, lead(time) OVER w - time AS dt, lead(elev) OVER w - elev AS dv FROM pt WINDOW w AS (PARTITION BY track ORDER BY time, recno))
  SELECT track, recno, round(dt, 6) + 0.0 AS dt, round(CASE WHEN dt < {_GAP} THEN dv END, 6) + 0.0 AS diff FROM a WHERE dt IS NOT NULL"""),
    ("OP-WIN-GRAD", slope, _SLOPE),
    ("OP-WIN-DEDUP", repeats, f"""WITH {POINTS} SELECT track, recno, kind FROM (SELECT *, lag(kind) OVER w AS k, lag(1) OVER w AS b FROM pt WINDOW w AS (PARTITION BY track ORDER BY time, recno))
  WHERE b IS NULL OR k IS DISTINCT FROM kind"""),
    ("OP-WIN-FIRST", first, f"""WITH {SERIES} SELECT cell, t, round(g - first_value(g IGNORE NULLS) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) + 0.0 AS to_first,
  round(g - avg(g) OVER (PARTITION BY cell), 6) + 0.0 AS to_mean FROM se"""),
    ("OP-WIN-FIRSTIDX", first_index, f"WITH {SERIES} SELECT cell, min(t) FILTER (g IS NOT NULL) AS first_t FROM se GROUP BY cell"),
    ("OP-WIN-ROLLMEAN", roll, f"""WITH {SERIES} SELECT cell, t, round(CASE WHEN count(v) OVER w = 7 THEN avg(v) OVER w END, 6) + 0.0 AS mean FROM se
  WINDOW w AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""),
    ("OP-WIN-GRADIENT", gradient, f"""WITH {SERIES} SELECT cell, t, round(CASE WHEN lead(v) OVER w IS NULL THEN (v - lag(v) OVER w) / 0.25 WHEN lag(v) OVER w IS NULL THEN (lead(v) OVER w - v) / 0.25
  ELSE (lead(v) OVER w - lag(v) OVER w) / 0.5 END, 6) + 0.0 AS slope FROM se WINDOW w AS (PARTITION BY cell ORDER BY t)"""),
    ("OP-WIN-RATE", rate, f"WITH {SERIES} SELECT cell, round((arg_max(v, t) - arg_min(v, t)) / (max(t) - min(t)), 6) + 0.0 AS rate FROM se GROUP BY cell"),
    ("OP-WIN-ROLLMED", steps, _STEPS),
    ("OP-WIN-INTERP", interpolate, _INTERP),
    ("OP-FILT-PERC", percent, f"WITH {SERIES} SELECT cell, t, round(CASE WHEN count(g) OVER (PARTITION BY cell) / count(*) OVER (PARTITION BY cell) >= 0.98 THEN g END, 6) + 0.0 AS g FROM se"),
    ("OP-WIN-TAILDIFF", tail_difference, f"""WITH {SERIES}, a AS (SELECT cell, v, 4 - row_number() OVER (PARTITION BY cell ORDER BY t DESC) AS i FROM se QUALIFY i >= 1),
  b AS (SELECT cell - 1 AS cell, v AS w, row_number() OVER (PARTITION BY cell ORDER BY t) AS i FROM se QUALIFY i <= 3) SELECT cell, round(avg(v - w), 6) + 0.0 AS "offset" FROM a JOIN b USING (cell, i) GROUP BY cell"""),
    ("OP-WIN-BSVAR", sliding, f"""WITH {SERIES} SELECT * FROM (SELECT cell, t, count(*) OVER w AS n, round(regr_slope(v, g) OVER w, 4) + 0.0 AS s FROM se
  WINDOW w AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) WHERE n = 9"""),
    ("OP-WIN-QTRRESAMP", bins, f"WITH {SERIES} SELECT cell, floor(t / 3)::BIGINT AS quarter, round(avg(v), 6) + 0.0 AS mean FROM se GROUP BY ALL"),
    ("OP-TOPK", top3, f"WITH {POINTS} SELECT track, count(*) FILTER (kind = 'click') AS n FROM pt GROUP BY track ORDER BY n DESC, track LIMIT 3"),
]
