"""Queries of single steps: class statistics, cell numbers, filters, date and coordinate functions, backscatter by group, and tides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import cells as C
from ..operators import series as S
from ..operators import tides as T
from .views import INSTRUMENTS, POINTS, SERIES, instruments, points, series, table, tidy

def _by_part(aggregate):
    def run(spark, d):
        one, two = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
        return tidy(table(spark, d, "lineitem").groupBy("l_partkey").agg(aggregate(F.col("l_tax"), one, two).alias("v")))

    return run


_CLASSES = """cl AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'F') AS n1, count(*) FILTER (l_linestatus = 'O') AS n2, avg(l_tax) FILTER (l_linestatus = 'F') AS a1, avg(l_tax) FILTER (l_linestatus = 'O') AS a2,
  median(l_tax) FILTER (l_linestatus = 'F') AS m1, median(l_tax) FILTER (l_linestatus = 'O') AS m2,
  CASE WHEN count(*) FILTER (l_linestatus = 'F') = 1 THEN 0.1::DOUBLE * abs(max(l_tax) FILTER (l_linestatus = 'F')) ELSE stddev_samp(l_tax) FILTER (l_linestatus = 'F') END AS s1,
  CASE WHEN count(*) FILTER (l_linestatus = 'O') = 1 THEN 0.1::DOUBLE * abs(max(l_tax) FILTER (l_linestatus = 'O')) ELSE stddev_samp(l_tax) FILTER (l_linestatus = 'O') END AS s2 FROM lineitem GROUP BY 1)"""


def _class_sql(both: str, one: str, two: str) -> str:
    return f"WITH {_CLASSES} SELECT l_partkey, round(CASE WHEN n1 > 0 AND n2 > 0 THEN {both} WHEN n1 > 0 THEN {one} WHEN n2 > 0 THEN {two} END, 6) + 0.0 AS v FROM cl"


def counts(spark, d):
    """Numbers of both classes, null where one is absent; null values count."""
    n1, n2 = F.count(F.when(F.col("l_linestatus") == "F", 1)), F.count(F.when(F.col("l_linestatus") == "O", 1))
    both = (n1 > 0) & (n2 > 0)
    return tidy(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.when(both, n1).alias("n1"), F.when(both, n2).alias("n2")))


def digits(spark, d):
    t = table(spark, d, "lineitem").select(C.digit(F.col("l_quantity"), 0.5, 1.25).alias("ix"))
    return tidy(t.groupBy("ix").agg(F.count(F.lit(1)).alias("n")).withColumn("centre", C.bin_centre(F.col("ix"), 0.5, 1.25)))


def areas(spark, d):
    c = table(spark, d, "nation").selectExpr("n_nationkey", "-80 + n_nationkey * 0.5D AS lat", "n_nationkey * 1.25D AS lon")
    return tidy(c.select("n_nationkey", G.cell_area(F.col("lat"), F.col("lat") + 0.5, F.col("lon"), F.col("lon") + 1.25).alias("area")), 3)


def volumes(spark, d):
    """A series of heights in metres times its cell's area, in cubic km."""
    area = G.cell_area(F.lit(-70.0), F.lit(-69.5), F.col("cell") * 1.25, F.col("cell") * 1.25 + 1.25)
    return tidy(series(spark, d).select("cell", "t", (F.col("v") * 1e-3 * area).alias("volume")))


def absolute(spark, d):
    p = points(spark, d).where(F.abs(F.col("elev") - 60) <= 40)
    return tidy(p.groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def within(spark, d):
    """Strictly between two times."""
    return tidy(series(spark, d).where((F.col("t") > 12) & (F.col("t") < 36)).groupBy("cell").agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


def correlation(spark, d):
    return tidy(series(spark, d).groupBy("cell").agg(F.corr("v", "g").alias("r"), F.count(F.when(F.col("v").isNotNull() & F.col("g").isNotNull(), 1)).alias("n")))


def overlap(spark, d):
    return tidy(instruments(spark, d).where("s1 IS NOT NULL AND s2 IS NOT NULL").select("cell", "t", (F.col("s1") - F.col("s2")).alias("difference")))


def observations(spark, d):
    return tidy(instruments(spark, d).groupBy("cell").agg(F.avg("n1").alias("n1"), F.avg("n2").alias("n2")))


def weighted_errors(spark, d):
    i = instruments(spark, d).where("n2 IS NOT NULL")
    return tidy(i.groupBy("cell").agg((F.sqrt(F.sum(F.col("n2") * F.col("n2") * F.col("s2") * F.col("s2"))) / F.sum("n2")).alias("e")))


def cartesian(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 360 AS double) AS lon", "(c_custkey % 179) - 89D AS lat")
    return tidy(c.select("c_custkey", *[v.alias(k) for k, v in zip("xyz", G.to_cartesian(F.col("lon"), F.col("lat")), strict=True)]))


def wrapped(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 360 AS double) AS a")
    c = c.withColumn("b", G.wrap_180(F.col("a")))
    return tidy(c.select("c_custkey", "b", G.wrap_360(F.col("b")).alias("back")))


_HEAD = "CASE WHEN a > 180 THEN a - 360 ELSE a END"


def _scatter(keys: list[str]):
    """Heights corrected for backscatter with one fit per group of keys."""

    def run(spark, d):
        s = series(spark, d).withColumn("part", F.when(F.col("t") < 24, 0).when(F.col("t") < 48, 1).otherwise(2)).withColumn("half", F.col("t") % 2)
        return tidy(S.backscatter_constant(s, ["cell", *keys], "v", "g").select("cell", "t", "r", "h_corr"), 4)

    return run


def _scatter_sql(key: str) -> str:
    return f"""WITH {SERIES}, a AS (SELECT *, CASE WHEN t < 24 THEN 0 WHEN t < 48 THEN 1 ELSE 2 END AS part, t % 2 AS half FROM se),
b AS (SELECT *, CASE WHEN v <> 0 AND g <> 0 THEN v END AS y, CASE WHEN v <> 0 AND g <> 0 THEN g END AS x FROM a),
f AS (SELECT cell, {key}, CASE WHEN count(x) > 1 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS r, CASE WHEN count(x) > 1 AND var_pop(x) > 0 THEN regr_slope(y, x) END AS s,
  CASE WHEN count(x) > 1 AND var_pop(x) > 0 THEN regr_intercept(y, x) END AS h0 FROM b GROUP BY ALL)
SELECT cell, t, round(r, 4) + 0.0 AS r, round(CASE WHEN abs(r) >= 0.2 THEN v - greatest(-0.2, least(0.7, s)) * g + h0 ELSE v END, 4) + 0.0 AS h_corr FROM b JOIN f USING (cell, {key})"""


def _tide_grid(spark, d):
    """A grid of 20 by 30 cells of two constituents, where no more than some cells are land."""
    g = table(spark, d, "part").selectExpr("cast(p_partkey % 20 AS bigint) AS iy", "cast(p_partkey % 30 AS bigint) AS ix", "p_retailprice / 2000 AS a", "p_size / 50D AS b")
    g = g.groupBy("iy", "ix").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return g.select("iy", "ix", F.lit("m2").alias("constituent"), F.col("a").alias("re"), F.col("b").alias("im")).unionByName(
        g.select("iy", "ix", F.lit("k1").alias("constituent"), F.col("b").alias("re"), (F.col("a") - F.col("b")).alias("im"))
    )


def _places(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 290 AS double) / 10 AS lon", "cast(c_custkey % 170 AS double) / 10 AS lat", "cast(c_custkey AS double) AS hours")
    i, j = T.grid_place(F.col("lon"), F.col("lat"), 0.0, 0.0, 1.0, 1.0)
    return c.select("c_custkey", "hours", i.alias("i"), j.alias("j"))


def tide_constituents(spark, d):
    return tidy(T.interpolate_constituents(_places(spark, d), _tide_grid(spark, d), ["c_custkey"], 20, 30, 0.1))


def tide_heights(spark, d):
    c = T.interpolate_constituents(_places(spark, d), _tide_grid(spark, d), ["c_custkey", "hours"], 20, 30, 0.1)
    return tidy(T.predict_heights(c, ["c_custkey"], "hours"), 5)


_TIDE = """ga AS (SELECT (p_partkey % 20)::BIGINT AS iy, (p_partkey % 30)::BIGINT AS ix, avg(p_retailprice / 2000) AS a, avg(p_size / 50.0::DOUBLE) AS b FROM part GROUP BY ALL),
gr AS (SELECT iy, ix, 'm2' AS constituent, a AS re, b AS im FROM ga UNION ALL SELECT iy, ix, 'k1', b, a - b FROM ga),
pl AS (SELECT c_custkey, c_custkey::DOUBLE AS hours, (c_custkey % 170)::DOUBLE / 10 - 0.5 AS i, (c_custkey % 290)::DOUBLE / 10 - 0.5 AS j FROM customer),
co AS (SELECT c_custkey, hours, floor(i)::BIGINT + y AS iy, floor(j)::BIGINT + x AS ix, (CASE y WHEN 1 THEN i - floor(i) ELSE 1 - i + floor(i) END) * (CASE x WHEN 1 THEN j - floor(j) ELSE 1 - j + floor(j) END) AS w
  FROM pl, (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS x) WHERE floor(i) BETWEEN 0 AND 18 AND floor(j) BETWEEN 0 AND 28),
ti AS (SELECT c_custkey, hours, constituent, sum(w * re) / sum(w) AS re, sum(w * im) / sum(w) AS im, sum(w) AS frac FROM co JOIN gr USING (iy, ix) WHERE w > 0 GROUP BY ALL HAVING sum(w) > 0.1)"""

QUERIES = [
    ("OP-AGG-WMEAN", _by_part(C.weighted_mean), _class_sql("(n1 * m1 + n2 * m2) / (n1 + n2)", "m1", "m2")),
    ("OP-AGG-OMEAN", _by_part(C.ordinary_mean), _class_sql("(a1 + a2) / 2", "a1", "a2")),
    ("OP-AGG-WERR", _by_part(C.weighted_error), _class_sql("sqrt(n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2)", "s1 / sqrt(n1)", "s2 / sqrt(n2)")),
    ("OP-AGG-WINGERR", _by_part(C.class_difference), _class_sql("abs(a1 - a2)", "s1", "s2")),
    ("OP-AGG-NOBS", counts, f"WITH {_CLASSES} SELECT l_partkey, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 END AS n1, CASE WHEN n1 > 0 AND n2 > 0 THEN n2 END AS n2 FROM cl"),
    ("OP-AGG-DIGIT", digits, "SELECT floor((l_quantity - 0.5) / 1.25)::BIGINT + 1 AS ix, count(*) AS n, round(0.5 + (floor((l_quantity - 0.5) / 1.25) + 0.5) * 1.25, 6) + 0.0 AS centre FROM lineitem GROUP BY ALL"),
    ("OP-AGG-CELLAREA", areas, "SELECT n_nationkey::BIGINT AS n_nationkey, round(6371.2::DOUBLE ** 2 * abs(sin(radians(-80 + n_nationkey * 0.5::DOUBLE)) - sin(radians(-79.5 + n_nationkey * 0.5::DOUBLE))) * radians(1.25), 3) + 0.0 AS area FROM nation"),
    ("OP-AGG-VOLUME", volumes, f"WITH {SERIES} SELECT cell, t, round(v * 1e-3::DOUBLE * 6371.2::DOUBLE ** 2 * abs(sin(radians(-70)) - sin(radians(-69.5))) * radians(1.25), 6) + 0.0 AS volume FROM se"),
    ("OP-AGG-AVGOBS", observations, f"WITH {INSTRUMENTS} SELECT cell, round(avg(n1), 6) + 0.0 AS n1, round(avg(n2), 6) + 0.0 AS n2 FROM ins GROUP BY cell"),
    ("OP-AGG-WAVGERR", weighted_errors, f"WITH {INSTRUMENTS} SELECT cell, round(sqrt(sum((n2 * s2) ** 2)) / sum(n2), 6) + 0.0 AS e FROM ins WHERE n2 IS NOT NULL GROUP BY cell"),
    ("OP-FILT-ABS", absolute, f"WITH {POINTS} SELECT kind, count(*) AS n FROM pt WHERE abs(elev - 60) <= 40 GROUP BY kind"),
    ("OP-FILT-TIME", within, f"WITH {SERIES} SELECT cell, count(v) AS n, round(avg(v), 6) + 0.0 AS mean FROM se WHERE t > 12 AND t < 36 GROUP BY cell"),
    ("OP-FIT-CORR", correlation, f"WITH {SERIES} SELECT cell, round(corr(v, g), 6) + 0.0 AS r, count(*) FILTER (v IS NOT NULL AND g IS NOT NULL) AS n FROM se GROUP BY cell"),
    ("OP-JOIN-OVERLAP", overlap, f"WITH {INSTRUMENTS} SELECT cell, t, round(s1 - s2, 6) + 0.0 AS difference FROM ins WHERE s1 IS NOT NULL AND s2 IS NOT NULL"),
    ("OP-F-SPH2XYZ", cartesian, """WITH p AS (SELECT c_custkey, radians(c_custkey % 360) AS a, radians((c_custkey % 179) - 89) AS b FROM customer)
  SELECT c_custkey, round(cos(b) * cos(a), 6) + 0.0 AS x, round(cos(b) * sin(a), 6) + 0.0 AS y, round(sin(b), 6) + 0.0 AS z FROM p"""),
    ("OP-F-LONWRAP", wrapped, f"SELECT c_custkey, round({_HEAD}, 6) + 0.0 AS b, round(a, 6) + 0.0 AS back FROM (SELECT c_custkey, (c_custkey % 360)::DOUBLE AS a FROM customer)"),
    ("OP-BS-INTERVAL", _scatter(["part"]), _scatter_sql("part")),
    ("OP-BS-SAT", _scatter(["half"]), _scatter_sql("half")),
    ("OP-TIDE-INTERP", tide_constituents, f"WITH {_TIDE} SELECT c_custkey, constituent, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(frac, 6) + 0.0 AS frac FROM ti"),
    ("OP-TIDE-PREDICT", tide_heights, f"""WITH {_TIDE}, an AS (SELECT *, radians(CASE constituent WHEN 'm2' THEN 28.9841042::DOUBLE ELSE 15.0410686::DOUBLE END * hours) AS x FROM ti)
  SELECT c_custkey, round(sum(re * cos(x) + im * sin(x)), 5) + 0.0 AS height FROM an GROUP BY 1"""),
]
