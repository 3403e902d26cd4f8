"""Queries of the series engine: referencing, averaging, merging and calibrating instruments, corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import cell_area
from ..operators import series as S
from .views import INSTRUMENTS, REFERENCED, SERIES, instruments, referenced, series, table, tidy

_MIRROR = """mi AS (SELECT cell, t_ref, t, arg_min(h, r) AS h, arg_min(e, r) AS e, arg_min(n, r) AS n FROM (SELECT cell, t_ref, t, h, e, n, 0 AS r FROM rf UNION ALL SELECT cell, t, t_ref, -h, e, n, 1 FROM rf) GROUP BY ALL)"""
_FULL = """fu AS (SELECT * FROM mi UNION ALL SELECT DISTINCT cell, t_ref, t_ref, 0.0, 0.0, 0 FROM mi m WHERE NOT EXISTS (SELECT 1 FROM mi x WHERE x.cell = m.cell AND x.t_ref = m.t_ref AND x.t = x.t_ref))"""


def _offset(source: str, dynamic: bool = True) -> str:
    best = "arg_max(t_ref, (k, -t_ref))" if dynamic else "min(t_ref)"
    return f"""rs AS (SELECT cell, {best} AS ref FROM (SELECT cell, t_ref, count(h) AS k FROM {source} GROUP BY ALL) WHERE k > 0 GROUP BY cell),
rr AS (SELECT s.cell, ref, t, h AS hr, e AS er, n AS nr FROM {source} s JOIN rs ON s.cell = rs.cell AND s.t_ref = rs.ref),
oo AS (SELECT s.cell, s.t_ref, any_value(ref) AS ref, avg(hr - h) AS off, avg(er) AS eo, round_even((avg(nr) + avg(n)) / 2, 0) AS no FROM {source} s JOIN rr ON s.cell = rr.cell AND s.t = rr.t WHERE h IS NOT NULL AND hr IS NOT NULL GROUP BY ALL),
ro AS (SELECT s.cell, s.t_ref, s.t, h + off AS h, CASE WHEN s.t_ref = ref THEN e ELSE sqrt(eo ** 2 + e ** 2) END AS e, CASE WHEN s.t_ref <> ref AND n = 0 THEN no ELSE n END AS n FROM {source} s JOIN oo ON s.cell = oo.cell AND s.t_ref = oo.t_ref)"""


_AVG = """SELECT cell, t, round(sum(greatest(n, CASE WHEN n = 0 THEN 1 ELSE n END) * h) / sum(CASE WHEN n = 0 THEN 1 ELSE n END), 6) + 0.0 AS h,
  round(sqrt(sum(((CASE WHEN n = 0 THEN 1 ELSE n END) * e) ** 2)) / sum(CASE WHEN n = 0 THEN 1 ELSE n END), 6) + 0.0 AS e, round(avg(n), 6) + 0.0 AS n FROM {0} GROUP BY cell, t"""


def by_offset(spark, d):
    return tidy(S.reference_by_offset(referenced(spark, d), "cell"))


def by_first(spark, d):
    return tidy(S.reference_by_first(referenced(spark, d), "cell"))


def full_average(spark, d):
    return tidy(S.average_cell(referenced(spark, d), "cell"))


def average(spark, d):
    return tidy(S.weighted_average(referenced(spark, d), "cell"))


def select(spark, d):
    return tidy(S.select_reference(referenced(spark, d), "cell"))


def mirrored(spark, d):
    return tidy(S.mirror(referenced(spark, d), "cell", {"h": -1, "n": 1}))


def xcal(spark, d):
    return tidy(S.calibrate(instruments(spark, d), "cell", "t"))


_XCAL = f"""WITH {INSTRUMENTS}, o AS (SELECT *, avg(s1 - s2) OVER (PARTITION BY cell) AS o12, avg(s2 - s3) OVER (PARTITION BY cell) AS o23 FROM ins),
x AS (SELECT *, s2 + o12 AS x2, s3 + o12 + o23 AS x3, o12 IS NOT NULL AND o23 IS NOT NULL AS ok, coalesce(n1 / (n1 + n2), 1.0::DOUBLE) AS w1, coalesce(n2 / (n1 + n2), 1.0::DOUBLE) AS w2,
  coalesce(n2 / (n2 + n3), 1.0::DOUBLE) AS w3, coalesce(n3 / (n2 + n3), 1.0::DOUBLE) AS w4 FROM o),
y AS (SELECT *, CASE WHEN s1 IS NOT NULL OR x2 IS NOT NULL THEN coalesce(w1 * s1, 0) + coalesce(w2 * x2, 0) END AS m1 FROM x),
z AS (SELECT *, CASE WHEN m1 IS NOT NULL OR x3 IS NOT NULL THEN coalesce(w3 * m1, 0) + coalesce(w4 * x3, 0) END AS m FROM y)
SELECT cell, t, CASE WHEN ok THEN round(s1, 6) + 0.0 END AS s1, CASE WHEN ok THEN round(x2, 6) + 0.0 END AS s2, CASE WHEN ok THEN round(x3, 6) + 0.0 END AS s3, CASE WHEN ok THEN round(m, 6) + 0.0 END AS xcal FROM z"""


def xcal_simple(spark, d):
    return tidy(S.calibrate_simple(instruments(spark, d), "cell", "t"))


_XSIMPLE = f"""WITH {INSTRUMENTS}, a AS (SELECT *, s2 + avg(s1 - s2) OVER (PARTITION BY cell) AS x2 FROM ins), b AS (SELECT *, s3 + avg(x2 - s3) OVER (PARTITION BY cell) AS x3 FROM a)
SELECT cell, t, round((coalesce(s1, 0) + coalesce(x2, 0) + coalesce(x3, 0)) / nullif((s1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT, 0), 6) + 0.0 AS mean FROM b"""


def offsets(spark, d):
    g = instruments(spark, d).groupBy("cell").agg(F.avg(F.col("s1") - F.col("s2")).alias("o12"), F.avg(F.col("s2") - F.col("s3")).alias("o23"), F.count(F.col("s1") + F.col("s2")).alias("n12"), F.count(F.col("s2") + F.col("s3")).alias("n23"))
    return tidy(g)


def pivoted(spark, d):
    o = table(spark, d, "orders").selectExpr("cast(o_custkey % 15 AS bigint) AS cell", "cast(year(o_orderdate) AS bigint) AS t", "concat('s', substr(o_orderpriority, 1, 1)) AS sat", "o_totalprice / 9973.7D AS p")
    g = o.groupBy("cell", "t", "sat").agg(F.avg("p").alias("v"))
    return tidy(S.pivot_sats(g, "cell", "t", "v", ["s1", "s2", "s3"]))


def backscatter(spark, d):
    return tidy(S.backscatter_constant(series(spark, d), ["cell"], "v", "g").select("cell", "t", "r", "s", "h_corr"))


_BS = f"""WITH {SERIES}, a AS (SELECT cell, t, v, g, CASE WHEN g IS NOT NULL AND g <> 0 AND v <> 0 THEN v END AS y, CASE WHEN v IS NOT NULL AND v <> 0 AND g <> 0 THEN g END AS x FROM se),
b AS (SELECT *, corr(x, y) OVER w AS r, regr_slope(y, x) OVER w AS s, regr_intercept(y, x) OVER w AS h0 FROM a WINDOW w AS (PARTITION BY cell))
SELECT cell, t, round(r, 6) + 0.0 AS r, round(s, 6) + 0.0 AS s, round(CASE WHEN abs(r) >= 0.2 THEN v - greatest(-0.2, least(0.7, s)) * g + h0 ELSE v END, 6) + 0.0 AS h_corr FROM b"""


def bias3d(spark, d):
    """Grid-level bias of two epochs, for ascending and descending biases by key, weighted by counts."""
    b = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_acctbal / 1e5 AS a", "s_suppkey / 1e4 AS de")
    p = table(spark, d, "lineitem").selectExpr("l_suppkey AS k1", "l_linenumber AS ln", "l_returnflag AS rf").groupBy("k1", "ln").agg(F.count(F.when(F.col("rf") == "A", 1)).alias("n_ad"), F.count(F.when(F.col("rf") == "N", 1)).alias("n_da"))
    last = b.agg(F.max("k").alias("m"))
    p = p.crossJoin(F.broadcast(last)).withColumn("k2", F.col("k1") % F.col("m") + 1)
    one, two = b.selectExpr("k AS k1", "a AS a1", "de AS d1"), b.selectExpr("k AS k2", "a AS a2", "de AS d2")
    j = p.join(one, "k1").join(two, "k2").where("n_ad + n_da > 0")
    return tidy(j.selectExpr("k1", "ln", "(n_ad * (a2 - d1) + n_da * (d2 - a1)) / (n_ad + n_da) AS bias", "a2 - a1 AS plain"))


_BIAS3D = """WITH b AS (SELECT s_suppkey AS k, s_acctbal / 1e5 AS a, s_suppkey / 1e4 AS de FROM supplier), p AS (SELECT l_suppkey AS k1, l_linenumber AS ln, count(*) FILTER (l_returnflag = 'A') AS n_ad, count(*) FILTER (l_returnflag = 'N') AS n_da FROM lineitem GROUP BY ALL)
SELECT k1, ln::BIGINT AS ln, round((n_ad * (y.a - x.de) + n_da * (y.de - x.a)) / (n_ad + n_da), 6) + 0.0 AS bias, round(y.a - x.a, 6) + 0.0 AS plain
FROM p JOIN b x ON x.k = k1 JOIN b y ON y.k = k1 % (SELECT max(k) FROM b) + 1 WHERE n_ad + n_da > 0"""


def bias(spark, d):
    b = table(spark, d, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_acctbal / 1e4 AS bias")
    j = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_tax").join(b, "l_suppkey", "left")
    return tidy(j.groupBy("l_linenumber").agg(F.avg(F.col("l_tax") - F.coalesce("bias", F.lit(0.0))).alias("mean")))


def area_series(spark, d):
    a = series(spark, d).withColumn("area", cell_area(F.col("cell") - 80.0, F.col("cell") - 79.0, F.lit(0.0), F.lit(1.0)))
    m = S.area_mean(a, ["t"], "g", "area")
    w = Window.partitionBy(F.lit(1))  # one row per epoch is left
    return tidy(m.withColumn("to_mean", F.col("mean") - F.avg("mean").over(w)))


_AREA = f"""WITH {SERIES}, a AS (SELECT *, 6371.2 ** 2 * abs(sin(radians(cell - 80.0::DOUBLE)) - sin(radians(cell - 79.0::DOUBLE))) * radians(1.0::DOUBLE) AS area FROM se),
m AS (SELECT t, coalesce(sum(area * g) FILTER (g <> 0) / sum(area) FILTER (g <> 0), 0) AS mean FROM a GROUP BY t) SELECT t, round(mean, 6) + 0.0 AS mean, round(mean - avg(mean) OVER (), 6) + 0.0 AS to_mean FROM m"""


def ols(spark, d):
    g = series(spark, d).groupBy("cell").agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("start"), F.corr("v", "t").alias("r"), F.count("v").alias("n")).where("n >= 8")
    return tidy(g)


def combine(spark, d):
    s = instruments(spark, d)
    return tidy(s.select("cell", "t", F.when(F.col("s1").isNull() & F.col("s3").isNull(), None).otherwise(F.coalesce("s1", F.lit(0.0)) + F.coalesce("s3", F.lit(0.0))).alias("v")))


def backfill(spark, d):
    w = Window.partitionBy("cell").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return tidy(instruments(spark, d).select("cell", "t", F.first("s3", True).over(w).alias("v")))


def propagated(spark, d):
    """The merged error as the method computes it: the second term stands outside the root."""
    s = instruments(spark, d).where("n1 IS NOT NULL AND n2 IS NOT NULL")
    w1, w2 = F.col("n1") / (F.col("n1") + F.col("n2")), F.col("n2") / (F.col("n1") + F.col("n2"))
    return tidy(s.select("cell", "t", (F.sqrt(w1 * w1 * F.col("s1") * F.col("s1")) + w2 * w2 * F.col("s2") * F.col("s2")).alias("e")))


def union_sats(spark, d):
    s = instruments(spark, d)
    parts = [s.select(F.lit(f"i{k}").alias("sat"), "cell", "t", F.col(f"s{k}").alias("v")).where("v IS NOT NULL") for k in (1, 2, 3)]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def not_overlapping(spark, d):
    r = referenced(spark, d)
    ref = r.join(S.select_reference(r, "cell"), "cell").where("t_ref = ref").select("cell", "t")
    return r.select("cell", "t_ref").distinct().join(r.join(ref, ["cell", "t"]).select("cell", "t_ref").distinct(), ["cell", "t_ref"], "left_anti")


QUERIES = [
    ("OP-REF-OFFSET", by_offset, f"WITH {REFERENCED}, {_offset('rf')} SELECT cell, t_ref, t, round(h, 6) + 0.0 AS h, round(e, 6) + 0.0 AS e, round(n, 6) + 0.0 AS n FROM ro"),
    ("OP-REF-FIRST", by_first, f"""WITH {REFERENCED}, a AS (SELECT *, min(t_ref) OVER (PARTITION BY cell) AS f FROM rf), r AS (SELECT cell, t AS t_ref, h AS hr, e AS er, n AS nr FROM a WHERE t_ref = f)
  SELECT cell, t_ref, t, round(CASE WHEN t_ref = f THEN h ELSE h + hr END, 6) + 0.0 AS h, round(CASE WHEN t_ref = f THEN e ELSE sqrt(er ** 2 + e ** 2) END, 6) + 0.0 AS e, (CASE WHEN t_ref = f THEN n ELSE n + nr END)::DOUBLE AS n
  FROM a LEFT JOIN r USING (cell, t_ref)"""),
    ("OP-REF-SELECT", select, f"WITH {REFERENCED} SELECT cell, arg_max(t_ref, (k, -t_ref)) AS ref FROM (SELECT cell, t_ref, count(h) AS k FROM rf GROUP BY ALL) GROUP BY cell"),
    ("OP-MIRROR", mirrored, f"WITH {REFERENCED}, {_MIRROR} SELECT cell, t_ref, t, round(h, 6) + 0.0 AS h, n FROM mi"),
    ("OP-AGG-WAVG", average, f"WITH {REFERENCED} {_AVG.format('rf')}"),
    ("OP-TS-AVG", full_average, f"WITH {REFERENCED}, {_MIRROR}, {_FULL}, {_offset('fu')} {_AVG.format('ro')}"),
    ("OP-XCAL", xcal, _XCAL),
    ("OP-XCAL-SIMPLE", xcal_simple, _XSIMPLE),
    ("OP-XCAL-OFFSET", offsets, f"WITH {INSTRUMENTS} SELECT cell, round(avg(s1 - s2), 6) + 0.0 AS o12, round(avg(s2 - s3), 6) + 0.0 AS o23, count(s1 + s2) AS n12, count(s2 + s3) AS n23 FROM ins GROUP BY cell"),
    ("OP-PIVOT-SAT", pivoted, """SELECT (o_custkey % 15)::BIGINT AS cell, year(o_orderdate)::BIGINT AS t, round(avg(o_totalprice / 9973.7::DOUBLE) FILTER (o_orderpriority[1] = '1'), 6) + 0.0 AS s1,
  round(avg(o_totalprice / 9973.7::DOUBLE) FILTER (o_orderpriority[1] = '2'), 6) + 0.0 AS s2, round(avg(o_totalprice / 9973.7::DOUBLE) FILTER (o_orderpriority[1] = '3'), 6) + 0.0 AS s3 FROM orders GROUP BY 1, 2"""),
    ("OP-BS-CONST", backscatter, _BS),
    ("OP-COR-BIAS3D", bias3d, _BIAS3D),
    ("OP-COR-BIAS", bias, "SELECT l_linenumber::BIGINT AS l_linenumber, round(avg(l_tax - coalesce(s_acctbal / 1e4, 0)), 6) + 0.0 AS mean FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
    ("OP-AGG-AREAMEAN", area_series, _AREA),
    ("OP-FIT-OLS", ols, f"WITH {SERIES} SELECT cell, round(regr_slope(v, t), 6) + 0.0 AS slope, round(regr_intercept(v, t), 6) + 0.0 AS start, round(corr(v, t), 6) + 0.0 AS r, count(v) AS n FROM se GROUP BY cell HAVING count(v) >= 8"),
    ("OP-COMBADD", combine, f"WITH {INSTRUMENTS} SELECT cell, t, round(CASE WHEN s1 IS NOT NULL OR s3 IS NOT NULL THEN coalesce(s1, 0) + coalesce(s3, 0) END, 6) + 0.0 AS v FROM ins"),
    ("OP-BFILL", backfill, f"WITH {INSTRUMENTS} SELECT cell, t, round(first_value(s3 IGNORE NULLS) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS v FROM ins"),
    ("OP-AGG-ERRPROP", propagated, f"WITH {INSTRUMENTS} SELECT cell, t, round(sqrt((n1 / (n1 + n2)) ** 2 * s1 ** 2) + (n2 / (n1 + n2)) ** 2 * s2 ** 2, 6) + 0.0 AS e FROM ins WHERE n1 IS NOT NULL AND n2 IS NOT NULL"),
    ("OP-UNION-SAT", union_sats, f"WITH {INSTRUMENTS} SELECT sat, cell, t, round(v, 6) + 0.0 AS v FROM (SELECT 'i1' AS sat, cell, t, s1 AS v FROM ins UNION ALL SELECT 'i2', cell, t, s2 FROM ins UNION ALL SELECT 'i3', cell, t, s3 FROM ins) WHERE v IS NOT NULL"),
    ("OP-JOIN-NONOVERLAP", not_overlapping, f"""WITH {REFERENCED}, {_offset('rf')} SELECT DISTINCT cell, t_ref FROM rf WHERE NOT EXISTS (SELECT 1 FROM oo WHERE oo.cell = rf.cell AND oo.t_ref = rf.t_ref)"""),
]
