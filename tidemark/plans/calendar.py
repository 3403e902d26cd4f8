"""Queries of date functions and of small functions on coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geo as G
from .views import table, tidy

_DAY = "o AS (SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::BIGINT AS n FROM orders)"


def _days(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.withColumn("n", D.date_to_number(F.col("d")).cast("long")).withColumn("t", D.month_to_year(F.year("d"), F.month("d")))


def _of_days(columns):
    return lambda spark, d: tidy(_days(spark, d).select("o_orderkey", *[c.alias(k) for k, c in columns()]))


def _date(c):
    return F.date_format(c, "yyyy-MM-dd")


def seconds(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 86401.25 + 0.5).alias("s"))
    return e.select("event_id", D.to_text(D.seconds_to_timestamp(F.col("s"))).alias("at"))


def parts(spark, d):
    e = table(spark, d, "events").select("event_id", D.seconds_to_timestamp(F.col("event_id") * 86401.0).alias("at"))
    return tidy(e.select("event_id", *[c.alias(k) for k, c in D.parts(F.col("at")).items()]))


def julian(spark, d):
    o = _days(spark, d)
    mjd = D.modified_julian_day(F.col("d"))
    deg, minute, second = D.sexagesimal(F.col("o_orderkey") / 7 - 100)
    return tidy(o.select("o_orderkey", (mjd + 2400000.5).alias("jd"), _date(D.from_modified_julian_day(mjd)).alias("back"), deg.alias("deg"), minute.alias("min"), second.alias("sec")), 4)


def longitudes(spark, d):
    o = _days(spark, d).select("o_orderkey", (F.datediff("d", F.lit("2000-01-01").cast("date")) - 0.5).alias("k"))
    return tidy(o.select("o_orderkey", *[c.alias(k) for k, c in D.mean_longitudes(F.col("k")).items()]))


def inverse(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "(c_custkey % 61 - 30) * 97.3D AS x", "(c_custkey % 47 - 23) * 88.1D AS y")
    lon, lat = G.from_polar(F.col("x"), F.col("y"))
    return tidy(c.select("c_custkey", lon.alias("lon"), lat.alias("lat")))


_E2 = "6.694379852e-3::DOUBLE"
_INVERSE = f"""WITH c AS (SELECT c_custkey, (c_custkey % 61 - 30) * 97.3::DOUBLE AS x, (c_custkey % 47 - 23) * 88.1::DOUBLE AS y FROM customer), k AS (SELECT 71 / 57.29577951::DOUBLE AS sl, sqrt({_E2}) AS e),
q AS (SELECT c_custkey, x, y, sqrt(x * x + y * y) AS r, 3.141592654::DOUBLE / 2 - 2 * atan(sqrt(x * x + y * y) / (6378.137::DOUBLE * cos(sl) / sqrt(1 - {_E2} * sin(sl) ** 2)
  / (tan(3.141592654::DOUBLE / 4 - sl / 2) / ((1 - e * sin(sl)) / (1 + e * sin(sl))) ** (e / 2)))) AS a FROM c, k)
SELECT c_custkey, round(CASE WHEN r < 0.1 THEN 0 ELSE atan2(x, y) * 57.29577951::DOUBLE END, 6) + 0.0 AS lon, round(CASE WHEN r < 0.1 THEN -90 ELSE -(a + ({_E2} / 2 + 5 * {_E2} ** 2 / 24 + {_E2} ** 3 / 12) * sin(2 * a)
  + (7 * {_E2} ** 2 / 48 + 29 * {_E2} ** 3 / 240) * sin(4 * a) + 7 * {_E2} ** 3 / 120 * sin(6 * a)) * 57.29577951::DOUBLE END, 6) + 0.0 AS lat FROM q"""


def hypotenuse(spark, d):
    return tidy(table(spark, d, "customer").select("c_custkey", G.planar_degrees(F.col("c_custkey") % 360, F.col("c_acctbal") / 100, F.lit(12.5), F.lit(-3.25)).alias("far")))


def units(spark, d):
    c = table(spark, d, "customer").select("c_custkey", G.to_microradians(F.col("c_acctbal")).alias("urad"), G.to_microradians(F.col("c_acctbal"), 2).alias("squared"))
    return tidy(c.withColumn("back", G.to_arc_seconds(F.col("urad"))), 4)


def boxes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.posexplode(G.box_line(F.col("n_nationkey") * 1.0, F.col("n_nationkey") + 2.5, F.lit(-80.0), F.lit(-70.0), 4)).alias("k", "p"))
    return tidy(n.select("n_nationkey", "k", "p.lon", "p.lat"))


def subdomains(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.explode(G.subdomains(F.lit(-30.0), F.col("n_nationkey") * 10.0, 4)).alias("s"))
    return tidy(n.select("n_nationkey", "s.number", "s.left", "s.right"))


def grid_coordinates(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.explode(G.grid_centres(F.col("n_nationkey") * 1.0, F.col("n_nationkey") + 3.0, 0.4)).alias("c"))
    return tidy(n.select("n_nationkey", "c.number", "c.centre", "c.low", "c.high"))


def circular(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("a"))
    return tidy(p.select("p_brand", G.circular(F.col("a"), F.lit(-1)).alias("last"), G.circular(F.col("a"), F.size("a") + 2).alias("third"), F.size(G.tuples(F.col("a"), 3)).alias("tuples")))


def polynomial(spark, d):
    return tidy(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.horner(F.col("l_quantity"), [0.25, 0.75, -1.5, -2.0]).alias("y")))


QUERIES = [
    ("OP-D-SEC2DT", seconds, "SELECT event_id, strftime(TIMESTAMP '1985-01-01' + to_microseconds((event_id * 86401250000 + 500000)::BIGINT), '%Y-%m-%d %H:%M:%S.%g') AS at FROM events"),
    ("OP-D-CLASS", parts, """WITH a AS (SELECT event_id, TIMESTAMP '1985-01-01' + to_seconds(event_id * 86401) AS t FROM events) SELECT event_id, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, minute(t) AS minute, second(t) AS second,
  round(datediff('day', DATE '0001-01-01', t::DATE) + 1 + 366 + (hour(t) * 3600 + minute(t) * 60 + second(t)) / 86400.0::DOUBLE, 6) + 0.0 AS serial FROM a"""),
    ("OP-D-YEAR2YM", _of_days(lambda: [("year", D.year_to_month(F.col("t"))[0]), ("month", D.year_to_month(F.col("t"))[1]), ("january", D.year_to_month(F.year("d").cast("double"))[1])]), f"WITH {_DAY} SELECT o_orderkey, y::BIGINT AS year, m::BIGINT AS month, 1::BIGINT AS january FROM o"),
    ("OP-D-YM2YEAR", _of_days(lambda: [("middle", F.col("t")), ("by_days", D.month_to_year_day(F.year("d"), F.month("d")))]), f"WITH {_DAY} SELECT o_orderkey, round(y + (m - 0.5::DOUBLE) / 12, 6) + 0.0 AS middle, round(y + (m - 1) / 12 + 15.22::DOUBLE / 365.25, 6) + 0.0 AS by_days FROM o"),
    ("OP-D-NUM2YEAR", _of_days(lambda: [("t2", D.number_to_year(F.col("n")))]), f"WITH {_DAY} SELECT o_orderkey, round(y + (m - 1) / 12 + dd / 365.25::DOUBLE, 6) + 0.0 AS t2 FROM o"),
    ("OP-D-NUM2YMD", _of_days(lambda: [("day", _date(D.number_to_date(F.col("n"))))]), f"WITH {_DAY} SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS day FROM o"),
    ("OP-D-YEAR2NUM", _of_days(lambda: [("number", D.year_to_number(F.col("t")).cast("long"))]), f"WITH {_DAY} SELECT o_orderkey, (y * 10000 + m * 100 + 15)::BIGINT AS number FROM o"),
    ("OP-D-YEAR2DT", _of_days(lambda: [("mid", _date(D.year_to_date(F.col("t")))), ("mid16", _date(D.month_to_date(F.year("d"), F.month("d"), 16))), ("year_mid", _date(D.month_to_date(F.year("d"), F.lit(7), 1)))]),
     f"WITH {_DAY} SELECT o_orderkey, strftime(make_date(y, m, 15), '%Y-%m-%d') AS mid, strftime(make_date(y, m, 16), '%Y-%m-%d') AS mid16, strftime(make_date(y, 7, 1), '%Y-%m-%d') AS year_mid FROM o"),
    ("OP-D-CHDAY", _of_days(lambda: [("first", D.with_day(F.col("n"), 1))]), f"WITH {_DAY} SELECT o_orderkey, n // 100 * 100 + 1 AS first FROM o"),
    ("OP-D-SEASON", _of_days(lambda: [*[(f"month{k}", D.season_month(F.col("d"), k)) for k in (1, 2, 3)], ("year", D.season(F.col("d"))[0])]), f"""WITH {_DAY}, s AS (SELECT *, CASE WHEN m IN (12, 1, 2) THEN 12 ELSE m // 3 * 3 END AS f, CASE WHEN m IN (1, 2) THEN y - 1 ELSE y END AS fy FROM o)
  SELECT o_orderkey, (fy * 100 + f)::BIGINT AS month1, (CASE WHEN f = 12 THEN (fy + 1) * 100 + 1 ELSE fy * 100 + f + 1 END)::BIGINT AS month2, (CASE WHEN f = 12 THEN (fy + 1) * 100 + 2 ELSE fy * 100 + f + 2 END)::BIGINT AS month3,
    (y + CASE WHEN m = 12 THEN 1 ELSE 0 END)::BIGINT AS year FROM s"""),
    ("OP-D-JD", julian, f"""WITH {_DAY}, a AS (SELECT *, o_orderkey / 7 - 100 AS x FROM o), b AS (SELECT *, trunc(x) AS g, abs(x - trunc(x)) * 60 AS mm FROM a)
  SELECT o_orderkey, round(datediff('day', DATE '1858-11-17', d) + 2400000.5::DOUBLE, 4) + 0.0 AS jd, strftime(d, '%Y-%m-%d') AS back, g::BIGINT AS deg, floor(mm)::BIGINT AS min, round((mm - floor(mm)) * 60, 4) + 0.0 AS sec FROM b"""),
    ("OP-D-SDN", _of_days(lambda: [("secs", D.serial_to_seconds(F.col("o_orderkey") + 730486.25))]), f"WITH {_DAY} SELECT o_orderkey, round((o_orderkey + 0.25::DOUBLE) * 86400, 6) + 0.0 AS secs FROM o"),
    ("OP-D-ASTROL", longitudes, f"""WITH {_DAY}, k AS (SELECT o_orderkey, datediff('day', DATE '2000-01-01', d) - 0.5::DOUBLE AS k FROM o), v AS (SELECT o_orderkey, 218.3164477::DOUBLE + 13.17639648::DOUBLE * k AS s, 280.4662556::DOUBLE + 0.98564736::DOUBLE * k AS h,
    83.3532465::DOUBLE + 0.11140353::DOUBLE * k AS p, 125.0445479::DOUBLE - 0.05295377::DOUBLE * k AS n FROM k)
  SELECT o_orderkey, round(s - floor(s / 360) * 360, 6) + 0.0 AS s, round(h - floor(h / 360) * 360, 6) + 0.0 AS h, round(p - floor(p / 360) * 360, 6) + 0.0 AS p, round(n - floor(n / 360) * 360, 6) + 0.0 AS n FROM v"""),
    ("OP-D-HDRDATE", _of_days(lambda: [("year", D.century(F.year("d") % 100 + F.when(F.year("d") >= 2000, 2000).otherwise(0)))]), f"WITH {_DAY} SELECT o_orderkey, y::BIGINT AS year FROM o"),
    ("OP-F-XY2LL", inverse, _INVERSE),
    ("OP-F-HYPOT", hypotenuse, "SELECT c_custkey, round(sqrt((c_custkey % 360 - 12.5::DOUBLE) ** 2 + (c_acctbal / 100 + 3.25::DOUBLE) ** 2), 6) + 0.0 AS far FROM customer"),
    ("OP-F-UNIT", units, "SELECT c_custkey, round(c_acctbal * 4.8481368169032191::DOUBLE, 4) + 0.0 AS urad, round(c_acctbal * 4.8481368169032191::DOUBLE ** 2, 4) + 0.0 AS squared, round(c_acctbal, 4) + 0.0 AS back FROM customer"),
    ("OP-F-BOX", boxes, """WITH k AS (SELECT range AS k, range // 4 AS side, (range % 4) / 4.0::DOUBLE AS u FROM range(17)) SELECT n_nationkey::BIGINT AS n_nationkey, k,
  round(n_nationkey + 2.5::DOUBLE * CASE side WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN 1 - u ELSE 0 END, 6) + 0.0 AS lon, round(-80 + 10 * CASE side WHEN 0 THEN 0 WHEN 1 THEN u WHEN 2 THEN 1 WHEN 3 THEN 1 - u ELSE 0 END, 6) + 0.0::DOUBLE AS lat FROM nation, k"""),
    ("OP-F-SUBDOM", subdomains, """WITH a AS (SELECT n_nationkey::BIGINT AS n_nationkey, (n_nationkey * 10 + 30) / 4.0::DOUBLE AS w, unnest([1, 2, 3, 4]) AS number FROM nation)
  SELECT n_nationkey, number::BIGINT AS number, round(-30 + (number - 1) * w, 6) + 0.0 AS "left", round(-30 + number * w, 6) + 0.0 AS "right" FROM a"""),
    ("OP-F-GRIDCOORD", grid_coordinates, """WITH a AS (SELECT n_nationkey::BIGINT AS n_nationkey, unnest(range(8)) AS k FROM nation) SELECT n_nationkey, k + 1 AS number, round(n_nationkey + k * 0.4::DOUBLE + 0.2, 6) + 0.0 AS centre,
  round(n_nationkey + k * 0.4::DOUBLE, 6) + 0.0 AS low, round(n_nationkey + (k + 1) * 0.4::DOUBLE, 6) + 0.0 AS high FROM a"""),
    ("OP-F-CIRC", circular, """WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, max(p_partkey) FILTER (i = n) AS last, max(p_partkey) FILTER (i = 2 % n + 1) AS third, any_value(n) // 3 AS tuples FROM a GROUP BY p_brand"""),
    ("OP-F-POLY", polynomial, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(0.25::DOUBLE * l_quantity ** 3 + 0.75::DOUBLE * l_quantity ** 2 - 1.5::DOUBLE * l_quantity - 2, 6) + 0.0 AS y FROM lineitem"),
]
