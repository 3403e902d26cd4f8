"""Queries of filters, reshaping, scalar functions and record decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import geo as G
from ..sources.tables import name_keys
from .views import POINTS, points, table, tidy


def region(spark, d):
    p = points(spark, d).where(G.wrap_360(F.col("lon") - 180).between(300, 360) | G.wrap_360(F.col("lon") - 180).between(0, 60))
    return tidy(p.where("lat BETWEEN 10 AND 90").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


def tiles(spark, d):
    """Half-open tiles of 90 degrees with a border of 5 that overlaps; non-empty ones are numbered."""
    p = points(spark, d).withColumn("tile", F.explode(F.sequence(F.floor((F.col("lon") - 5) / 90), F.floor((F.col("lon") + 5) / 90)))).where("lon < tile * 90 + 95")
    g = p.groupBy("kind", "tile").agg(F.count(F.lit(1)).alias("n"))
    return tidy(g.withColumn("number", F.dense_rank().over(Window.partitionBy("kind").orderBy("tile"))))


def flags(spark, d):
    return tidy(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.expr("CASE WHEN l_linenumber % 4 = 0 AND l_returnflag <> 'R' THEN 1 END")).alias("kept"), F.count(F.lit(1)).alias("n")).selectExpr("l_suppkey", "kept", "100.0D * (n - kept) / n AS removed"))


def both_classes(spark, d):
    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").withColumn("a", F.count(F.when(F.col("o_orderstatus") == "F", 1)).over(w)).withColumn("b", F.count(F.when(F.col("o_orderstatus") == "O", 1)).over(w))
    return tidy(o.where("a > 0 AND b > 0 AND o_orderstatus IN ('F', 'O')").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def thresholds(spark, d):
    """Thresholds by key: a join with a small table, and its filter."""
    t = table(spark, d, "part").selectExpr("p_partkey AS l_partkey", "p_size % 40 AS least", "p_retailprice * 30 AS most")
    j = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(t, "l_partkey")
    return tidy(j.where("l_quantity >= least AND l_extendedprice <= most").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")))


def region_data(spark, d):
    """Sectors whose top follows from their data: the largest value of flagged points plus 1.5."""
    p = points(spark, d).withColumn("sector", F.floor(F.col("lon") / 90))
    top = p.where("kind <> 'view'").groupBy("sector").agg((F.max_by("lat", "recno") + 1.5).alias("top"))
    return tidy(p.join(top, "sector").where("lat < top").groupBy("sector").agg(F.count(F.lit(1)).alias("n")))


def polar(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 360 AS double) AS lon", "-60 - (c_custkey % 290) / 10 AS lat")
    x, y = G.to_polar(F.col("lon"), F.col("lat"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = G.from_polar(F.col("x"), F.col("y"))
    return tidy(p.select("c_custkey", "x", "y", G.wrap_360(lon).alias("lon"), lat.alias("lat")), 4)


_E = "sqrt(6.694379852e-3::DOUBLE)"
_CONF = "tan(3.141592654::DOUBLE / 4 - {0} / 2) / ((1 - {1} * sin({0})) / (1 + {1} * sin({0}))) ** ({1} / 2)"
_POLAR = f"""WITH p AS (SELECT c_custkey, (c_custkey % 360)::DOUBLE AS lon, (60 + (c_custkey % 290) / 10) / 57.29577951::DOUBLE AS la, 71 / 57.29577951::DOUBLE AS sl FROM customer),
q AS (SELECT *, 6378.137::DOUBLE * cos(sl) / sqrt(1 - 6.694379852e-3::DOUBLE * sin(sl) ** 2) / ({_CONF.format('sl', _E)}) * ({_CONF.format('la', _E)}) AS r FROM p)
SELECT c_custkey, round(r * sin(lon / 57.29577951::DOUBLE), 4) + 0.0 AS x, round(r * cos(lon / 57.29577951::DOUBLE), 4) + 0.0 AS y, round(lon, 4) + 0.0 AS lon, round(-la * 57.29577951::DOUBLE, 4) + 0.0 AS lat FROM q"""


def distance(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 180 AS double) AS a", "(c_custkey % 90) - 45D AS b", "(c_custkey % 179) + 0.5D AS e", "(c_custkey % 89) - 44D AS f")
    far, az = G.distance_azimuth(F.col("a"), F.col("b"), F.col("e"), F.col("f"))
    return tidy(p.select("c_custkey", far.alias("far"), az.alias("azimuth")), 4)


def dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    o = o.withColumn("n", D.date_to_number(F.col("day")))
    y, m = D.season(F.col("day"))
    back = D.number_to_date(F.col("n"))
    dec = D.number_to_year(F.col("n"))
    _, month = D.year_to_month(D.month_to_year(F.year("day"), F.month("day")))
    return tidy(
        o.select(
            "o_orderkey", "n", (back == F.col("day")).cast("int").alias("same"), dec.alias("decimal"), month.alias("month"), y.alias("season_year"), m.alias("season"), D.modified_julian_day(F.col("day")).alias("mjd"),
            D.with_day(F.col("n"), 15).alias("mid"), D.timestamp_to_seconds(F.col("day")).alias("secs"), D.year_to_number(D.month_to_year(F.year("day"), F.month("day"))).alias("n15"),
        )
    )


_DATES = """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders)
SELECT o_orderkey, (y * 10000 + m * 100 + dd)::BIGINT AS n, 1::BIGINT AS same, round(y + (m - 1) / 12 + dd / 365.25, 6) + 0.0 AS decimal, m::BIGINT AS month, (y + CASE WHEN m = 12 THEN 1 ELSE 0 END)::BIGINT AS season_year,
  (CASE WHEN m IN (12, 1, 2) THEN 12 ELSE (m // 3) * 3 END)::BIGINT AS season, datediff('day', DATE '1858-11-17', d)::BIGINT AS mjd, (y * 10000 + m * 100 + 15)::BIGINT AS mid,
  datediff('second', TIMESTAMP '1985-01-01', d::TIMESTAMP)::BIGINT AS secs, (y * 10000 + m * 100 + 15)::BIGINT AS n15 FROM o"""


def season_parts(spark, d):
    y, m = D.season(F.col("o_orderdate").cast("date"))
    return tidy(table(spark, d, "orders").groupBy(y.alias("year"), m.alias("season")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), 4)


def moving_months(spark, d):
    """Every order in the windows of three months, a month apart, that hold it."""
    o = table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m"), "o_totalprice")
    o = o.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("w", F.add_months("m", -F.col("k")))
    return tidy(o.groupBy(F.date_format("w", "yyyyMM").alias("start")).agg(F.count(F.lit(1)).alias("n")).where("start >= '199201'"))


def names(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("/data/ers1_"), F.lpad((F.col("c_custkey") % 9999 + 19920000).cast("string"), 8, "0"), F.lit("_19950301_"), F.lpad((F.col("c_custkey") % 24).cast("string"), 2, "0"), F.lit("_asc.h5")).alias("f"))
    return c.select("c_custkey", *[x.alias(k) for k, x in name_keys(F.col("f")).items()])


def records(spark, d):
    """Carrying the header: the last view before each other event of a track, and the bits of a word."""
    from ..sources.records import flags as bits

    w = Window.partitionBy("track").orderBy("recno").rowsBetween(Window.unboundedPreceding, 0)
    p = points(spark, d).withColumn("word", (F.col("recno") % 16384).cast("int")).withColumn("head", F.last(F.when(F.col("kind") == "view", F.col("recno")), True).over(w))
    return tidy(p.where("kind <> 'view' AND head IS NOT NULL").select("recno", "head", *[c.alias(k) for k, c in bits("word").items()]))


_REC = f"""WITH {POINTS}, a AS (SELECT recno, kind, recno % 16384 AS w, last_value(CASE WHEN kind = 'view' THEN recno END IGNORE NULLS) OVER (PARTITION BY track ORDER BY recno ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM pt)
SELECT recno, head, (CASE WHEN w & 10624 <> 0 THEN 1 ELSE 0 END)::BIGINT AS fprob, ((w >> 5) & 1)::BIGINT AS fret, (w & 3)::BIGINT AS fmode FROM a WHERE kind <> 'view' AND head IS NOT NULL"""


def except_names(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def unique(spark, d):
    return tidy(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).select(D.date_to_number(F.col("d")).alias("n")).distinct())


def folds(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return tidy(table(spark, d, "part").select("p_partkey", ((F.row_number().over(w) - 1) % 5).alias("fold")))


def field_sigma(spark, d):
    w = Window.partitionBy("l_linenumber")
    t = table(spark, d, "lineitem").withColumn("sd", F.stddev_samp("l_extendedprice").over(w)).withColumn("m", F.avg("l_extendedprice").over(w))
    return tidy(t.where("abs(l_extendedprice - m) <= 2 * sd").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")))


def few(spark, d):
    w = Window.partitionBy("l_partkey")
    return tidy(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.count("l_tax").over(w) >= 30, F.col("l_tax")).alias("tax")))


def merged(spark, d):
    """Union of months of a season by key."""
    o = table(spark, d, "orders").where("month(o_orderdate) IN (1, 4, 7, 10)")
    return tidy(o.groupBy(F.month("o_orderdate").alias("month"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


QUERIES = [
    ("OP-FILT-REGION", region, f"WITH {POINTS} SELECT kind, count(*) AS n FROM pt WHERE lat BETWEEN 10 AND 90 AND (lon BETWEEN 120 AND 240) GROUP BY kind"),
    ("OP-FILT-SUBREG", tiles, f"""WITH {POINTS}, t AS (SELECT range - 1 AS tile FROM range(7)), g AS (SELECT kind, tile, count(*) AS n FROM pt JOIN t ON lon >= tile * 90 - 5 AND lon < tile * 90 + 95 GROUP BY ALL)
  SELECT kind, tile, n, dense_rank() OVER (PARTITION BY kind ORDER BY tile) AS number FROM g"""),
    ("OP-FILT-SUBREG-ICE", region_data, f"""WITH {POINTS}, a AS (SELECT *, floor(lon / 90)::BIGINT AS sector FROM pt), t AS (SELECT sector, arg_max(lat, recno) + 1.5 AS top FROM a WHERE kind <> 'view' GROUP BY sector)
  SELECT sector, count(*) AS n FROM a JOIN t USING (sector) WHERE lat < top GROUP BY sector"""),
    ("OP-FILT-FLAGS", flags, """SELECT l_suppkey, count(*) FILTER (l_linenumber % 4 = 0 AND l_returnflag <> 'R') AS kept, round(100.0::DOUBLE * count(*) FILTER (NOT (l_linenumber % 4 = 0 AND l_returnflag <> 'R')) / count(*), 6) + 0.0 AS removed
  FROM lineitem GROUP BY 1"""),
    ("OP-FILT-TRK", both_classes, """WITH a AS (SELECT *, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS a, count(*) FILTER (o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS b FROM orders)
  SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM a WHERE a > 0 AND b > 0 AND o_orderstatus IN ('F', 'O') GROUP BY 1"""),
    ("OP-FILT-GLA", thresholds, "SELECT l_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= p_size % 40 AND l_extendedprice <= p_retailprice * 30 GROUP BY 1"),
    ("OP-FILT-STDFIELD", field_sigma, """SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM (SELECT *, stddev_samp(l_extendedprice) OVER w AS sd, avg(l_extendedprice) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_linenumber))
  WHERE abs(l_extendedprice - m) <= 2 * sd GROUP BY 1"""),
    ("OP-FILT-NPTS", few, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN count(l_tax) OVER (PARTITION BY l_partkey) >= 30 THEN l_tax END, 6) + 0.0 AS tax FROM lineitem"),
    ("OP-F-LL2XY", polar, _POLAR),
    ("OP-F-DISTAZ", distance, """WITH p AS (SELECT c_custkey, (c_custkey % 180)::DOUBLE AS a, (c_custkey % 90) - 45.0::DOUBLE AS b, (c_custkey % 179) + 0.5::DOUBLE AS e, (c_custkey % 89) - 44.0::DOUBLE AS f FROM customer),
  q AS (SELECT c_custkey, 6371.2::DOUBLE * cos(radians((b + f) / 2)) * radians(e - a) AS dx, 6371.2::DOUBLE * radians(f - b) AS dy FROM p) SELECT c_custkey, round(sqrt(dx * dx + dy * dy), 4) + 0.0 AS far, round(atan2(dx, dy), 4) + 0.0 AS azimuth FROM q"""),
    ("OP-D-NUM2DT", dates, _DATES),
    ("OP-PART-SEASON", season_parts, """SELECT (year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END)::BIGINT AS year, (CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 12 ELSE month(o_orderdate) // 3 * 3 END)::BIGINT AS season,
  count(*) AS n, round(avg(o_totalprice), 4) + 0.0 AS mean FROM orders GROUP BY 1, 2"""),
    ("OP-PART-MOVWIN", moving_months, """SELECT strftime(date_trunc('month', o_orderdate::DATE) - to_months(k::INT), '%Y%m') AS start, count(*) AS n FROM orders, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1 HAVING start >= '199201'"""),
    ("OP-D-KEYS", names, """SELECT c_custkey, 'ers1' AS sat, (c_custkey % 9999 + 19920000)::VARCHAR AS time1, '19950301' AS time2, lpad((c_custkey % 24)::VARCHAR, 2, '0') AS sector, 'asc' AS trk FROM customer"""),
    ("OP-DEC-FLAGS", records, _REC),
    ("OP-SET-EXCEPT", except_names, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    ("OP-SET-UNIQUE", unique, "SELECT DISTINCT (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::BIGINT AS n FROM orders"),
    ("OP-KFOLD", folds, "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 5 AS fold FROM part"),
    ("OP-SET-PICKMONTH", merged, "SELECT month(o_orderdate)::BIGINT AS month, o_orderstatus, count(*) AS n FROM orders WHERE month(o_orderdate) IN (1, 4, 7, 10) GROUP BY 1, 2"),
]
