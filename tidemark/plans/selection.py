"""Queries of selections, projections, partitions, unions, sorts and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection as S
from ..operators import spatial as P
from ..operators import within as W
from .views import POINTS, REFERENCED, SERIES, points, referenced, series, table, tidy

_C = "SELECT cell, t, "


def boxed(spark, d):
    p = points(spark, d)
    box = (90.0, 270.0, 10.0, 60.0)
    parts = [S.open_box(p, "lon", "lat", box, i).groupBy("kind").agg(F.lit(int(i)).alias("inside"), F.count(F.lit(1)).alias("n")) for i in (True, False)]
    return tidy(parts[0].unionByName(parts[1]))


def bounds(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_custkey % 400 - 190D AS l", "c_custkey % 380 - 100D AS r", "c_custkey % 190 - 95D AS b", "c_acctbal / 100 AS t")
    return tidy(c.select("c_custkey", S.valid_bounds(*[F.col(x) for x in "lrbt"]).cast("int").alias("ok")))


def nulled(spark, d):
    return tidy(series(spark, d).select("cell", "t", S.null_beyond(F.col("v") - 15, 2.0).alias("v")))


def blacklist(spark, d):
    s = series(spark, d).selectExpr("cell AS ix", "t AS iy", "v")
    places = spark.createDataFrame([(3.2, 10.1), (17.5, 4.4), (30.9, 55.0)], "x double, y double")
    return tidy(S.without_cells(s, places, 0.0, 0.0, 1.0, 1.0))


def where(spark, d):
    return tidy(table(spark, d, "orders").where("(o_orderstatus = 'F') AND (o_totalprice <> 0) AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_totalprice"))


def missing(spark, d):
    s = series(spark, d)
    return tidy(s.select("cell", F.when(F.col("g").isNull(), -1).otherwise(F.col("t")).alias("t"), S.mark_missing(F.col("g")).alias("g")))


def rooted(spark, d):
    return tidy(S.error_root(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5000.0))


def difference(spark, d):
    """Row by row: the difference of two columns of tables with the same row numbers, where the first one's value is negative."""
    c = table(spark, d, "customer")
    a, b = c.selectExpr("c_custkey AS n", "c_acctbal - 4000 AS a"), c.selectExpr("c_custkey AS n", "c_custkey / 7 AS b")
    return tidy(S.numbered_join(a, b, "n").where("a < 0").selectExpr("n", "a - b AS difference"))


def constants(spark, d):
    return tidy(table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal + 12.5D AS moved", "cast(0 AS bigint) AS campaign"))


def subset(spark, d):
    return tidy(S.subset(series(spark, d).selectExpr("cell AS ix", "t AS iy", "v"), (5, 20), (10, 40), ["v"]))


def campaigns(spark, d):
    """Biases of campaigns by key; a campaign without one is left as it is."""
    b = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS l_suppkey", "s_acctbal / 1e4 AS bias")
    j = table(spark, d, "lineitem").select("l_suppkey", "l_quantity").join(b, "l_suppkey", "left")
    return tidy(j.groupBy("l_suppkey").agg(F.avg(F.col("l_quantity") - F.coalesce("bias", F.lit(0.0))).alias("mean")))


def mask_areas(spark, d):
    """Flagged mask cells per grid cell, closed at both sides: cells on a border count on both."""
    m = table(spark, d, "part").selectExpr("p_partkey % 60 AS x", "p_size AS y").where("y % 4 <> 1").distinct()
    both = lambda c: F.array_distinct(F.array(F.floor(F.col(c) / 10), F.when(F.col(c) % 10 == 0, F.col(c) / 10 - 1).otherwise(F.floor(F.col(c) / 10)).cast("long")))
    m = m.withColumn("ix", F.explode(both("x"))).withColumn("iy", F.explode(both("y"))).where("ix BETWEEN 0 AND 5 AND iy BETWEEN 0 AND 5")
    return tidy(m.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("km2")))


def pairs(spark, d):
    """All pairs of places 1 to 3 apart, once."""
    p = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_acctbal / 100 AS x", "cast(c_custkey % 60 AS double) AS y")
    return W.pairs_apart(p, 1.0, 3.0)


def placed(spark, d):
    """Two subgrids of different origin in one full grid, by whole indices, over all epochs and cells; the grid has as many rows and epochs as the data, and other cells stay null."""
    s = series(spark, d).selectExpr("t", "cell % 6 AS a", "cast(floor(cell / 6) AS bigint) AS b", "v")
    one = s.where("b < 3").selectExpr("t", "-70 + (a + 0.5D) * 1.2D AS lon", "-80 + (b + 0.5D) * 0.4D AS lat", "v")
    two = s.where("b >= 3").selectExpr("t", "-70 + (a + 6.5D) * 1.2D AS lon", "-80 + (b + 0.5D) * 0.4D AS lat", "v")
    cells = S.place_subgrid(one.unionByName(two), -70.0, -80.0, 1.2, 0.4)
    extent = s.agg(F.max("t").alias("t"), F.max("b").alias("b"))
    grid = extent.select(F.explode(F.sequence(F.lit(0).cast("long"), "t")).alias("t"), "b").select("t", F.explode(F.sequence(F.lit(0).cast("long"), "b")).alias("iy")).select("t", "iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("ix"))
    return tidy(S.on_full_grid(cells, grid, ["v"]))


_PLACED = f"""WITH {SERIES}, a AS (SELECT t, cell % 6 + CASE WHEN cell // 6 >= 3 THEN 6 ELSE 0 END AS ix, cell // 6 AS iy, v FROM se),
g AS (SELECT x.t, y.iy, z.ix FROM (SELECT unnest(range((SELECT max(t) + 1 FROM se))) AS t) x, (SELECT unnest(range((SELECT max(cell // 6) + 1 FROM se))) AS iy) y, (SELECT unnest(range(12)) AS ix) z)
SELECT t, ix, iy, round(v, 6) + 0.0 AS v FROM g LEFT JOIN a USING (t, ix, iy)"""


def month_window(spark, d):
    o = S.in_months(table(spark, d, "orders"), "o_orderdate", 5, 8)
    return tidy(o.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


_SPANS = [("1995-02-20", "1995-03-21"), ("1995-03-01", "1995-06-30"), ("1996-10-03", "1996-11-08")]


def intervals(spark, d):
    o = S.in_intervals(table(spark, d, "orders"), "o_orderdate", _SPANS)
    return tidy(o.groupBy(F.date_format("middle", "yyyy-MM-dd").alias("middle")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


def months(spark, d):
    return tidy(table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


def years(spark, d):
    return tidy(table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


def epochs(spark, d):
    """Points by month, by season and by year; the first two ignore the year."""
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.create_map(*[x for k in ("month", "season", "year") for x in (F.lit(k), S.epoch(F.col("o_orderdate"), k))])).alias("by", "epoch"))
    return tidy(o.groupBy("by", "epoch").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


def moving(spark, d):
    """Windows of three months' length from the first of a month on, a month apart, closed at both ends: the current tool's moving windows."""
    w = spark.sql("SELECT explode(sequence(timestamp_ntz'1995-01-01 00:00:00', timestamp_ntz'1995-12-01 00:00:00', interval 1 month)) AS s").selectExpr("date_format(s, 'yyyy-MM-dd') AS start", "unix_timestamp(cast(s AS timestamp)) AS t1", "unix_timestamp(cast(s AS timestamp)) + 7889400 AS t2")
    o = table(spark, d, "orders").selectExpr("o_orderkey", "unix_timestamp(cast(o_orderdate AS timestamp)) AS t")
    return tidy(P.window_join(o, "t", w, 2629800.0).groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")))


def sector_parts(spark, d):
    s = P.sector_join(points(spark, d), "lon", 6, 2.5)
    return tidy(s.groupBy("sector", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("recno").alias("last")))


def _named(spark, d):
    """Points as rows of files of overlapping sectors."""
    p = P.sector_join(points(spark, d), "lon", 6, 2.5)
    return p.withColumn("path", F.concat(F.lit("/data/ers1_19920105_19920307_"), F.lpad(F.col("sector").cast("string"), 2, "0"), F.when(F.col("recno") % 2 == 0, "_asc").otherwise("_des"), F.lit(".h5")))


def joined_sectors(spark, d):
    """Sector files together, without the buffers in which they overlap."""
    s = S.own_sector(_named(spark, d), "path", "lon", 6)
    return tidy(s.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("recno").alias("points"), F.avg("elev").alias("mean")))


def merged_files(spark, d):
    """Rows of files whose names share a match: here satellite, dates and direction."""
    key = F.regexp_replace("path", r"_\d\d_", "_")
    return tidy(_named(spark, d).groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files")))


def merged_seasons(spark, d):
    m = F.month("o_orderdate")
    year = F.year("o_orderdate") + F.when(m == 12, 1).otherwise(0)
    s = table(spark, d, "orders").groupBy(year.alias("year"), S.epoch(F.col("o_orderdate"), "season").alias("season")).agg(F.countDistinct(F.trunc("o_orderdate", "month")).alias("months"), F.count(F.lit(1)).alias("n"))
    return tidy(s)


def stacked(spark, d):
    """One-step cubes on one time axis: steps of one series each, with their place."""
    parts = [series(spark, d).where(f"t % 3 = {k}") for k in range(3)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return tidy(u.select("cell", "t", "v", F.row_number().over(Window.partitionBy("cell").orderBy("t")).alias("step")))


def subgrids(spark, d):
    """Subgrids in space and in time: each covers some cells at some times; a cell and time that two have comes from the first."""
    s = series(spark, d).select("cell", "t", "v")
    a, b = s.where("cell < 25 AND t < 50").withColumn("r", F.lit(0)), s.where("cell >= 20 AND t >= 40").withColumn("r", F.lit(1)).withColumn("v", -F.col("v"))
    return tidy(a.unionByName(b).groupBy("cell", "t").agg(F.min_by("v", "r").alias("v")))


def framed(diagonal):
    return lambda spark, d: tidy(S.reference_frame(referenced(spark, d), "cell", diagonal))


def _frame_sql(value: str) -> str:
    return f"""WITH {REFERENCED}, a AS (SELECT cell, t_ref, t, h FROM rf WHERE t <> t_ref UNION ALL SELECT DISTINCT cell, t_ref, t_ref, {value} FROM rf) SELECT cell, t_ref, t, round(h, 6) + 0.0 AS h FROM a"""


def cube(spark, d):
    return tidy(S.dense_frame(series(spark, d).where("(cell + t) % 7 <> 3"), "cell", "t", "v"))


def file_order(spark, d):
    """Files in the order of the dates in their names."""
    return tidy(S.sorted_files(_files(spark, d), "path").select("path", "time1", "time2", "place"))


def _files(spark, d):
    p = F.concat(F.lit("/data/envi_"), F.date_format(F.date_add(F.lit("1992-01-01").cast("date"), (F.col("s_suppkey") * 37 % 2000).cast("int")), "yyyyMMdd"), F.lit("_"), F.date_format(F.date_add(F.lit("1998-01-01").cast("date"), (F.col("s_suppkey") * 11 % 900).cast("int")), "yyyyMMdd"), F.lit("_"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0"), F.lit("_grid.h5"))
    return table(spark, d, "supplier").select("s_suppkey", p.alias("path"))


_FILES = """fi AS (SELECT s_suppkey, '/data/envi_' || strftime(DATE '1992-01-01' + (s_suppkey * 37 % 2000)::INT, '%Y%m%d') || '_' || strftime(DATE '1998-01-01' + (s_suppkey * 11 % 900)::INT, '%Y%m%d') || '_' || lpad((s_suppkey % 20)::VARCHAR, 2, '0') || '_grid.h5' AS path FROM supplier)"""


def column_order(spark, d):
    """The place of each value of a column in its series' ascending order (ties by time)."""
    return tidy(series(spark, d).select("cell", "t", F.row_number().over(Window.partitionBy("cell").orderBy("v", "t")).alias("place")))


def first_dates(spark, d):
    """The first ten dates: a report."""
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct().orderBy("day").limit(10)


def rename(spark, d):
    return _files(spark, d).select("s_suppkey", S.renamed(F.col("path"), 3).alias("path"))


_SECT = """pp AS (SELECT pt.*, s, '/data/ers1_19920105_19920307_' || lpad(s::VARCHAR, 2, '0') || CASE WHEN recno % 2 = 0 THEN '_asc' ELSE '_des' END || '.h5' AS path
  FROM pt JOIN (SELECT range + 1 AS s, range * 60 - 2.5 AS a, range * 60 + 62.5 AS b FROM range(6)) ON lon BETWEEN a AND b OR lon + 360 BETWEEN a AND b OR lon - 360 BETWEEN a AND b)"""
_MONTHS = "count(*) AS n, max(o_orderkey) AS last FROM orders"

QUERIES = [
    ("OP-FILT-REGION-IO", boxed, f"""WITH {POINTS} SELECT kind, 1::BIGINT AS inside, count(*) AS n FROM pt WHERE lon > 90 AND lon < 270 AND lat > 10 AND lat < 60 GROUP BY kind
  UNION ALL SELECT kind, 0, count(*) FROM pt WHERE lon < 90 OR lon > 270 OR lat < 10 OR lat > 60 GROUP BY kind"""),
    ("OP-FILT-BOUNDS", bounds, """WITH c AS (SELECT c_custkey, c_custkey % 400 - 190 AS l, c_custkey % 380 - 100 AS r, c_custkey % 190 - 95 AS b, c_acctbal / 100 AS t FROM customer)
  SELECT c_custkey, (l BETWEEN -180 AND 360 AND r BETWEEN -180 AND 360 AND l < r AND b BETWEEN -90 AND 90 AND t BETWEEN -90 AND 90 AND b < t)::BIGINT AS ok FROM c"""),
    ("OP-FILT-ABSGRID", nulled, f"WITH {SERIES} {_C} round(CASE WHEN abs(v - 15) <= 2 THEN v - 15 END, 6) + 0.0 AS v FROM se"),
    ("OP-FILT-BLACKLIST", blacklist, f"WITH {SERIES} SELECT cell AS ix, t AS iy, round(v, 6) + 0.0 AS v FROM se WHERE NOT ((cell = 3 AND t = 10) OR (cell = 17 AND t = 4) OR (cell = 30 AND t = 54))"),
    ("OP-FILT-WHERE", where, "SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <> 0 AND o_orderpriority LIKE '1%'"),
    ("OP-FILT-NAN", missing, f"WITH {SERIES} SELECT cell, CASE WHEN g IS NULL THEN -1 ELSE t END AS t, round(coalesce(g, 999999), 6) + 0.0 AS g FROM se"),
    ("OP-FILT-ERR", rooted, "SELECT c_custkey, round(sqrt(c_acctbal), 6) + 0.0 AS c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000"),
    ("OP-PROJ-DIFF", difference, "SELECT c_custkey AS n, round(c_acctbal - 4000 - c_custkey / 7, 6) + 0.0 AS difference FROM customer WHERE c_acctbal < 4000"),
    ("OP-PROJ-CONST", constants, "SELECT s_suppkey, round(s_acctbal + 12.5, 6) + 0.0 AS moved, 0::BIGINT AS campaign FROM supplier"),
    ("OP-PROJ-SUBSET", subset, f"WITH {SERIES} SELECT cell AS ix, t AS iy, round(CASE WHEN cell NOT IN (5, 20) THEN v END, 6) + 0.0 AS v FROM se WHERE cell BETWEEN 5 AND 20 AND t BETWEEN 10 AND 40"),
    ("OP-JOIN-CAMP", campaigns, "SELECT l_suppkey, round(avg(l_quantity - coalesce(s_acctbal / 1e4, 0)), 6) + 0.0 AS mean FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON s_suppkey = l_suppkey GROUP BY 1"),
    ("OP-JOIN-AREA", mask_areas, """WITH m AS (SELECT DISTINCT p_partkey % 60 AS x, p_size AS y FROM part WHERE p_size % 4 <> 1), g AS (SELECT range % 6 AS ix, range // 6 AS iy FROM range(36))
  SELECT ix, iy, count(*) AS km2 FROM g JOIN m ON x BETWEEN ix * 10 AND ix * 10 + 10 AND y BETWEEN iy * 10 AND iy * 10 + 10 GROUP BY ALL"""),
    ("OP-JOIN-COVPAIR", pairs, """WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey % 60)::DOUBLE AS y FROM customer), j AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS far FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 3)
  SELECT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, round(far, 6) + 0.0 AS distance FROM j WHERE a_id < b_id AND far >= 1 AND far < 3"""),
    ("OP-JOIN-COORD", placed, _PLACED),
    ("OP-PART-MONTHWIN", month_window, f"SELECT year(o_orderdate)::BIGINT AS year, {_MONTHS} WHERE month(o_orderdate) BETWEEN 5 AND 8 GROUP BY 1"),
    ("OP-PART-INTERVAL", intervals, f"""WITH i AS (SELECT unnest([{', '.join(f"DATE '{a}'" for a, _ in _SPANS)}]) AS a, unnest([{', '.join(f"DATE '{b}'" for _, b in _SPANS)}]) AS b)
  SELECT strftime(a + ((b - a) // 2)::INT, '%Y-%m-%d') AS middle, count(*) AS n, max(o_orderkey) AS last FROM orders JOIN i ON o_orderdate::DATE BETWEEN a AND b GROUP BY 1"""),
    ("OP-PART-MONTH", months, f"SELECT year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, {_MONTHS} GROUP BY 1, 2"),
    ("OP-PART-YEAR", years, f"SELECT year(o_orderdate)::BIGINT AS year, {_MONTHS} GROUP BY 1"),
    ("OP-PART-EPOCH", epochs, f"""SELECT 'month' AS "by", month(o_orderdate)::BIGINT AS epoch, {_MONTHS} GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate), {_MONTHS} GROUP BY 2
  UNION ALL SELECT 'season', CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 12 ELSE month(o_orderdate) // 3 * 3 END, {_MONTHS} GROUP BY 2"""),
    ("OP-PART-TIME", moving, """WITH w AS (SELECT TIMESTAMP '1995-01-01' + to_months(range::INT) AS s FROM range(12)) SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n, max(o_orderkey) AS last
  FROM orders JOIN w ON epoch(o_orderdate) BETWEEN epoch(s) AND epoch(s) + 7889400 GROUP BY 1"""),
    ("OP-PART-SECTOR", sector_parts, f"WITH {POINTS}, {_SECT} SELECT s AS sector, kind, count(*) AS n, max(recno) AS last FROM pp GROUP BY ALL"),
    ("OP-UNION-SECT", joined_sectors, f"WITH {POINTS} SELECT floor(lon / 60)::BIGINT + 1 AS sector, count(*) AS n, count(DISTINCT recno) AS points, round(avg(elev), 6) + 0.0 AS mean FROM pt GROUP BY 1"),
    ("OP-UNION-MERGE", merged_files, f"WITH {POINTS}, {_SECT} SELECT regexp_replace(path, '_[0-9][0-9]_', '_') AS name, count(*) AS n, count(DISTINCT path) AS files FROM pp GROUP BY 1"),
    ("OP-UNION-SEASON", merged_seasons, """SELECT (year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END)::BIGINT AS year, (CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 12 ELSE month(o_orderdate) // 3 * 3 END)::BIGINT AS season,
  count(DISTINCT date_trunc('month', o_orderdate)) AS months, count(*) AS n FROM orders GROUP BY 1, 2"""),
    ("OP-UNION-GRID", stacked, f"WITH {SERIES} {_C} round(v, 6) + 0.0 AS v, row_number() OVER (PARTITION BY cell ORDER BY t) AS step FROM se"),
    ("OP-UNION-SUBGRID", subgrids, f"WITH {SERIES} {_C} round(CASE WHEN cell < 25 AND t < 50 THEN v ELSE -v END, 6) + 0.0 AS v FROM se WHERE (cell < 25 AND t < 50) OR (cell >= 20 AND t >= 40)"),
    ("OP-PIVOT-REF", framed(0.0), _frame_sql("0::DOUBLE")),
    ("OP-PIVOT-REF1", framed(None), _frame_sql("NULL::DOUBLE")),
    ("OP-PIVOT-CUBE", cube, f"""WITH {SERIES}, s AS (SELECT * FROM se WHERE (cell + t) % 7 <> 3) SELECT cell, t, round(v, 6) + 0.0 AS v FROM (SELECT DISTINCT cell FROM s) CROSS JOIN (SELECT DISTINCT t FROM s) LEFT JOIN s USING (cell, t)"""),
    ("OP-SORT-FILES", file_order, f"WITH {_FILES} SELECT path, path[12:19] AS time1, path[21:28] AS time2, row_number() OVER (ORDER BY path[12:19], path[21:28], path) AS place FROM fi"),
    ("OP-SORT-COL", column_order, f"WITH {SERIES} {_C} row_number() OVER (PARTITION BY cell ORDER BY v, t) AS place FROM se"),
    ("OP-LIMIT-PRINT", first_dates, "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY day LIMIT 10"),
    ("OP-RENAME", rename, f"WITH {_FILES} SELECT s_suppkey, path[1:28] || '_' || lpad((s_suppkey % 20 + 3)::VARCHAR, 2, '0') || '_grid.parquet' AS path FROM fi"),
]
