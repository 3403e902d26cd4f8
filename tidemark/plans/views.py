"""The driver's tables read as what the engine works on: pairs of elevations, points of tracks, referenced series. Each view exists as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = {"tinyint", "smallint", "int"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as long and doubles rounded, so that results compare whatever the order of summation."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((c.cast("long") if kind in WHOLE else F.round(c, digits) + F.lit(0.0) if kind in ("double", "float") else c).alias(name))
    return df.select(*out)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_suppkey % 3 WHEN 0 THEN 'ers1' WHEN 1 THEN 'ers2' ELSE 'envi' END AS sat",
        "cast(year(l_shipdate) as bigint) AS time1",
        "l_quantity AS lon",
        "l_discount * 100 AS lat",
        "15 + l_tax * 10 AS h1",
        "l_extendedprice / l_quantity / 100 AS h2",
        "0D AS tide1",
        "CASE WHEN l_linenumber = 7 THEN -9999D ELSE l_discount END AS tide2",
        "l_tax * 100 AS g1",
        "l_quantity AS g2",
        "l_orderkey % 2 AS ftrk1",
        "l_partkey % 2 AS ftrk2",
        "l_linenumber % 2 AS fmode1",
        "(l_linenumber + if(l_partkey % 5 = 0, 1, 0)) % 2 AS fmode2",
        "if(l_linenumber = 6, 1, 0) AS fbord1",
        "0 AS fbord2",
    )


PAIRS = """xo AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ers1' WHEN 1 THEN 'ers2' ELSE 'envi' END AS sat, year(l_shipdate)::BIGINT AS time1,
  l_quantity AS lon, l_discount * 100 AS lat, 15 + l_tax * 10 AS h1, l_extendedprice / l_quantity / 100 AS h2, 0::DOUBLE AS tide1,
  CASE WHEN l_linenumber = 7 THEN -9999::DOUBLE ELSE l_discount END AS tide2, l_tax * 100 AS g1, l_quantity AS g2,
  l_orderkey % 2 AS ftrk1, l_partkey % 2 AS ftrk2, l_linenumber % 2 AS fmode1, (l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) % 2 AS fmode2,
  CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS fbord1, 0 AS fbord2 FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS track", "event_id AS recno", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast(ts AS timestamp_ntz)) / 1e6 AS time", "value AS lat",
        "cast(event_id % 360 AS double) AS lon", "value * 2 + event_id % 7 AS elev", "event_type AS kind", "cast(ts AS timestamp_ntz) AS ts",
    )


POINTS = """pt AS (SELECT user_id AS track, event_id AS recno, epoch_us(ts) / 1e6 AS time, value AS lat, (event_id % 360)::DOUBLE AS lon,
  value * 2 + event_id % 7 AS elev, event_type AS kind, ts FROM events)"""


def referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr("cast(l_suppkey % 25 AS bigint) AS cell", "cast(year(l_shipdate) AS bigint) AS t_ref", "cast(l_linenumber AS bigint) AS k", "l_tax AS x", "l_discount AS y")
        .withColumn("t", F.col("t_ref") + 1 + F.col("k") % 3)
        .groupBy("cell", "t_ref", "t")
        .agg(F.avg(F.col("x") * 10 + F.col("y") * F.col("k")).alias("h"), (0.01 + F.avg("y")).alias("e"), F.count(F.lit(1)).alias("n"))
    )


REFERENCED = """rf AS (SELECT (l_suppkey % 25)::BIGINT AS cell, year(l_shipdate)::BIGINT AS t_ref, year(l_shipdate)::BIGINT + 1 + l_linenumber % 3 AS t,
  avg(l_tax * 10 + l_discount * l_linenumber) AS h, 0.01 + avg(l_discount) AS e, count(*) AS n FROM lineitem GROUP BY ALL)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly value per cell, month number t from 0 on."""
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 40 AS bigint) AS cell", "cast((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS bigint) AS t", "o_totalprice AS p", "o_orderpriority AS pr")
    return o.groupBy("cell", "t").agg((F.avg("p") / 9973.7).alias("v"), F.avg(F.when(F.col("pr") < "3", F.col("p") / 49973.7)).alias("g"))


SERIES = """se AS (SELECT (o_custkey % 40)::BIGINT AS cell, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::BIGINT AS t, avg(o_totalprice) / 9973.7::DOUBLE AS v,
  avg(CASE WHEN o_orderpriority < '3' THEN o_totalprice / 49973.7::DOUBLE END) AS g FROM orders GROUP BY ALL)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three instruments' values s1..s3 and numbers n1..n3 per cell and epoch; instrument 1 ends and 3 begins in the middle."""
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 15 AS bigint) AS cell", "cast(year(o_orderdate) AS bigint) AS t", "o_totalprice / 9973.7D AS p", "cast(substr(o_orderpriority, 1, 1) AS int) AS k")
    aggs = []
    for i, ok in ((1, "k = 1 AND t < 1996"), (2, "k = 2"), (3, "k = 3 AND t > 1994")):
        aggs += [F.avg(F.expr(f"CASE WHEN {ok} THEN p END")).alias(f"s{i}"), F.nullif(F.count(F.expr(f"CASE WHEN {ok} THEN p END")), F.lit(0)).alias(f"n{i}")]
    return o.groupBy("cell", "t").agg(*aggs)


INSTRUMENTS = """ins AS (SELECT cell, t, avg(p) FILTER (k = 1 AND t < 1996) AS s1, nullif(count(*) FILTER (k = 1 AND t < 1996), 0) AS n1, avg(p) FILTER (k = 2) AS s2, nullif(count(*) FILTER (k = 2), 0) AS n2,
  avg(p) FILTER (k = 3 AND t > 1994) AS s3, nullif(count(*) FILTER (k = 3 AND t > 1994), 0) AS n3
  FROM (SELECT (o_custkey % 15)::BIGINT AS cell, year(o_orderdate)::BIGINT AS t, o_totalprice / 9973.7::DOUBLE AS p, substr(o_orderpriority, 1, 1)::INT AS k FROM orders) GROUP BY ALL)"""
