"""Queries of stored data: written to the shared folder and read back, or decoded from binary content made from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import netcdf as N
from ..sources import storage as S
from ..sources import tables as T
from .views import SERIES, series, table, tidy

_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def matrix(spark, d):
    m = table(spark, d, "lineitem").selectExpr("array(cast(l_orderkey AS double), l_quantity, l_tax, l_discount) AS data")
    return tidy(S.name_columns(m, "data", {"tax": 2, "quantity": 1, "absent": 9}))


def grid(spark, d):
    c = series(spark, d)
    return tidy(S.optional_columns(c, ["cell", "t"], ["v", "n_ad"]))


def leaves(spark, d):
    return S.leaves({n: table(spark, d, n) for n in _NAMES})


def raster(spark, d):
    """A raster of 60 columns from parts' prices, as float32; every third cell, from the bottom."""
    p = table(spark, d, "part").selectExpr("cast(floor(p_partkey / 6000) AS bigint) AS f", "p_partkey", "if(p_partkey % 7 = 3, -9999D, p_retailprice) AS v")
    return tidy(S.read_raster(S.write_flat(p, "f", ["p_partkey"], ["v"], "<f4"), 60, 3).selectExpr("cast(path AS bigint) AS f", "ix", "iy", "v"), 2)


_RASTER = """WITH a AS (SELECT p_partkey // 6000 AS f, p_partkey % 6000 AS i, p_retailprice::FLOAT AS v, p_partkey % 7 AS k FROM part), n AS (SELECT f, count(*) // 60 AS rows FROM a GROUP BY f),
b AS (SELECT f, (i % 60) // 3 AS ix, (rows - 1) // 3 - (i // 60) // 3 AS iy, v, k FROM a JOIN n USING (f) WHERE i // 60 < rows AND (i % 60) % 3 = 0 AND (i // 60) % 3 = 0) SELECT f, ix, iy, round(v::DOUBLE, 2) + 0.0 AS v FROM b WHERE k <> 3"""


def text(spark, d):
    """A text table of blanks, sniffed and read back."""
    path = S.scratch(spark)
    T.write_text(tidy(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")), path)
    r = T.read_text_table(spark, path)
    return tidy(r.selectExpr("cast(_c0 AS bigint) AS k", "_c1 AS balance", "cast(_c2 AS bigint) AS nation"))


def csv(spark, d):
    path = S.scratch(spark)
    T.write_text(table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_name"), path, ";", True)
    return tidy(T.read_text_table(spark, path).selectExpr("cast(s_suppkey AS bigint) AS k", "cast(s_acctbal AS double) AS balance", "s_name AS name"))


def columns(spark, d):
    return tidy(spark.read.parquet(S.stored(series(spark, d).selectExpr("array(cast(cell AS double), cast(t AS double), v) AS data"))).selectExpr("cast(data[0] AS bigint) AS cell", "cast(data[1] AS bigint) AS t", "data[2] AS v"))


def appended(spark, d):
    s = series(spark, d).select("cell", "t", "v")
    path = S.stored(s.where("t < 30"))
    S.stored(s.where("t >= 30"), mode="append", path=path)
    return tidy(spark.read.parquet(path))


def more_columns(spark, d):
    one, two = S.stored(series(spark, d).select("cell", "t", "v")), S.scratch(spark)
    T.add_columns(spark, one, two, {"twice": F.col("v") * 2})
    return tidy(spark.read.parquet(two))


def by(keys, order):
    return lambda spark, d: tidy(spark.read.parquet(S.stored(series(spark, d).select("cell", "t", "v"), keys, order)).selectExpr("cast(cell AS bigint) AS cell", "cast(t AS bigint) AS t", "v"))


def parted(spark, d):
    """One folder per year of twelve epochs."""
    s = series(spark, d).selectExpr("cell", "t", "v", "cast(floor(t / 12) AS bigint) AS win")
    return tidy(spark.read.parquet(S.stored(s, ["win"], ["cell", "t"])).selectExpr("cast(win AS bigint) AS win", "cell", "t", "v"))


def cleaned(spark, d):
    s = series(spark, d).select("cell", "t", S.cleaned(F.col("g"), 3.0).alias("g"))
    return tidy(spark.read.parquet(S.stored(s, ["t"])).selectExpr("cell", "cast(t AS bigint) AS t", "g"))


def converted(spark, d):
    """Text to a table of typed, selected columns, and the table to text and back."""
    one = S.scratch(spark)
    T.write_text(tidy(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")), one)
    typed = spark.read.parquet(S.stored(T.read_text_table(spark, one).selectExpr("cast(_c2 AS int) AS nation", "cast(_c0 AS bigint) AS k")))
    two = S.scratch(spark)
    T.write_text(typed, two)
    return tidy(T.read_text_table(spark, two).selectExpr("cast(_c0 AS bigint) AS nation", "cast(_c1 AS bigint) AS k"))


def flat(spark, d):
    """A table to flat big-endian binary and back, one file per cell."""
    return tidy(S.read_flat(S.write_flat(series(spark, d), "cell", ["t"], ["t", "v"], ">f8"), ["t", "v"], ">f8").selectExpr("cast(path AS bigint) AS cell", "rowno", "cast(t AS bigint) AS t", "v"))


def recompressed(spark, d):
    one = S.stored(series(spark, d).select("cell", "t", "v"), codec="gzip")
    return tidy(spark.read.parquet(S.stored(spark.read.parquet(one), codec="snappy")))


def laser(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_orderkey", "730486 + l_partkey / 16 AS day", "l_suppkey % 360 - 180D AS lon", "l_extendedprice AS elev", "l_tax AS ocean_tide", "l_discount AS load_tide")
    return tidy(S.laser_points(p).select("l_orderkey", "secs00", "lon", "elev"))


def typed(spark, d):
    m = table(spark, d, "lineitem").selectExpr("array(cast(l_orderkey AS double), cast(l_linenumber AS double), l_tax) AS a")
    return tidy(m.selectExpr("cast(a[0] AS bigint) AS orbit", "cast(a[1] AS tinyint) AS flag", "cast(a[2] AS double) AS v"))


def zipped(spark, d):
    c = table(spark, d, "customer")
    return tidy(S.side_by_side([c.selectExpr("c_custkey AS n", "c_acctbal AS a"), c.selectExpr("c_custkey AS n", "c_nationkey AS b"), c.selectExpr("c_custkey AS n", "c_mktsegment AS c")], "n"))


def database(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_id * 3600.5D AS utc85", "if(event_id % 5 = 0, double('nan'), if(event_id % 7 = 0, null, value)) AS v")
    return tidy(S.database(e, "utc85").groupBy("year", "month", "season").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v")))


def classic(spark, d):
    """A series' rows in classic grid files with t as their record coordinate, read back within bounds of t that pass over whole files and ranges."""
    path = S.scratch(spark)
    N.write_classic(series(spark, d).select("cell", "t", "v").repartitionByRange(8, "t").sortWithinPartitions("t", "cell"), path, "t")
    return tidy(N.read_classic(spark, path, "t bigint, cell bigint, v double", 24, 59))


_SAME = f"WITH {SERIES} SELECT cell, t, round(v, 6) + 0.0 AS v FROM se"

QUERIES = [
    ("OP-SCAN-H5MAT", matrix, "SELECT round(l_tax, 6) + 0.0 AS tax, round(l_quantity, 6) + 0.0 AS quantity, NULL::DOUBLE AS absent FROM lineitem"),
    ("OP-SCAN-H5GRID", grid, f"WITH {SERIES} SELECT cell, t, round(v, 6) + 0.0 AS v, NULL::DOUBLE AS n_ad FROM se"),
    ("OP-SCAN-H5DICT", leaves, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {n})) AS columns FROM {n}" for n in _NAMES)),
    ("OP-SCAN-FLT", raster, _RASTER),
    ("OP-SCAN-NC", classic, f"WITH {SERIES} SELECT t, cell, round(v, 6) + 0.0 AS v FROM se WHERE t >= 24 AND t < 60"),
    ("OP-SCAN-CSV", csv, "SELECT s_suppkey AS k, round(s_acctbal, 6) + 0.0 AS balance, s_name AS name FROM supplier"),
    ("OP-SINK-TXT", text, "SELECT c_custkey AS k, round(c_acctbal, 6) + 0.0 AS balance, c_nationkey::BIGINT AS nation FROM customer"),
    ("OP-SINK-H5MAT", columns, _SAME),
    ("OP-SINK-H5TBL", appended, _SAME),
    ("OP-SINK-ADDCOL", more_columns, f"WITH {SERIES} SELECT cell, t, round(v, 6) + 0.0 AS v, round(v * 2, 6) + 0.0 AS twice FROM se"),
    ("OP-SINK-GRID", by(["cell"], ["t"]), _SAME),
    ("OP-SINK-PART", parted, f"WITH {SERIES} SELECT t // 12 AS win, cell, t, round(v, 6) + 0.0 AS v FROM se"),
    ("OP-SINK-SLABS", by(["t"], ["cell"]), _SAME),
    ("OP-SINK-NC", cleaned, f"WITH {SERIES} SELECT cell, t, round(CASE WHEN abs(g) > 3 THEN 0 ELSE coalesce(g, 0) END, 6) + 0.0 AS g FROM se"),
    ("OP-CONV", converted, "SELECT c_nationkey::BIGINT AS nation, c_custkey AS k FROM customer"),
    ("OP-CONV-BIN", flat, f"WITH {SERIES} SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY t) - 1 AS rowno, t, round(v, 6) + 0.0 AS v FROM se"),
    ("OP-CONV-COMP", recompressed, _SAME),
    ("OP-CONV-GLA", laser, "SELECT l_orderkey, round(l_partkey / 16 * 86400, 6) + 0.0 AS secs00, round(CASE WHEN l_suppkey % 360 < 180 THEN l_suppkey % 360 + 180 ELSE l_suppkey % 360 - 180 END, 6) + 0.0::DOUBLE AS lon, round(l_extendedprice + l_tax + l_discount, 6) + 0.0 AS elev FROM lineitem"),
    ("OP-CONV-TBL", typed, "SELECT l_orderkey AS orbit, l_linenumber::BIGINT AS flag, round(l_tax, 6) + 0.0 AS v FROM lineitem"),
    ("OP-JOINTBL", zipped, "SELECT c_custkey AS n, round(c_acctbal, 6) + 0.0 AS a, c_nationkey::BIGINT AS b, c_mktsegment AS c FROM customer"),
    ("OP-DB", database, """WITH a AS (SELECT TIMESTAMP '1985-01-01' + to_microseconds(event_id * 3600500000) AS t, value AS v FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0)
  SELECT year(t)::BIGINT AS year, month(t)::BIGINT AS month, (CASE WHEN month(t) IN (12, 1, 2) THEN 12 ELSE month(t) // 3 * 3 END)::BIGINT AS season, count(*) AS n, round(avg(v), 6) + 0.0 AS v FROM a GROUP BY ALL"""),
]
