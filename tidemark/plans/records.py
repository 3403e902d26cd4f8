"""Queries of record files: orders and their lines packed as binary altimeter files, decoded again; SQL works on the tables they were packed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records as R
from .views import table, tidy

# Whole numbers as they stand in the records, in words that both dialects read.
_RAW = {
    "f": "cast(floor(l_orderkey / 4000) AS bigint)", "k": "l_orderkey", "line": "cast(l_linenumber AS bigint)", "orbit": "o_custkey",
    "mjd": "cast(46066 + (year(o_orderdate) - 1985) * 366 + month(o_orderdate) * 31 + day(o_orderdate) AS bigint)", "sec": "o_orderkey % 86400", "fsec": "(o_orderkey * 7919) % 1000000",
    "retstat": "(o_orderkey * 31 + l_linenumber * 97) % 16384", "dsec": "l_linenumber * 1500000 + l_partkey % 1000", "lat": "-1000000 * (l_partkey % 91) - l_suppkey",
    "lon": "(l_suppkey % 541 - 181) * 1000000 + l_linenumber - 4", "surf": "CASE WHEN l_linenumber = 7 THEN -9999 ELSE cast(floor(l_extendedprice) AS bigint) END", "surfstat": "(l_partkey % 4) * 64",
    "iono": "CASE WHEN l_partkey % 17 = 0 THEN 32767 ELSE 5 END", "wet": "CASE WHEN l_suppkey % 19 = 0 THEN 32767 ELSE 6 END", "dry": "7", "stide": "8", "otide": "cast(floor(l_quantity) AS bigint) * 10",
    "agc": "l_linenumber * 100 + 5", "inc1": "100", "inc2": "CASE WHEN l_partkey % 29 = 0 THEN 32767 ELSE l_partkey % 300 END", "inc3": "CASE WHEN l_partkey % 23 = 0 THEN 32767 ELSE l_suppkey % 200 END", "sig0": "l_suppkey % 5000",
}
_HEAD = ["f", "k", "orbit", "mjd", "sec", "fsec"]


def _lines(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.selectExpr(*[f"{v} AS {k}" for k, v in _RAW.items()])


def files(spark, d, layout):
    lines = _lines(spark, d)
    cols = {k: F.col(k) for k in _RAW}
    data = lines.select("f", "k", "line", R.pack(layout.size, layout.data_tag, layout.data, cols).alias("x"))
    heads = lines.select(*_HEAD).distinct().select("f", "k", F.lit(0).cast("long").alias("line"), R.pack(layout.size, layout.head_tag, layout.head, cols).alias("x"))
    return R.to_files(data.unionByName(heads), "f", ["k", "line"], "x")


def _out(df, *columns):
    return tidy(df.select(F.col("src").cast("long").alias("f"), *columns), 6)


def _points(layout, modes, increment=None):
    return lambda s, d: _out(R.decode_points(files(s, d, layout), layout, modes, increment=increment), *_POINT)


_POINT = ["orbit", "utc85", "lat", "lon", "surf", "agc", "fmode", "fret", "fprob"]
_BASE = "r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _RAW.items()) + """ FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT *, (mjd - 46066) * 86400 + sec + fsec / 1e6::DOUBLE + dsec / 1e6::DOUBLE AS utc85, lat / 1e6::DOUBLE AS y, lon / 1e6::DOUBLE AS x, surf / 1e2::DOUBLE AS h, otide / 1e3::DOUBLE AS tide, agc / 1e2::DOUBLE AS g,
  (retstat >> 5) & 1 AS fret, CASE WHEN retstat & 10624 <> 0 THEN 1 ELSE 0 END AS fprob, (surfstat >> 7) & 1 AS fotide FROM r)"""
_VALID = "y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 360 AND NOT (abs(y) < 1e-6 AND y <> 0) AND NOT (abs(x) < 1e-6 AND x <> 0) AND surf <> -9999 AND iono <> 32767 AND wet <> 32767 AND dry <> 32767 AND stide <> 32767"
_EAST = "(CASE WHEN x < 0 THEN x + 360 ELSE x END)"


def _sql(surf: str, mode: str, where: str) -> str:
    return f"""WITH {_BASE} SELECT f, orbit, round(utc85, 6) + 0.0 AS utc85, round(y, 6) + 0.0 AS lat, round({_EAST}, 6) + 0.0 AS lon, round({surf}, 6) + 0.0 AS surf, round(g, 6) + 0.0 AS agc,
  ({mode})::BIGINT AS fmode, fret::BIGINT AS fret, fprob::BIGINT AS fprob FROM p WHERE {where}"""


_DETIDED = "h + CASE WHEN fotide = 1 THEN tide ELSE 0 END"


def waveforms(spark, d):
    return _out(R.decode_waveforms(files(spark, d, R.WAVEFORM)), *_POINT, "sig0")


def _region(box, to_360):
    return lambda s, d: _out(R.decode_region(files(s, d, R.RA1), R.RA1, box, to_360), "orbit", "utc85", "lat", "lon", "elev")


def _region_sql(lon: str, west: int, east: int) -> str:
    return f"""WITH {_BASE}, q AS (SELECT *, {lon} AS l FROM p) SELECT f, orbit, round(utc85, 6) + 0.0 AS utc85, round(y, 6) + 0.0 AS lat, round(CASE WHEN l < 0 THEN l + 360 ELSE l END, 6) + 0.0 AS lon,
  round(h + CASE WHEN inc2 <> 32767 THEN inc2 / 100 ELSE 0 END, 6) + 0.0 AS elev FROM q WHERE surf <> -9999 AND l BETWEEN {west} AND {east} AND y BETWEEN -80 AND -10"""


def _headers(spark, d):
    """One header record per file: its first and last date, of two digits a year before 2000."""
    day = lambda a: f"{a}(CASE WHEN year(o_orderdate) < 2000 THEN (year(o_orderdate) - 1900) * 10000 ELSE year(o_orderdate) * 10000 END + month(o_orderdate) * 100 + day(o_orderdate))"
    g = table(spark, d, "orders").groupBy(F.expr("cast(floor(o_orderkey / 4000) AS bigint)").alias("f")).agg(F.expr(day("min")).alias("first_date"), F.expr(day("max")).alias("last_date"))
    packed = R.pack(R.FILE_HEADER.size, "IH", R.FILE_HEADER.head, {k: F.col(k) for k in ("first_date", "last_date")})
    return R.to_files(g.select("f", packed.alias("x")), "f", [], "x")


def in_window(spark, d):
    """Files that begin in a window of months, and the year they begin in."""
    h = R.file_dates(_headers(spark, d)).where("first BETWEEN 199412 AND 199501")
    return tidy(h.selectExpr("cast(src AS bigint) AS f", "cast(first AS bigint) AS first", "cast(last AS bigint) AS last", "cast(floor(first / 100) AS bigint) AS year"))


def by_year(spark, d):
    """Files by the year of their first point."""
    p = R.carry_header(R.decode_records(files(spark, d, R.RA1), R.RA1), R.RA1)
    first = R.to_points(p).groupBy("src").agg(F.min_by("utc85", "recno").alias("t"))
    return tidy(first.select(F.col("src").cast("long").alias("f"), F.floor(F.lit(1985) + F.col("t") / (366 * 86400.0)).alias("year")))


def _decoded(spark, d):
    return R.carry_header(R.decode_records(files(spark, d, R.RA2), R.RA2), R.RA2)


def scaled(spark, d):
    return _out(R.decode_records(files(spark, d, R.RA2), R.RA2).where("tag = 'ID'"), "dsec", "lat", "lon", "surf", "otide", "agc")


def timed(spark, d):
    return _out(R.to_points(_decoded(spark, d)).groupBy("src", "orbit").agg(F.min("utc85").alias("first"), F.max("utc85").alias("last"), F.count(F.lit(1)).alias("n")), F.col("orbit").cast("long").alias("orbit"), "first", "last", "n")


def carried(spark, d):
    return _out(_decoded(spark, d).groupBy("src", "orbit", "sec").agg(F.count(F.lit(1)).alias("n"), F.sum("dsec").alias("dsec")), F.col("orbit").cast("long").alias("orbit"), F.col("sec").cast("long").alias("sec"), "n", "dsec")


def validated(spark, d):
    r = _decoded(spark, d)
    return _out(R.valid(r, R.CORRECTED).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat")), "n", "lat")


def detided(spark, d):
    r = _decoded(spark, d).where("surf_raw <> -9999")
    p = R.to_points(r, F.getbit(F.col("surfstat").cast("int"), F.lit(7)))
    return _out(p.groupBy("src").agg(F.sum("surf").alias("surf"), F.max("lon").alias("lon")), "surf", "lon")


def increments(spark, d):
    """All three increments: the surface with each, and the points that each leaves."""
    r = R.carry_header(R.decode_records(files(spark, d, R.RA1), R.RA1), R.RA1).where("surf_raw <> -9999")
    out = []
    for k in (1, 2, 3):
        p = R.to_points(r.where(f"inc{k} <> 32767"), increment=f"inc{k}")
        out.append(p.groupBy("src").agg(F.lit(k).alias("option"), F.count(F.lit(1)).alias("n"), F.sum("surf").alias("surf")))
    return _out(out[0].unionByName(out[1]).unionByName(out[2]), "option", "n", "surf")


def chunks(spark, d):
    """Chunks of 4,096 bytes of each file, the last one shorter."""
    c = files(spark, d, R.RA1).select(F.col("path").cast("long").alias("f"), "content")
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 4096).cast("int")))
    return tidy(c.withColumn("chunk", k).selectExpr("f", "chunk", "length(substring(content, chunk * 4096 + 1, 4096)) AS bytes"))


QUERIES = [
    ("OP-SCAN-IDR2", _points(R.RA2, 2), _sql(_DETIDED, "retstat & 3", _VALID)),
    ("OP-SCAN-IDR1", _points(R.RA1, 1, "inc3"), _sql(f"{_DETIDED} + inc3 / 100", "retstat & 1", f"{_VALID} AND inc3 <> 32767")),
    ("OP-SCAN-WDR", waveforms, _sql("h", "retstat & 1", "surf <> -9999").replace(" FROM p WHERE", ", round(sig0 / 100, 6) + 0.0 AS sig0 FROM p WHERE")),
    ("OP-SCAN-IDRPY", _region((100.0, 250.0, -80.0, -10.0), True), _region_sql(_EAST, 100, 250)),
    ("OP-SCAN-IDRPY2", _region((-170.0, -95.0, -80.0, -10.0), False), _region_sql("(CASE WHEN x > 180 THEN x - 360 ELSE x END)", -170, -95)),
    ("OP-SCAN-IDRHDR", in_window, """WITH a AS (SELECT floor(o_orderkey / 4000)::BIGINT AS f, CASE WHEN year(o_orderdate) < 2000 THEN (year(o_orderdate) - 1900) * 10000 ELSE year(o_orderdate) * 10000 END + month(o_orderdate) * 100 + day(o_orderdate) AS n FROM orders),
  b AS (SELECT f, min(n) // 100 AS a, max(n) // 100 AS z FROM a GROUP BY f), c AS (SELECT f, (CASE WHEN a <= 9912 THEN a + 190000 ELSE a END)::BIGINT AS first, (CASE WHEN z <= 9912 THEN z + 190000 ELSE z END)::BIGINT AS last FROM b)
  SELECT f, first, last, first // 100 AS year FROM c WHERE first BETWEEN 199412 AND 199501"""),
    ("OP-SCAN-IDRYEAR", by_year, f"WITH {_BASE} SELECT f, floor(1985 + arg_min(utc85, (k, line, utc85)) / (366 * 86400.0::DOUBLE))::BIGINT AS year FROM p GROUP BY f"),
    ("OP-SCAN-CHUNK", chunks, f"""WITH {_BASE}, n AS (SELECT f, (count(*) + count(DISTINCT k)) * 100 AS bytes FROM r GROUP BY f), c AS (SELECT f, bytes, unnest(range((bytes - 1) // 4096 + 1)) AS chunk FROM n)
  SELECT f, chunk, least(4096, bytes - chunk * 4096) AS bytes FROM c"""),
    ("OP-DEC-SCALE", scaled, f"WITH {_BASE} SELECT f, round(dsec / 1e6::DOUBLE, 6) + 0.0 AS dsec, round(y, 6) + 0.0 AS lat, round(x, 6) + 0.0 AS lon, round(h, 6) + 0.0 AS surf, round(tide, 6) + 0.0 AS otide, round(g, 6) + 0.0 AS agc FROM p"),
    ("OP-DEC-TIME", timed, f"WITH {_BASE} SELECT f, orbit, round(min(utc85), 6) + 0.0 AS first, round(max(utc85), 6) + 0.0 AS last, count(*) AS n FROM p GROUP BY f, orbit"),
    ("OP-DEC-CARRY", carried, f"WITH {_BASE} SELECT f, orbit, sec, count(*) AS n, round(sum(dsec / 1e6::DOUBLE), 6) + 0.0 AS dsec FROM p GROUP BY f, orbit, sec"),
    ("OP-DEC-VALID", validated, f"WITH {_BASE} SELECT f, count(*) AS n, round(avg(y), 6) + 0.0 AS lat FROM p WHERE {_VALID} GROUP BY f"),
    ("OP-DEC-TIDE", detided, f"WITH {_BASE} SELECT f, round(sum({_DETIDED}), 6) + 0.0 AS surf, round(max({_EAST}), 6) + 0.0 AS lon FROM p WHERE surf <> -9999 GROUP BY f"),
    ("OP-DEC-INC", increments, f"""WITH {_BASE}, i AS (SELECT f, h, unnest([1, 2, 3]) AS option, unnest([inc1, inc2, inc3]) AS inc FROM p WHERE surf <> -9999)
  SELECT f, option::BIGINT AS option, count(*) AS n, round(sum(h + inc / 100), 6) + 0.0 AS surf FROM i WHERE inc <> 32767 GROUP BY f, option"""),
]
