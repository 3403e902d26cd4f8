"""Queries of grid cells: filters of pairs, binning, class statistics, editing, the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from .views import PAIRS, pairs, table, tidy

_FILTER = """(CASE WHEN sat IN ('ers1', 'ers2') THEN fmode1 = 1 AND fmode2 = 1 WHEN sat = 'envi' THEN fmode1 = 0 AND fmode2 = 0 ELSE false END)
  AND fbord1 = 0 AND fbord2 = 0 AND tide1 <> -9999 AND tide2 <> -9999"""


def _good(spark, d):
    c = F.col
    return pairs(spark, d).where(C.pair_filter(c("sat"), c("fmode1"), c("fmode2"), c("fbord1"), c("fbord2"), c("tide1"), c("tide2")))


def grid(spark, d, most=15.0, k=3.0, rounds=1):
    return tidy(C.cell_change(_good(spark, d), ["sat", "time1"], 0.0, 0.0, 10.0, 2.0, most, k, rounds=rounds))


def _grid_sql(most, k):
    stat = []
    for v in ("dh", "dg"):
        a, b = f"FILTER (cls = 'ad' AND {v} IS NOT NULL)", f"FILTER (cls = 'da' AND {v} IS NOT NULL)"
        n1, n2 = f"count(*) {a}", f"count(*) {b}"
        s1 = f"(CASE WHEN {n1} = 1 THEN 0.1 * abs(max({v}) {a}) ELSE stddev_samp({v}) {a} END)"
        s2 = f"(CASE WHEN {n2} = 1 THEN 0.1 * abs(max({v}) {b}) ELSE stddev_samp({v}) {b} END)"

        def pick(both, one, two):
            return f"CASE WHEN {n1} > 0 AND {n2} > 0 THEN {both} WHEN {n1} > 0 THEN {one} WHEN {n2} > 0 THEN {two} END"

        stat += [
            f"round({pick(f'({n1} * (median({v}) {a}) + {n2} * (median({v}) {b})) / ({n1} + {n2})', f'median({v}) {a}', f'median({v}) {b}')}, 6) + 0.0 AS {v}_mean",
            f"round({pick(f'sqrt({n1} * {s1} * {s1} + {n2} * {s2} * {s2}) / ({n1} + {n2})', f'{s1} / sqrt({n1})', f'{s2} / sqrt({n2})')}, 6) + 0.0 AS {v}_error",
            f"round({pick(f'abs((avg({v}) {a}) - (avg({v}) {b}))', s1, s2)}, 6) + 0.0 AS {v}_error2",
        ]
    return f"""WITH {PAIRS}, a AS (SELECT sat, time1, floor(lon / 10)::BIGINT + 1 AS ix, floor(lat / 2)::BIGINT + 1 AS iy,
  CASE WHEN ftrk2 = 0 AND ftrk1 = 1 THEN 'ad' WHEN ftrk2 = 1 AND ftrk1 = 0 THEN 'da' END AS cls, (h2 - tide2) - (h1 - tide1) AS dh, g2 - g1 AS dg FROM xo WHERE {_FILTER}),
b AS (SELECT *, count(dh) OVER w AS n, stddev_samp(dh) OVER w AS sd FROM a WHERE cls IS NOT NULL AND abs(dh) <= {most} WINDOW w AS (PARTITION BY sat, time1, iy, ix, cls)),
c AS (SELECT *, n <= 2 OR abs(dh) <= {k} * sd AS ok FROM b), e AS (SELECT *, max(ok::INT) OVER (PARTITION BY sat, time1, iy, ix) AS any_ok FROM c)
SELECT sat, time1, iy, ix, {', '.join(stat)}, count(*) FILTER (cls = 'ad') AS n_ad, count(*) FILTER (cls = 'da') AS n_da
FROM e WHERE ok OR any_ok = 0 GROUP BY sat, time1, iy, ix"""


def box(spark, d):
    """One box, no edit, means, both classes needed."""
    p = _good(spark, d).where("lon BETWEEN 10 AND 30 AND lat BETWEEN 2 AND 8").withColumn("dh", F.expr("(h2 - tide2) - (h1 - tide1)"))
    ad, da = F.expr("ftrk2 = 0 AND ftrk1 = 1"), F.expr("ftrk2 = 1 AND ftrk1 = 0")
    dh = F.col("dh")
    return tidy(
        p.groupBy("sat", "time1").agg(
            C.weighted_mean(dh, ad, da, False, False).alias("mean"), C.ordinary_mean(dh, ad, da, False).alias("omean"), C.weighted_error(dh, ad, da, False).alias("error"),
            C.class_difference(dh, ad, da, False).alias("error2"), F.count(F.when(ad, 1)).alias("n_ad"), F.count(F.when(da, 1)).alias("n_da"),
        )
    )


_BOX = f"""WITH {PAIRS}, p AS (SELECT *, (h2 - tide2) - (h1 - tide1) AS dh, ftrk2 = 0 AND ftrk1 = 1 AS ad, ftrk2 = 1 AND ftrk1 = 0 AS da FROM xo
  WHERE {_FILTER} AND lon BETWEEN 10 AND 30 AND lat BETWEEN 2 AND 8),
s AS (SELECT sat, time1, count(*) FILTER (ad) AS n1, count(*) FILTER (da) AS n2, avg(dh) FILTER (ad) AS m1, avg(dh) FILTER (da) AS m2,
  CASE WHEN count(*) FILTER (ad) = 1 THEN 0.1 * abs(max(dh) FILTER (ad)) ELSE stddev_samp(dh) FILTER (ad) END AS s1,
  CASE WHEN count(*) FILTER (da) = 1 THEN 0.1 * abs(max(dh) FILTER (da)) ELSE stddev_samp(dh) FILTER (da) END AS s2 FROM p GROUP BY sat, time1)
SELECT sat, time1, CASE WHEN n1 > 0 AND n2 > 0 THEN round((n1 * m1 + n2 * m2) / (n1 + n2), 6) + 0.0 END AS mean, CASE WHEN n1 > 0 AND n2 > 0 THEN round((m1 + m2) / 2, 6) + 0.0 END AS omean,
  CASE WHEN n1 > 0 AND n2 > 0 THEN round(sqrt(n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2), 6) + 0.0 END AS error, CASE WHEN n1 > 0 AND n2 > 0 THEN round(abs(m1 - m2), 6) + 0.0 END AS error2, n1 AS n_ad, n2 AS n_da FROM s"""


def binned(spark, d):
    return tidy(C.bin_stats(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 0.0, 0.0, 5.0, 0.02))


def sigma(spark, d, repeated=False):
    t = table(spark, d, "orders").selectExpr("o_custkey % 50 AS k", "o_totalprice - 150000 AS x")
    e = C.edit_sigma_repeated(t, ["k"], "x", 1.5) if repeated else C.edit_sigma(t, ["k"], "x", 1.5)
    return tidy(e.where("ok").groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("mean")), 4)


def _sigma_sql(rounds):
    q = "SELECT o_custkey % 50 AS k, o_totalprice - 150000 AS x FROM orders"
    for _ in range(rounds):
        q = f"SELECT k, x FROM (SELECT k, x, count(*) OVER (PARTITION BY k) AS n, stddev_samp(x) OVER (PARTITION BY k) AS sd FROM ({q})) WHERE n <= 2 OR abs(x) <= 1.5 * sd"
    return f"SELECT k, count(x) AS n, round(avg(x), 4) + 0.0 AS mean FROM ({q}) GROUP BY k"


_SIGMA_TO_THE_END = """WITH RECURSIVE e AS (SELECT o_custkey % 50 AS k, o_totalprice - 150000 AS x, 0 AS pass FROM orders
  UNION ALL SELECT k, x, pass + 1 FROM (SELECT *, count(*) OVER w AS n, 1.5 * stddev_samp(x) OVER w AS cut, max(abs(x)) OVER w AS most FROM e WINDOW w AS (PARTITION BY k)) WHERE n > 2 AND most > cut AND abs(x) <= cut),
s AS (SELECT k, pass, count(*) AS n, avg(x) AS mean, max(abs(x)) AS most, 1.5 * stddev_samp(x) AS cut FROM e GROUP BY k, pass)
SELECT k, n, round(mean, 4) + 0.0 AS mean FROM s WHERE n <= 2 OR most <= cut"""


def sigma_old(spark, d):
    t = table(spark, d, "orders").selectExpr("o_custkey % 50 AS k", "o_totalprice - 150000 AS x")
    return tidy(C.edit_sigma(t, ["k"], "x", 1.5, population=True).where("ok").groupBy("k").agg(F.count("x").alias("n"), F.stddev_pop("x").alias("sd")), 4)


def flag_counts(spark, d):
    g = pairs(spark, d).groupBy("fmode1", "fmode2").count()
    return tidy(g.crossJoin(F.broadcast(pairs(spark, d).agg(F.count(F.lit(1)).alias("total")))).selectExpr("fmode1", "fmode2", "count AS n", "100.0D * count / total AS percent"))


def histogram(spark, d):
    t = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return tidy(t.selectExpr("cast(floor((l_quantity - 0.5) / 5) AS int) AS bin", "l_quantity AS q").groupBy("bin").agg(F.count("q").alias("n"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("sd")))


def bin_mean(spark, d):
    """Histogram means whose last bin is closed."""
    t = table(spark, d, "lineitem").selectExpr("least(cast(floor(l_discount * 100 / 2.5) AS int), 3) AS bin", "l_tax AS z")
    return tidy(t.groupBy("bin").agg(F.avg("z").alias("mean")))


def time_range(spark, d):
    return tidy(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last")))


def summary(spark, d):
    t = table(spark, d, "part")
    return tidy(t.groupBy("p_brand").agg(F.min("p_retailprice").alias("least"), F.avg("p_retailprice").alias("mean"), F.max("p_retailprice").alias("most"), F.stddev_pop("p_retailprice").alias("sd")))


def dedup_mean(spark, d):
    return tidy(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax")))


def pair_counts(spark, d):
    return tidy(_good(spark, d).groupBy("sat").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.abs(F.col("h2") - F.col("h1")) <= 3, 1).otherwise(0)).alias("near")))


QUERIES = [
    ("OP-AGG-GRID", grid, _grid_sql(15.0, 3.0)),
    ("OP-AGG-GRIDGLA", lambda s, d: grid(s, d, 3.0, 2.0), _grid_sql(3.0, 2.0)),
    ("OP-AGG-BOX", box, _BOX),
    ("OP-FILT-XOVER", pair_counts, f"WITH {PAIRS} SELECT sat, count(*) AS n, sum(CASE WHEN abs(h2 - h1) <= 3 THEN 1 ELSE 0 END)::BIGINT AS near FROM xo WHERE {_FILTER} GROUP BY sat"),
    ("OP-AGG-BIN", binned, """SELECT floor(l_quantity / 5)::BIGINT + 1 AS ix, floor(l_discount / 0.02::DOUBLE)::BIGINT + 1 AS iy, round(median(l_extendedprice), 6) + 0.0 AS median,
  round(avg(l_extendedprice), 6) + 0.0 AS mean, count(*) AS n FROM lineitem GROUP BY ALL"""),
    ("OP-AGG-SIGEDIT", sigma, _sigma_sql(1)),
    ("OP-AGG-SIGEDIT-IT", lambda s, d: sigma(s, d, True), _SIGMA_TO_THE_END),
    ("OP-AGG-SIGEDIT-OLD", sigma_old, """SELECT k, count(x) AS n, round(stddev_pop(x), 4) + 0.0 AS sd FROM (SELECT o_custkey % 50 AS k, o_totalprice - 150000 AS x FROM orders
  QUALIFY count(*) OVER (PARTITION BY o_custkey % 50) <= 2 OR abs(x) <= 1.5 * stddev_pop(o_totalprice - 150000) OVER (PARTITION BY o_custkey % 50)) GROUP BY k"""),
    ("OP-AGG-FLAGCNT", flag_counts, f"WITH {PAIRS} SELECT fmode1::BIGINT AS fmode1, fmode2::BIGINT AS fmode2, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM xo), 6) + 0.0 AS percent FROM xo GROUP BY ALL"),
    ("OP-AGG-HIST", histogram, """SELECT floor((l_quantity - 0.5) / 5)::BIGINT AS bin, count(*) AS n, round(avg(l_quantity), 6) + 0.0 AS mean, round(stddev_pop(l_quantity), 6) + 0.0 AS sd
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY bin"""),
    ("OP-AGG-BINMEAN", bin_mean, "SELECT least(floor(l_discount * 100 / 2.5::DOUBLE)::BIGINT, 3) AS bin, round(avg(l_tax), 6) + 0.0 AS mean FROM lineitem GROUP BY bin"),
    ("OP-AGG-TRANGE", time_range, "SELECT o_orderstatus, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1"),
    ("OP-AGG-SUMMARY", summary, """SELECT p_brand, round(min(p_retailprice), 6) + 0.0 AS least, round(avg(p_retailprice), 6) + 0.0 AS mean, round(max(p_retailprice), 6) + 0.0 AS most,
  round(stddev_pop(p_retailprice), 6) + 0.0 AS sd FROM part GROUP BY 1"""),
    ("OP-AGG-DEDUPMEAN", dedup_mean, "SELECT l_partkey, round(avg(l_quantity), 6) + 0.0 AS quantity, round(avg(l_tax), 6) + 0.0 AS tax FROM lineitem GROUP BY 1"),
]
