"""Queries of fits that run as grouped NumPy kernels, one series a group. SQL has no such fits: tests/test_composites.py and tests/test_kernels.py compare each with loops or conditions of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import covariances as V
from ..operators import delaunay as D
from ..operators import fits as K
from ..operators import spatial as P
from .views import series, table, tidy


def _curve(kernel):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf["cell"], "t": pdf["t"], "y": kernel(pdf["t"].to_numpy(float), pdf["v"].to_numpy(float))})

    return lambda spark, d: tidy(K.per_series(series(spark, d), "cell", ["t"], run, "cell long, t long, y double"))


def _one(kernel, names):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = kernel(pdf["t"].to_numpy(float), pdf["v"].to_numpy(float))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], **{k: [float(v)] for k, v in zip(names, values, strict=True)}})

    return lambda spark, d: tidy(K.per_series(series(spark, d), "cell", ["t"], run, "cell long, " + ", ".join(f"{k} double" for k in names)))


def _peaks(pdf: pd.DataFrame) -> pd.DataFrame:
    found = K.extrema(pdf["v"].to_numpy(float), 1.0)
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]] * len(found), "t": [pdf["t"].iloc[i] for i, _ in found], "kind": [k for _, k in found]})


def peaks(spark, d):
    return tidy(K.per_series(series(spark, d), "cell", ["t"], _peaks, "cell long, t long, kind int"))


_WAVELETS = [("morlet", 6), ("real_morlet", 6), ("paul", 2), ("paul", 4), ("dog", 1), ("dog", 2), ("dog", 4), ("haar", 0)]


def _power(pdf: pd.DataFrame) -> pd.DataFrame:
    y, parts = pdf["v"].to_numpy(float), []
    for spacing, scales in (("log", K.wavelet_scales(16, 2)), ("linear", K.wavelet_scales(8, 1, False))):
        for kind, order in _WAVELETS:
            parts.append(pd.DataFrame({"cell": pdf["cell"].iloc[0], "wavelet": kind, "degree": order, "spacing": spacing, "scale": scales, "power": K.wavelet_power(y, scales, kind, order).mean(1)}))
    return pd.concat(parts)


def power(spark, d):
    """Mean power per scale of every family, at scales spaced by halves of octaves and by units."""
    return tidy(K.per_series(series(spark, d), "cell", ["t"], _power, "cell long, wavelet string, degree int, spacing string, scale double, power double"))


def _places(spark, d):
    return table(spark, d, "customer").selectExpr("c_nationkey AS cell", "c_custkey AS t", "c_acctbal / 1000 AS x", "cast(c_custkey % 20 AS double) AS y", "c_acctbal / 2000 + (c_custkey % 7) / 5 AS v")


_GX, _GY = (a.ravel() for a in np.meshgrid(np.arange(0, 10, 2.0), np.arange(0, 20, 4.0)))
_PARTS = ["ff", "fv", "f", "v"]


def krige(spark, d):
    """All places of a nation, through sums over their features: parts of a nation are summed in tasks of their own, and a system's size doesn't depend on the number of places."""
    p = _places(spark, d).where("x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")
    n, *box = p.agg(F.count("x"), F.least(F.min("x"), F.lit(_GX.min())), F.least(F.min("y"), F.lit(_GY.min())), F.greatest(F.max("x"), F.lit(_GX.max())), F.greatest(F.max("y"), F.lit(_GY.max()))).first()
    features = K.kriging_features(tuple(box[:2]), tuple(box[2:]), 3.0)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy(float) for c in ("x", "y", "v"))
        sums = None
        for a in range(0, len(v), 4096):
            own = K.kriging_sums(features(x[a : a + 4096], y[a : a + 4096]), v[a : a + 4096])
            sums = own if sums is None else {k: sums[k] + own[k] for k in _PARTS}
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "salt": [int(pdf["salt"].iloc[0])], **{k: [sums[k].tobytes()] for k in _PARTS}})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {k: sum(np.frombuffer(raw) for raw in pdf[k]) for k in _PARTS}
        sums["ff"] = sums["ff"].reshape(len(sums["f"]), -1)
        v, e = K.kriging_of_sums(sums, features(_GX, _GY))
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])] * len(_GX), "gx": _GX, "gy": _GY, "v": v, "e": e})

    salted = p.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(min(64, 1 + n // 100_000))))
    parts = K.per_series(salted, ["cell", "salt"], ["t"], part, "cell long, salt long, " + ", ".join(f"{k} binary" for k in _PARTS))
    return tidy(K.per_series(parts, "cell", ["salt"], solve, "cell long, gx double, gy double, v double, e double"))


def gridded(spark, d):
    """Customers' places gridded at nodes whose number grows with the suppliers; null outside the places' hull."""
    p = table(spark, d, "customer").selectExpr("c_acctbal / 100 + (c_custkey % 13) / 64 AS x", "(c_custkey * 7919 % 6007) / 100 AS y", "c_acctbal / 2000 + (c_custkey % 7) / 5 AS v")
    nodes = table(spark, d, "supplier").selectExpr("s_suppkey AS node", "s_suppkey % 37 * 3.0625D - 9 AS x", "floor(s_suppkey / 37) * 1.4375D % 62 AS y")
    return tidy(D.grid_linear(p, nodes))


_RADIUS, _LEAST, _MOST = 4.0, 30, 200.0  # of selection; observations; signal


def _collocate(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y, v = (pdf[c].to_numpy(float) for c in ("x", "y", "v"))
    far = np.arange(0, 30, 0.5)
    s, e = K.collocation(np.hypot(x[:, None] - x, y[:, None] - y), pdf["distance"].to_numpy(float), v - v.mean(), np.full(len(v), 0.3), far, 4 * np.exp(-((far / 4) ** 2)))
    if abs(s) > _MOST:
        s = e = 0.0
    return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "node": [int(pdf["node"].iloc[0])], "signal": [s], "error": [e]})


def collocate(spark, d):
    """Per nation and node: the signal from the nation's nearest places within the radius, so many in each quadrant; 0 with an error of 0 under the least number of places and beyond the largest signal."""
    p = _places(spark, d)
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(_GX, _GY, strict=True))], "node int, nx double, ny double")
    near = P.circle_join(nodes, p, _RADIUS)
    enough = near.groupBy("cell", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _LEAST)
    solved = K.per_series(V.nearest_by_quadrant(near, ["cell", "node"], "t").join(enough.drop("n"), ["cell", "node"]), ["cell", "node"], ["t"], _collocate, "cell long, node int, signal double, error double")
    every = p.select("cell").distinct().crossJoin(F.broadcast(nodes))
    out = every.join(solved, ["cell", "node"], "left").select("cell", F.col("nx").alias("gx"), F.col("ny").alias("gy"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("signal", "error")])
    return tidy(out)


QUERIES = [
    ("OP-FIT-RLM", _one(K.huber_line, ["slope", "start"]), None),
    ("OP-FIT-POLY", _one(lambda t, v: K.polynomial(t, v, 3), ["c3", "c2", "c1", "c0"]), None),
    ("OP-FIT-LSTSQCV", _one(lambda t, v: (lambda r: (r[0], r[1][-1]))(K.polynomial_by_folds(t, v)), ["degree", "start"]), None),
    ("OP-FIT-LASSOCV", _curve(lambda t, v: K.lasso_by_folds(t, v)), None),
    ("OP-FIT-HP", _curve(lambda t, v: K.trend_filter(v)), None),
    ("OP-FIT-SPLINE", _curve(lambda t, v: K.smoothing_spline(t, v, 10.0)), None),
    ("OP-WIN-SMOOTH", _curve(lambda t, v: K.smooth(v)), None),
    ("OP-WIN-FIR", _curve(lambda t, v: K.low_pass(v, 0.2)), None),
    ("OP-POST-PEAK", _curve(lambda t, v: np.nan_to_num(K.drop_peaks(t, v, 2.0), nan=-1.0)), None),
    ("OP-WIN-PEAKDET", peaks, None),
    ("OP-SPEC-CWT", power, None),
    ("OP-INT-KRIG", krige, None),
    ("OP-INT-GRIDDATA", gridded, None),
    ("OP-LSC-MAIN", collocate, None),
]
