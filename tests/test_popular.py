"""Popular groups: exact medians by rank selection, and the flagship on cells that hold a third of all rows."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells


@pytest.mark.parametrize("small", [7, 100])
def test_medians_are_exact(spark, small):
    rng = np.random.default_rng(small)
    groups = {
        None: rng.normal(size=700).tolist(), 1: [5.0] * 400, 2: (10.0 ** rng.uniform(-9, 9, 301)).tolist(), 3: [1.0, 2.0] * 150, 4: [3.0], 5: [-1.7e308, 1.7e308, 1.0, -1.0] * 3,
        6: [float("nan"), None, 4.0, 6.0], 7: [None], 8: rng.integers(0, 5, 333).astype(float).tolist(), 9: [-0.0, 0.0, 0.0, 1e-320],
    }
    rows = [(k, x, "clash") for k, v in groups.items() for x in v]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k int, x double, median string").repartition(5)
    got = {r["k"]: r["median"] for r in cells.exact_medians(df, ["k"], "x", small, bins=16).collect()}
    want = {k: [x for x in v if x is not None and x == x] for k, v in groups.items()}
    assert got == {k: pytest.approx(statistics.median(v), rel=1e-12, abs=0) for k, v in want.items() if v}
    assert cells.exact_medians(df.limit(0), ["k"], "x", small).count() == 0


def test_popular_cells_give_the_same_change(spark):
    """Cells above the limit (all, some, none): the same rows, emptied and one-sided classes and both kinds of mean included."""
    rng = np.random.default_rng(3)
    n = 1500
    lon = np.where(rng.random(n) < 0.35, 5.0, rng.uniform(0, 50, n))
    dh = rng.normal(0, 2, n) + np.where(rng.random(n) < 0.05, 9, 0) + (lon == 5.0) * 3
    rows = [("s" if i % 3 else None, float(lon[i]), float(lat), 0.0, float(dh[i]), 0.0, 0.0, float(i % 7), None if i % 11 == 0 else float(i % 13), i % 2, (i + (i % 5 > 0)) % 2) for i, lat in enumerate(np.where(lon == 5.0, 1.0, rng.uniform(0, 6, n)))]
    df = spark.createDataFrame(rows, "sat string, lon double, lat double, h1 double, h2 double, tide1 double, tide2 double, g1 double, g2 double, ftrk1 int, ftrk2 int")

    def result(**more):
        out = cells.cell_change(df, ["sat"], 0.0, 0.0, 10.0, 2.0, 15.0, 1.5, **more)
        return sorted(map(tuple, out.select(*sorted(out.columns)).collect()), key=str)

    for more in ({}, {"rounds": 2, "use_all": False, "median": False}):
        want = result(**more)
        for small in (60,):
            got = result(small=small, **more)
            assert len(got) == len(want)
            for a, b in zip(sorted(got, key=lambda r: str(r[-4:])), sorted(want, key=lambda r: str(r[-4:]))):
                assert [x if x is None or isinstance(x, (int, str)) else pytest.approx(x, abs=1e-9) for x in b] == list(a)


def test_a_popular_group_is_spread(spark):
    """A third of all rows in one group: the search's stages gather bins, not rows; nothing is collected but what is at most `small`."""
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"), F.xxhash64("id").cast("double").alias("x"))
    got = {r["k"]: r["median"] for r in cells.exact_medians(df, ["k"], "x", 1000).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("x").alias("m")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
