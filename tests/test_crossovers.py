"""Crossovers by adaptive tiles against all pairs: dense places, segments through one place, long and short segments, tile borders."""

import numpy as np
import pytest

from tidemark.operators import tracks as T

SCHEMA = "track int, x_1 double, x_2 double, y_1 double, y_2 double, time_1 double, time_2 double"


def _brute(a, b):
    out = {}
    for i, (x1, x2, y1, y2) in enumerate(a):
        for k, (u1, u2, v1, v2) in enumerate(b):
            det = (x2 - x1) * (v2 - v1) - (y2 - y1) * (u2 - u1)
            if det:
                s = ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / det
                t = ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / det
                if 0 <= s < 1 and 0 <= t < 1:
                    out[i, 1000 + k] = (x1 + s * (x2 - x1), y1 + s * (y2 - y1))
    return out


def _frame(spark, rows, first):
    return spark.createDataFrame([(first + i, *map(float, r), 0.0, 1.0) for i, r in enumerate(rows)], SCHEMA)


def _segments(rng, centre, length, n):
    start, step = centre, rng.normal(size=(n, 2)) * length
    return np.stack([start[:, 0], start[:, 0] + step[:, 0], start[:, 1], start[:, 1] + step[:, 1]], 1)


def _inputs(rng):
    def mixed():
        tight = _segments(rng, rng.normal(size=(60, 2)) * 0.03 + 0.3, 0.02, 60)
        return np.concatenate([tight, _segments(rng, rng.uniform(-20, 20, (50, 2)), 2.0, 50), _segments(rng, rng.uniform(-20, 20, (4, 2)), 30.0, 4)])

    def star():
        a = rng.uniform(0, 2 * np.pi, 70)
        off = rng.normal(size=70) * 1e-3
        return np.stack([np.cos(a) + off, off - np.cos(a), np.sin(a), -np.sin(a)], 1)

    def lattice():
        k = np.arange(12.0)
        return np.concatenate([np.stack([k, k, k * 0 - 1, k * 0 + 12], 1), np.stack([k * 0 - 1, k * 0 + 12, k, k], 1)])

    yield mixed(), mixed(), "mixed"
    yield star(), star(), "star"
    yield lattice(), lattice(), "lattice"


def test_crossovers_equal_all_pairs(spark):
    for a, b, name in _inputs(np.random.default_rng(8)):
        want = _brute(a, b)
        one, two = _frame(spark, a, 0), _frame(spark, b, 1000)
        got = T.crossovers(one, two, [], "time", 2.0, most=1000 if name == "mixed" else 100).collect()
        assert len(got) == len(want) > 20, name
        for r in got:
            assert (r["x"], r["y"]) == pytest.approx(want[r["track1"], r["track2"]], abs=1e-9)


def test_edges_of_crossovers(spark):
    rows = [(0, 2, 0, 2), (float("nan"), 1, 0, 1), (0, float("inf"), 0, 1), (1, 1, 1, 1)]
    other = [(0, 2, 2, 0), (0, 2, 2, 0), (5, 6, 5, 6)]
    one, two = _frame(spark, rows, 0), _frame(spark, other, 1000)
    got = sorted((r["track1"], r["track2"], r["x"]) for r in T.crossovers(one, two, [], "time", 2.0, most=1).collect())
    assert got == [(0, 1000, 1.0), (0, 1001, 1.0)]
    assert T.crossovers(one.limit(0), two, [], "time", 2.0).count() == T.crossovers(one, two.limit(0), [], "time", 2.0).count() == 0


def test_no_task_holds_all_pairs_of_a_place(spark):
    """Forty thousand pairs through one place: no (tile, share) gets much more than `most` of them."""
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 200)
    rows = np.stack([np.cos(angle), -np.cos(angle), np.sin(angle), -np.sin(angle)], 1)
    one, two = _frame(spark, rows, 0), _frame(spark, rows[::-1], 1000)
    leaves, cuts = T.leaf_tiles(one, two, 2.0, 1000)
    a, b = (T._dealt(s, side, leaves, cuts, 2.0, 1000).groupBy("level", "tx", "ty", "_share").count() for s, side in ((one, "a"), (two, "b")))
    pairs = [r["n"] for r in a.join(b.withColumnRenamed("count", "m"), ["level", "tx", "ty", "_share"]).selectExpr("count * m AS n").collect()]
    assert len(pairs) > 20 and max(pairs) <= 3000
