"""Gridding of scattered points against a brute-force empty-circle test with fractions, on random and degenerate points, tile seams included."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from tidemark.operators import delaunay as D


def brute(points, q):
    """The value at q by the first triangle around it whose circle holds no point, then the fan rule on the points of that circle. points: {(x, y): v}."""
    f = {p: tuple(map(Fraction, p)) for p in points}
    fq = tuple(map(Fraction, q))

    def area(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def share(a, b, c):
        t = area(a, b, c)
        return (area(fq, b, c) / t, area(a, fq, c) / t, area(a, b, fq) / t) if t else (-1,)

    def centre(a, b, c):
        d = 2 * area(a, b, c)
        s = [p[0] ** 2 + p[1] ** 2 for p in (a, b, c)]
        return ((s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1])) / d, (s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])) / d)

    for t in combinations(f, 3):
        a, b, c = (f[p] for p in t)
        if min(share(a, b, c)) < 0:
            continue
        m = centre(a, b, c)
        far = {p: (x - m[0]) ** 2 + (y - m[1]) ** 2 for p, (x, y) in f.items()}
        r = far[t[0]]
        if min(far.values()) < r:
            continue
        ring = sorted(p for p in f if far[p] == r)
        found = []
        for x, y in combinations(ring[1:], 2):
            # an edge of the fan's outline: all others of the ring on one side
            sides = {area(f[x], f[y], f[p]) > 0 for p in ring if p not in (x, y)}
            w = share(f[ring[0]], f[x], f[y])
            if len(sides) == 1 and min(w) >= 0:
                found.append(sum(float(k) * points[p] for k, p in zip(w, (ring[0], x, y))))
        return found[0]
    return None


def cases():
    rng = np.random.default_rng(7)
    scattered = rng.random((26, 2)).round(3) * 10
    lattice = np.array([(x, y) for x in range(5) for y in range(5)], float)
    circle = np.array([(5 + 5 * a / c, 5 + 5 * b / c) for a, b, c in ((3, 4, 5), (-3, 4, 5), (3, -4, 5), (-3, -4, 5), (4, 3, 5), (-4, -3, 5), (1, 0, 1), (0, 1, 1), (-1, 0, 1))])
    dense = np.concatenate([rng.random((12, 2)) * 10, 2 + rng.random((14, 2)) * 0.05])
    sliver = np.concatenate([np.column_stack([np.linspace(0, 10, 15), 1e-7 * np.linspace(-1, 1, 15) ** 2]), [[5.0, 8.0]]])
    return {"scattered": scattered, "lattice": lattice, "circle": circle, "dense": dense, "sliver": sliver}


@pytest.mark.parametrize("name", ["scattered", "lattice", "circle", "dense", "sliver"])
def test_grid_matches_brute_force(spark, name):
    xy = cases()[name]
    v = np.random.default_rng(1).random(len(xy)).round(3)
    points = {(float(x), float(y)): float(z) for (x, y), z in zip(xy, v)}
    low, high = xy.min(0), xy.max(0)
    qs = [(float(x), float(y)) for x in np.linspace(low[0] - 0.5, high[0] + 0.5, 6) for y in np.linspace(low[1], high[1], 4)] + list(points)[:3]
    df = spark.createDataFrame([(*p, z) for p, z in points.items()], "x double, y double, v double")
    nodes = spark.createDataFrame([(i, *q) for i, q in enumerate(qs)], "node long, x double, y double")
    wanted = [brute(points, q) for q in qs]
    for most, sides in ((8, None), (5, 3)):
        got = {r["node"]: r["v"] for r in D.grid_linear(df, nodes, most, sides).collect()}
        assert len(got) == len(qs)
        for i, q in enumerate(qs):
            want = wanted[i]
            assert (got[i] is None) == (want is None), (q, got[i], want)
            assert want is None or got[i] == pytest.approx(want, abs=1e-9), q


def test_grid_of_awkward_points(spark):
    nan = float("nan")
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, None, 1.0), (4, nan, 0.0)], "node long, x double, y double")
    rows = [(0.0, 0.0, 1.0), (4.0, 0.0, 1.0), (0.0, 4.0, 3.0), (0.0, 4.0, 5.0), (1.0, None, 9.0), (1.0, 1.0, nan), (None, None, None)]
    got = {r["node"]: r["v"] for r in D.grid_linear(spark.createDataFrame(rows, "x double, y double, v double"), nodes).collect()}
    assert got == {1: pytest.approx(1.75), 2: None, 3: None, 4: None}  # the place given twice counts as its mean
    for few in (rows[:0], rows[:2], [(float(i), float(i), 1.0) for i in range(20)]):
        got = D.grid_linear(spark.createDataFrame(few, "x double, y double, v double"), nodes).collect()
        assert len(got) == 4 and all(r["v"] is None for r in got)


def test_hull_is_exact():
    xy = np.array([(0.1 * i, 0.3 * i) for i in range(10)] + [(0.9, 0.1), (0.5, 0.5)])
    corners = D.hull(xy)
    assert all(D.turn(xy[corners[i - 2]], xy[corners[i - 1]], xy[corners[i]]) > 0 for i in range(len(corners)))
    assert all(D.turn(xy[corners[i - 1]], xy[corners[i]], p) >= 0 for i in range(len(corners)) for p in xy)
