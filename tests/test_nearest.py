"""Nearest nodes against all pairs, and the number of candidates a point meets."""

import numpy as np
import pytest

from tidemark.operators import nearest as N

POINT, NODE = "id int, x double, y double, node string", "node long, nx double, ny double"


def _clouds():
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(400, 2)) * 1e-4 + 3
    yield "uniform", rng.uniform(0, 100, (150, 2)), rng.uniform(0, 100, (900, 2))
    yield "clusters", np.concatenate([tight[:50], rng.uniform(-50, 50, (60, 2))]), np.concatenate([tight, rng.uniform(-50, 50, (40, 2))])
    yield "lattice", np.stack(np.meshgrid(np.arange(0, 12, 0.5), np.arange(0, 12, 0.5)), -1).reshape(-1, 2), np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), -1).reshape(-1, 2)
    angle = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    yield "circle", np.concatenate([np.zeros((3, 2)), rng.normal(size=(40, 2))]), np.stack([np.cos(angle), np.sin(angle)], 1) * 10
    yield "one place", rng.uniform(0, 1, (30, 2)), np.full((300, 2), 0.25)
    yield "far", np.concatenate([rng.uniform(1e9, 1e9 + 1, (20, 2)), rng.uniform(0, 1, (20, 2))]), rng.uniform(0, 1, (200, 2))


def test_nearest_nodes_equal_all_pairs(spark):
    for name, p, n in _clouds():
        reach = 2.0 if name in ("uniform", "far") else None
        points = spark.createDataFrame([(i, float(x), float(y), "own") for i, (x, y) in enumerate(p)], POINT).drop("node")
        nodes = spark.createDataFrame([(1000 - i, float(x), float(y)) for i, (x, y) in enumerate(n)], NODE)
        got = {r["id"]: (r["distance"], r["node"]) for r in N.nearest_node(points, nodes, reach).collect()}
        d = np.hypot(n[None, :, 0] - p[:, None, 0], n[None, :, 1] - p[:, None, 1])
        for i, row in enumerate(d):
            if reach is not None and row.min() > reach:
                assert i not in got, name
            else:
                assert got[i][0] == pytest.approx(row.min(), rel=1e-12), name
                # the smallest number among the equally near ones, up to the last place of the two libraries
                assert got[i][1] in {1000 - k for k in np.flatnonzero(row <= row.min() * (1 + 1e-12))}, name
        if name in ("lattice", "one place"):
            assert all(got[i][1] == 1000 - np.flatnonzero(row == row.min()).max() for i, row in enumerate(d) if i in got)


def test_edges_of_nearest_nodes(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (None, 5.0, 5.0), (2, None, 1.0), (3, nan, 1.0), (4, float("inf"), 0.0)], "id int, x double, y double")
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (6, 0.0, 1.0), (None, 9.0, 9.0), (5, None, 0.0), (4, nan, 0.0)], NODE)
    got = sorted(((r["id"], r["node"], round(r["distance"], 6)) for r in N.nearest_node(points, nodes).collect()), key=str)
    assert got == [(1, 6, 1.0), (1, 6, 1.0), (None, None, round(32**0.5, 6))]
    assert N.nearest_node(points.limit(0), nodes).count() == N.nearest_node(points, nodes.limit(0)).count() == 0
    assert N.nearest_node(points, nodes.limit(0)).columns == N.nearest_node(points, nodes).columns == ["id", "x", "y", "node", "distance"]


def test_candidates_do_not_grow_with_the_nodes(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (500, 2)))], "id int, x double, y double")
    seen = []
    for n in (1000, 16000):
        nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (n, 2)))], NODE)
        keyed, near = N.candidates(points, nodes)
        seen.append(keyed.join(near, ["p_level", "p_tx", "p_ty"]).count() / 500)
    assert max(seen) < 250, seen
