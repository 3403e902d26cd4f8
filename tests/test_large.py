"""Results that small tables don't reach: late dates, ends of tables, many places."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries as core
from tidemark.operators import covariances, spatial, within


def both(spark, tmp_path, name, **tables):
    """A query's rows on tables given as SQL, and those of its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"CREATE TABLE {t} AS {sql}")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    df = core.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect())), con.execute(f"SELECT {columns} FROM ({core.oracle_sql()[name]}) ORDER BY ALL").fetchall()


def test_seconds_of_late_years(spark, tmp_path):
    """Years of five and six digits, more than 10**12 seconds, and years before 1985 and before the year 0."""
    got, want = both(spark, tmp_path, "OP-D-SEC2DT", events="SELECT unnest([0, 1, 99999, 2927375, 2927376, 35999999, 60000000, -1, -700000, -730000]) AS event_id")
    assert got == want and len(got) == 10


def test_end_of_a_table_of_covariances(spark, tmp_path):
    """A place exactly at the end of the table, as its SQL has it: 0."""
    supplier, customer = "SELECT 60 AS s_suppkey, 300.0::DOUBLE AS s_acctbal", "SELECT unnest([60, 120, 180, 240]) AS c_custkey, unnest([25.0::DOUBLE, 575.0, 574.99, 0.0]) AS c_acctbal"
    got, want = both(spark, tmp_path, "OP-LSC-COVINT", supplier=supplier, customer=customer)
    assert got == want and [c for _, _, c in got] == [0.0, 0.0, pytest.approx(0.138857, abs=1e-3), 0.0]


def scattered(seed, n, lattice):
    """Places in clusters, some of them equal; on whole numbers, so that many distances are at a limit, or anywhere."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.uniform(-12, 12, (n // 2, 2)), rng.normal(3, 0.4, (n // 4, 2)), np.repeat(rng.uniform(-5, 5, (n // 40, 2)), 10, 0)])
    if lattice:
        xy = np.round(xy * 2) / 2
    return xy[:, 0], xy[:, 1], rng.normal(1, 2, len(xy))


@pytest.mark.parametrize("lattice", [False, True])
def test_sums_within_are_those_of_all_pairs(spark, lattice):
    """In whole groups and in groups of a few nodes and places each."""
    x, y, v = scattered(1, 1600, lattice)
    places = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v))] + [(-1, None, 1.0, 1.0), (-2, float("nan"), 1.0, 1.0)], "id long, x double, y double, v double")
    nx, ny = x[::5] + (0.0 if lattice else 0.1), y[::5]
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(nx, ny))] + [(9999, 500.0, 0.0)], "node long, nx double, ny double")
    dx, dy = nx[:, None] - x, ny[:, None] - y
    for most in ((within.NODES, within.PLACES), (40, 150)):
        box = (np.abs(dx) <= 2.5) & (np.abs(dy) <= 2.5)
        got = {r["node"]: (r["n"], r["s"]) for r in within.node_sums(nodes, places, 2.5, {"s": F.col("v")}, box=True, most=most).collect()}
        assert got.keys() == set(np.flatnonzero(box.any(1))) and all(got[i][0] == k.sum() and abs(got[i][1] - v[k].sum()) < 1e-9 for i, k in enumerate(box) if k.any())
        far = np.sqrt(dx * dx + dy * dy)
        got = {r["node"]: (r["n"], r["distance"]) for r in within.node_distances(nodes, places, 2.5, most).collect()}
        near = dx * dx + dy * dy <= 6.25
        assert got.keys() == set(np.flatnonzero(near.any(1))) and all(got[i][0] == k.sum() and abs(got[i][1] - far[i][k].mean()) < 1e-9 for i, k in enumerate(near) if k.any())
        d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
        cls, upper = np.floor(d / 1.0 + 0.5), np.triu(np.ones(d.shape, bool))
        got = {r["class"]: (r["n"], r["cov"]) for r in within.class_products(places, 1.0, 4, most).collect()}
        for k in range(4):
            of = (cls == k) & upper
            assert got[k][0] == of.sum() and abs(got[k][1] - (v[:, None] * v)[of].mean()) < 1e-9


def test_covariances_and_counts_of_many_places(spark):
    """100,000 places in one tile and 1,000 nodes among them: five thousand million pairs, which no join goes through in a test's time."""
    places = spark.range(100000).selectExpr("id", "id % 100 / 100D AS x", "cast(id / 100 AS long) % 100 / 100D AS y", "id % 2 * 2D - 1 AS v")
    c = {r["class"]: (r["cov"], r["n"]) for r in spatial.covariance(places, 2.0, 3).collect()}
    assert sum(n for _, n in c.values()) == 100000 * 100001 // 2 and c[2] == (0.0, 0)
    nodes = spark.range(1000).selectExpr("id AS node", "0.5D AS nx", "0.5D AS ny")
    assert {(r["n"], round(r["distance"], 9)) for r in within.node_distances(nodes, places, 3.0).collect()} == {(100000, round(float(np.mean(np.hypot(*(np.mgrid[0:100, 0:100] / 100 - 0.5)))), 9))}
    got = within.node_sums(nodes, places, 3.0, {"v": F.col("v")}).collect()
    assert len(got) == 1000 and {(r["n"], r["v"]) for r in got} == {(100000, 0.0)}


def test_scale_within_is_that_of_rows(spark):
    """With a mean far from zero; a node with one kind only, and one with a single observation."""
    x, y, v = scattered(2, 800, False)
    o = spark.createDataFrame([(float(a), float(b), "g" if i % 3 == 0 else "h", float(c) * 1e-2 + 1e4) for i, (a, b, c) in enumerate(zip(x, y, v))] + [(90.0, 90.0, "h", 1e4), (91.0, 90.0, "h", 1e4 + 7), (200.0, 0.0, "g", 5.0)], "x double, y double, kind string, v double")
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x[::20], y[::20]))] + [(998, 90.0, 90.0), (999, 200.0, 0.0)], "node long, nx double, ny double")
    want = {r["node"]: r["scale"] for r in covariances.local_scale(spatial.circle_join(nodes, o, 2.0).select("node", "kind", "v"), 2.0, 40.0).collect()}
    got = {r["node"]: r["scale"] for r in covariances.local_scale_within(nodes, o, 2.0, 2.0, 40.0).collect()}
    assert got == pytest.approx(want, rel=1e-6) and len(got) > 30


@pytest.mark.parametrize("lattice", [False, True])
def test_nearest_within_are_those_of_rows(spark, lattice):
    """Many equally near places, quadrants with none, clusters; in whole groups and in small ones. No join of nodes with places is in the plan that solves."""
    x, y, v = scattered(4, 1600, lattice)
    places = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v))], "id long, x double, y double, v double")
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x[::9], y[::9]))] + [(9999, 13.5, 0.0), (10000, 500.0, 0.0)], "node long, nx double, ny double")
    rows = lambda df: sorted((r["node"], r["id"], round(r["distance"], 9), r["v"]) for r in df.collect())
    want = rows(covariances.nearest_by_quadrant(spatial.circle_join(nodes, places, 2.5), ["node"], most=5))
    assert rows(covariances.nearest_within(nodes, places, 2.5, ["v"], 5)) == want and len(want) > 2000
    parts = within.nearest_places(nodes, places, 2.5, 5, ["v"], most=(40, 150))
    assert rows(covariances.nearest_by_quadrant(parts, ["node"], most=5)) == want


def test_covariances_of_observations_at_the_end_of_a_table(spark, tmp_path):
    """Two places 5.5 apart, both near one node: 0, as the SQL of OP-LSC-OBS1/2 has it; and many more places around a node than are kept."""
    supplier = "SELECT unnest([60, 120]) AS s_suppkey, unnest([0.0::DOUBLE, 5000.0]) AS s_acctbal"
    customer = "SELECT 60 + range AS c_custkey, CASE range WHEN 0 THEN -275.0::DOUBLE WHEN 60 THEN 275 ELSE 4800 + range * 37 % 401 END AS c_acctbal FROM range(3000)"
    got, want = both(spark, tmp_path, "OP-LSC-OBS1/2", supplier=supplier, customer=customer)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=2e-6)
    assert [r[3] for r in got if r[0] == 60 and r[1] != r[2]] == [0.0, 0.0] and len(got) > 1000


@pytest.mark.parametrize("lattice", [False, True])
def test_pairs_apart_are_all_pairs(spark, lattice):
    """In whole groups and in small ones; limits are met exactly on a lattice. The plan makes no row of a pair that isn't one of the result."""
    x, y, _ = scattered(5, 800, lattice)
    places = spark.createDataFrame([(i * 7 % 1009, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(5000, None, 1.0)], "id long, x double, y double")
    ids, far = np.arange(len(x)) * 7 % 1009, np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    want = {(int(ids[i]), int(ids[j])): far[i, j] for i, j in zip(*np.nonzero((far >= 1) & (far < 2.5))) if ids[i] < ids[j]}
    for most in ((within.NODES, within.PLACES), (40, 150)):
        got = within.pairs_apart(places, 1.0, 2.5, most=most).collect()
        assert len(got) == len(want) and all(abs(want[r["a_id"], r["b_id"]] - r["distance"]) <= 5.1e-7 for r in got)
