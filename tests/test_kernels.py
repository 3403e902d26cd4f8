import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import geo as G
from tidemark.operators import cells, fits, series, tracks


def test_huber_line_resists_outliers():
    x = np.arange(30.0)
    y = 2 * x + 1
    y[5] = 500
    slope, start = fits.huber_line(x, y)
    assert abs(slope - 2) < 0.02 and abs(start - 1) < 0.3
    assert np.isnan(fits.huber_line(x[:1], y[:1])[0])


def test_polynomials():
    x = np.linspace(0, 5, 40)
    assert np.allclose(fits.polynomial(x, x**3 - x, 3), [1, 0, -1, 0], atol=1e-8)
    degree, c = fits.polynomial_by_folds(x, 3 * x**2 + 0.01 * np.sin(50 * x))
    assert degree >= 2 and np.abs(np.polyval(c, x) - 3 * x**2).max() < 0.05
    assert np.isnan(fits.polynomial(x[:2], x[:2], 1)).all()
    assert np.abs(fits.lasso_polynomial(x, x**2, penalty=1e-4, rounds=5000) - x**2).max() < 0.5


def test_filters_keep_lines():
    line = np.arange(20.0) * 0.5
    assert np.allclose(fits.trend_filter(line), line)
    assert np.allclose(fits.smoothing_spline(np.arange(20.0), line, 5.0), line)
    assert np.allclose(fits.low_pass(np.ones(60), 0.3), 1)
    assert np.allclose(fits.smooth(np.ones(30)), 1)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60), st.floats(0.1, 3))
def test_extrema_alternate(v, delta):
    found = fits.extrema(np.array(v), delta)
    kinds = [k for _, k in found]
    assert kinds == [1, -1] * (len(kinds) // 2) + [1] * (len(kinds) % 2)
    for (i, a), (j, _) in zip(found, found[1:], strict=False):
        assert a * (v[i] - v[j]) > delta


def test_wavelet_finds_the_period():
    t = np.arange(256)
    scales = np.array([2.0, 4, 8, 16, 32])
    p = fits.wavelet_power(np.sin(2 * np.pi * t / 16), scales).mean(1)
    assert scales[p.argmax()] == 16


def test_wavelets_are_convolutions():
    """Each family against the sum over the series of values times the wavelet's own formula; Haar and Paul keep some of their spectrum beyond the sampling's highest frequency, which costs accuracy."""
    from math import factorial, gamma

    rng = np.random.default_rng(5)
    n = 256
    y = np.convolve(rng.normal(size=n), np.ones(9) / 9, "same")
    y -= y.mean()
    t = (np.arange(n) + n // 2) % n - n // 2
    own = {
        ("morlet", 6): lambda x: np.pi**-0.25 * np.exp(6j * x - x * x / 2),
        ("real_morlet", 6): lambda x: np.sqrt(2) * np.pi**-0.25 * np.cos(6 * x) * np.exp(-x * x / 2),
        ("dog", 1): lambda x: -x * np.exp(-x * x / 2) / np.sqrt(gamma(1.5)),
        ("dog", 2): lambda x: (1 - x * x) * np.exp(-x * x / 2) / np.sqrt(gamma(2.5)),
        ("dog", 4): lambda x: -(x**4 - 6 * x * x + 3) * np.exp(-x * x / 2) / np.sqrt(gamma(4.5)),
        **{("paul", m): lambda x, m=m: 2.0**m * factorial(m) / np.sqrt(np.pi * factorial(2 * m)) * (1 - 1j * x) ** -(m + 1.0) for m in (2, 4)},
        ("haar", 0): lambda x: np.where((x > -0.5) & (x < 0), 1.0, 0) - np.where((x > 0) & (x < 0.5), 1.0, 0) + 0.5 * (x == -0.5) - 0.5 * (x == 0.5),
    }
    for (kind, order), psi in own.items():
        for scale in (6.0, 12.0):
            # the series repeats, and so does the wavelet
            kernel = sum(np.conj(psi((t + n * k) / scale)) for k in range(-50, 51)) / np.sqrt(scale)
            want = np.array([np.sum(y * np.roll(kernel, k)) for k in range(n)])
            got = fits.wavelet_transform(y, np.array([scale]), kind, order)[0]
            assert np.abs(got - want).max() < {"haar": 0.5 / scale, "paul": 1e-4}.get(kind, 1e-5) * np.abs(want).max(), (kind, order, scale)
    assert np.allclose(fits.wavelet_scales(16, 2), 2 * 2 ** (np.arange(7) / 2)) and np.allclose(fits.wavelet_scales(8, 1, False), np.arange(2, 9))


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 40), st.floats(0.01, 1000), st.integers(0, 10**6))
def test_banded_solutions_are_the_dense_ones(n, penalty, seed):
    rng = np.random.default_rng(seed)
    y, x = rng.normal(size=n), np.cumsum(rng.uniform(0.2, 3, n))
    d = np.diff(np.eye(n), 2, axis=0)
    assert np.allclose(fits.trend_filter(y, penalty), np.linalg.solve(np.eye(n) + penalty * d.T @ d, y), atol=1e-7)
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j < n - 3:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    assert np.allclose(fits.smoothing_spline(x, y, penalty), y - penalty * q @ np.linalg.solve(r + penalty * q.T @ q, q.T @ y), atol=1e-6)


def test_filters_of_a_long_series():
    x = np.arange(1_000_000.0)
    line = 0.25 * x - 7
    noise = np.where(x % 2 == 0, 1.0, -1.0)
    assert np.abs(fits.trend_filter(line + noise, 100.0) - line)[100:-100].max() < 0.01
    assert np.abs(fits.smoothing_spline(x, line + noise, 100.0) - line)[100:-100].max() < 0.01


def test_kriging_and_collocation_meet_their_points():
    x, y = np.array([0.0, 3, 6, 9]), np.array([0.0, 1, 0, 1])
    v = np.array([1.0, 2, 0, -1])
    got, err = fits.kriging(x, y, v, x, y, 2.0, 1e-6)
    assert np.allclose(got, v, atol=1e-2) and (err < 0.1).all()
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    table = np.arange(0, 20, 0.1)
    s, e = fits.collocation(d, d[1], v, np.full(4, 1e-3), table, np.exp(-((table / 3) ** 2)))
    assert abs(s - 2) < 1e-2 and e < 0.05


def test_geo_round_trip(spark):
    p = spark.createDataFrame([(float(a), float(b)) for a in (0, 45, 179, 300) for b in (-89, -75, -60)], "lon double, lat double")
    x, y = G.to_polar(F.col("lon"), F.col("lat"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = G.from_polar(F.col("x"), F.col("y"))
    for r in p.select("lon", "lat", G.wrap_360(lon).alias("a"), lat.alias("b")).collect():
        assert abs(r["lat"] - r["b"]) < 1e-6 and min(abs(r["lon"] - r["a"]), 360 - abs(r["lon"] - r["a"])) < 1e-6


def test_dates(spark):
    r = spark.range(1).select(
        D.seconds_to_timestamp(F.lit(86400.25)).cast("string").alias("ts"), D.year_to_number(F.lit(1995.0)).alias("n"), D.century(F.lit(92)).alias("c"), D.number_to_date(F.lit(19960229)).cast("string").alias("d")
    ).first()
    assert (r["ts"], r["n"], r["c"], r["d"]) == ("1985-01-02 00:00:00.25", 19950115, 1992, "1996-02-29")


def test_track_split_edges(spark):
    rows = [("a", i, float(t), lat) for i, (t, lat) in enumerate([(0, 3.0), (1, 2.0), (2, 1.0), (3, 2.0), (4, 3.0), (14, 1.0), (15, 2.0), (25.001, 9.0)])] + [("b", 0, 0.0, 1.0)]
    df = tracks.split_tracks(spark.createDataFrame(rows, "trk string, i int, t double, lat double"), "trk", "t", "lat", ["t", "i"], 10.0)
    got = {(r["trk"], r["i"]): r["ftrk"] for r in df.collect()}
    # a gap of exactly 10 s does not break a track
    assert [got["a", i] for i in range(8)] == [1, 1, 1, 0, 0, 0, 0, 0]
    assert got["b", 0] is None


def test_sigma_edit_keeps_unedited_when_all_go(spark):
    base = dict(sat="x", lon=1.0, lat=1.0, h1=0.0, tide1=0.0, tide2=0.0, g1=0.0, g2=1.0, ftrk1=1, ftrk2=0)
    rows = [base | {"h2": 5.0 + d} for d in (0.0, 0.1, -0.1, 0.05)]
    r = cells.cell_change(spark.createDataFrame(rows), ["sat"], 0.0, 0.0, 1.0, 1.0).collect()
    assert len(r) == 1 and r[0]["n_ad"] == 4 and abs(r[0]["dh_mean"] - 5.025) < 1e-9


def test_step_filter_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 0.1, 20), rng.normal(5, 0.1, 20)])
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "s int, t int, v double")
    got = [r["filtered"] for r in series.step_filter(df, "s", "t", "v", 3.0, 7).orderBy("t").collect()]
    padded = np.concatenate([[v[0]] * 3, v, [v[-1]] * 3])
    m = np.array([np.median(padded[i : i + 7]) for i in range(40)])
    jump = np.diff(m, prepend=m[0])
    assert np.allclose(got, v - np.cumsum(np.where(np.abs(jump) > 3, jump, 0)))


def many_tracks(spark, folder):
    """Events of 60 users, ten each: more than any id bound that a query could have."""
    rng = np.random.default_rng(11)
    rows = [(k, 1704067200 + 7919 * k, k // 10, ("click", "view")[k % 2], float(rng.uniform(0, 100))) for k in range(600) if k % 10 < 9 or k // 10 % 3]
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{folder}/events.parquet")
    return rows


def test_crossovers_of_all_tracks(spark, tmp_path):
    from tidemark import queries as core

    rows = many_tracks(spark, tmp_path)
    parts, at = {0: [], 1: []}, {}
    placed = []
    for k, _, u, _, v in rows:
        i = at[u] = at.get(u, -1) + 1
        placed.append((u, u // 2 + (i * 0.0513 if u % 2 == 0 else 3 - i * 0.0471) + v * 0.0037, i * 1.0371 + v * 0.0213))
    for a, b in zip(placed, placed[1:]):
        if a[0] == b[0]:
            parts[a[0] % 2].append((a[0], a[1], b[1], a[2], b[2]))
    want = {}
    for i, ax, bx, ay, by in parts[0]:
        for j, cx, dx, cy, dy in parts[1]:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det:
                s, t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if 0 <= s < 1 and 0 <= t < 1:
                    want[i, j] = want.get((i, j), 0) + 1
    got = {}
    for r in core.queries()["OP-JOIN-XOVER"](spark, str(tmp_path)).collect():
        got[r["track1"], r["track2"]] = got.get((r["track1"], r["track2"]), 0) + 1
    assert got == want and max(i for i, _ in want) > 50


def test_pairs_of_all_tracks(spark, tmp_path):
    from tidemark import queries as core

    tracks_ = {}
    for _, at, user, _, _ in many_tracks(spark, tmp_path):
        tracks_.setdefault(user, []).append(at // 86400)
    fact = {u: (min(days), len(days) % 2) for u, days in tracks_.items()}
    want = {(a % 4, a, b) for a in fact for b in fact if a < b and a % 4 == b % 4 and fact[a][0] != fact[b][0] and fact[a][1] != fact[b][1]}
    got = [tuple(r) for r in core.queries()["OP-JOIN-XPAIR"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and max(b for _, _, b in want) > 50


def places(spark, folder):
    """Customers of two nations, most with keys that a modulo filter from 3,000 on would drop."""
    rng = np.random.default_rng(4)
    rows = [(3001 + k, k % 2, float(rng.uniform(-1000, 9999))) for k in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    return {c: np.array([(b / 1000, k % 20, b / 2000 + k % 7 / 5) for k, n, b in rows if n == c]).T for c in (0, 1)}


def test_kriging_takes_all_places(spark, tmp_path):
    from tidemark import queries as core

    own = places(spark, tmp_path)
    got = {(r["cell"], r["gx"], r["gy"]): (r["v"], r["e"]) for r in core.queries()["OP-INT-KRIG"](spark, str(tmp_path)).collect()}
    assert len(got) == 50
    for c in (0, 1):
        gx, gy = np.array([k[1:] for k in got if k[0] == c]).T
        v, e = fits.kriging(*own[c], gx, gy, 3.0)
        assert np.allclose([got[c, x, y] for x, y in zip(gx, gy)], np.stack([v, e], 1), atol=2e-6)


def quadrants(x, y, at, gx, gy, most=16):
    """Positions of the nearest places of each quadrant, in the order of the places."""
    return sorted(i for east in (False, True) for north in (False, True) for i in sorted((i for i in range(len(x)) if (x[i] >= gx) == east and (y[i] >= gy) == north), key=lambda i: (round(at[i], 9), i))[:most])


def test_collocation_per_node(spark, tmp_path):
    from tidemark import queries as core

    own = places(spark, tmp_path)
    far = np.arange(0, 30, 0.5)
    few = cut = 0
    rows = core.queries()["OP-LSC-MAIN"](spark, str(tmp_path)).collect()
    assert len(rows) == 50
    for r in rows:
        x, y, v = own[r["cell"]]
        at = np.hypot(x - r["gx"], y - r["gy"])
        x, y, v, at = (a[at <= 4.0] for a in (x, y, v, at))
        few += len(v) < 30
        enough = len(v) >= 30
        keep = quadrants(x, y, at, r["gx"], r["gy"])
        cut += len(keep) < len(v)
        x, y, v, at = (a[keep] for a in (x, y, v, at))
        want = fits.collocation(np.hypot(x[:, None] - x, y[:, None] - y), at, v - v.mean(), np.full(len(v), 0.3), far, 4 * np.exp(-((far / 4) ** 2))) if enough else (0, 0)
        assert np.allclose((r["signal"], r["error"]), want, atol=2e-6)
    assert 0 < few < 50 and cut


def test_lasso_chooses_its_penalty_by_folds():
    rng = np.random.default_rng(8)
    x = np.arange(80.0)
    curve = 0.002 * (x - 30) ** 2
    y = curve + rng.normal(0, 0.3, 80)
    y[7] = np.nan
    fit = fits.lasso_by_folds(x, y)
    assert np.sqrt(np.mean((fit - curve) ** 2)) < 0.15
    # on noise alone the folds leave a flatter curve than the fit with the least penalty
    z = rng.normal(0, 1, 80)
    assert fits.lasso_by_folds(x, z).std() < np.polyval(np.polyfit(x, z, 3), x).std()
    # values in other units are the same fit: a fixed penalty is not
    assert np.allclose(fits.lasso_by_folds(x, 0.001 * y), 0.001 * fit, atol=1e-5)
    assert np.isnan(fits.lasso_by_folds(x[:2], y[:2])).all()


def test_lasso_query_uses_the_folds(spark):
    from tidemark import queries as core
    from tidemark.plans.views import series as monthly

    rows = sorted((r["cell"], r["t"], r["v"]) for r in monthly(spark, "/root/testdata/sf0.001").collect())
    got = {(r["cell"], r["t"]): r["y"] for r in core.queries()["OP-FIT-LASSOCV"](spark, "/root/testdata/sf0.001").collect()}
    cell = rows[0][0]
    t, v = np.array([r[1:] for r in rows if r[0] == cell], float).T
    assert np.allclose([got[cell, int(k)] for k in t], fits.lasso_by_folds(t, v), atol=2e-6)


def test_clenshaw_sums_legendre_series():
    from tidemark.operators import covariances as V

    c = np.random.default_rng(0).normal(size=40)
    x = np.linspace(-1, 1, 9)
    p = [np.ones_like(x), x]
    for n in range(1, 39):
        p.append(((2 * n + 1) * x * p[n] - n * p[n - 1]) / (n + 1))
    assert np.allclose(V.legendre_sum(c, x), sum(k * q for k, q in zip(c, p)))


def test_global_model_is_recovered(spark):
    from tidemark.operators import covariances as V

    for truth in ((0.8, 425.0, 4000.0), (3.0, 60.0, 12000.0)):
        cov = V.global_covariance(np.arange(25) * 0.15, truth, 60, 1000)
        table = spark.createDataFrame([(k, float(v), 100 + k) for k, v in enumerate(cov)] + [(25, 0.0, 0), (26, None, 5)], "class int, cov double, n long")
        assert np.allclose(V.fit_global_model(table, 0.15), truth, rtol=1e-3)
    try:
        V.fit_global_model(table.limit(0), 0.15)
        raise AssertionError
    except ValueError:
        pass


def test_systems_of_nodes_are_bounded(spark):
    """1,000 places around one node: the solution is that of the nearest of each quadrant, and no join of places with places is in the plan."""
    from tidemark.operators import covariances as V

    rng = np.random.default_rng(3)
    x, y = rng.uniform(-3, 3, (2, 1000))
    v = np.sin(x) + y
    rows = [(1, 0.1, 0.2, i, float(a), float(b), float(c), float(np.hypot(a - 0.1, b - 0.2))) for i, (a, b, c) in enumerate(zip(x, y, v))]
    near = V.nearest_by_quadrant(spark.createDataFrame(rows, "node long, nx double, ny double, id long, x double, y double, v double, distance double"), ["node"])
    table = [4 * np.exp(-((0.25 * k / 2) ** 2)) for k in range(60)]
    df = V.solve(near, table, 0.25, F.lit(1.0), F.lit(0.3), 4.0)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    keep = quadrants(x, y, np.hypot(x - 0.1, y - 0.2), 0.1, 0.2)
    x, y, v = x[keep], y[keep], v[keep]
    look = lambda d: np.interp(d, np.arange(60) * 0.25, table, right=0.0)
    c, s = look(np.hypot(x[:, None] - x, y[:, None] - y)) + 0.09 * np.eye(64), look(np.hypot(x - 0.1, y - 0.2))
    got = df.first()
    assert np.allclose((got["value"], got["error"]), (s @ np.linalg.solve(c, v), np.sqrt(max(4 - s @ np.linalg.solve(c, s), 0))), atol=1e-6)
