"""Queries without SQL against independent loops, and edges of the operators of selections, records and storage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries as core
from tidemark.functions import geo as G
from tidemark.operators import cells, composites, covariances, selection, spatial
from tidemark.plans.views import series
from tidemark.sources import records, storage

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def curves(spark):
    """Per cell the epochs and values of the monthly series."""
    out = {}
    for r in sorted(tuple(r) for r in series(spark, DIR).select("cell", "t", "v").collect()):
        out.setdefault(r[0], ([], []))[0].append(r[1])
        out[r[0]][1].append(r[2])
    return {c: (np.array(t, float), np.array(v)) for c, (t, v) in out.items()}


def rows(spark, name, key, *values):
    return {(r["cell"], r[key]) if key else r["cell"]: tuple(r[v] for v in values) for r in core.queries()[name](spark, DIR).collect()}


def test_polynomial_fits(spark, curves):
    cubic = rows(spark, "OP-FIT-POLY", None, "c3", "c2", "c1", "c0")
    chosen = rows(spark, "OP-FIT-LSTSQCV", None, "degree", "start")
    for c, (t, v) in curves.items():
        a = np.vander(t / 50, 4)
        want = np.linalg.solve(a.T @ a, a.T @ v) / 50.0 ** np.arange(3, -1, -1)
        assert np.allclose(cubic[c], want, atol=2e-6)
        errors = []
        for degree in (1, 2, 3):
            e = []
            for k in range(5):
                out = np.arange(len(t)) % 5 == k
                b = np.vander(t / 50, degree + 1)
                coef = np.linalg.lstsq(b[~out], v[~out], rcond=None)[0]
                e.append(np.mean((b[out] @ coef - v[out]) ** 2))
            errors.append(np.mean(e))
        best = int(np.argmin(errors)) + 1
        b = np.vander(t / 50, best + 1)
        assert chosen[c][0] == best and abs(chosen[c][1] - np.linalg.lstsq(b, v, rcond=None)[0][-1]) < 1e-5


def test_huber_line_is_the_minimum(spark, curves):
    """At the fit, the weighted residuals of Huber's function are orthogonal to the line, with the scale of its own residuals."""
    for c, (slope, start) in rows(spark, "OP-FIT-RLM", None, "slope", "start").items():
        t, v = curves[c]
        r = v - slope * t - start
        scale = np.median(np.abs(r)) / 0.6744897501960817
        psi = np.clip(r / scale, -1.345, 1.345)
        assert abs(psi.sum()) < 1e-2 and abs(psi @ (t - t.mean())) < 1


def test_trend_filter_and_spline(spark, curves):
    hp, spline = rows(spark, "OP-FIT-HP", "t", "y"), rows(spark, "OP-FIT-SPLINE", "t", "y")
    for c, (t, v) in curves.items():
        n = len(v)
        y = np.array([hp[c, int(k)][0] for k in t])
        second = y[2:] - 2 * y[1:-1] + y[:-2]
        back = np.zeros(n)
        for i, x in enumerate(second):
            back[i : i + 3] += x * np.array([1, -2, 1])
        assert np.allclose(y + 7 * back, v, atol=1e-4)
        # a natural cubic through y: its second derivatives m solve the tridiagonal system, and penalty * (jumps of its third derivative) is the residual
        y = np.array([spline[c, int(k)][0] for k in t])
        h = np.diff(t)
        a = np.zeros((n - 2, n - 2))
        for j in range(n - 2):
            a[j, j] = (h[j] + h[j + 1]) / 3
            if j:
                a[j, j - 1] = a[j - 1, j] = h[j] / 6
        m = np.concatenate([[0], np.linalg.solve(a, np.diff(np.diff(y) / h)), [0]])
        third = np.concatenate([[0], np.diff(m) / h, [0]])
        assert np.allclose(v - y, 10 * np.diff(third), atol=1e-4)


def test_windows_of_series(spark, curves):
    smooth, low, peaks = rows(spark, "OP-WIN-SMOOTH", "t", "y"), rows(spark, "OP-WIN-FIR", "t", "y"), core.queries()["OP-WIN-PEAKDET"](spark, DIR).collect()
    w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / 10) for k in range(11)])
    taps = np.array([0.2 * (1 if k == 10 else math.sin(math.pi * 0.2 * (k - 10)) / (math.pi * 0.2 * (k - 10))) for k in range(21)]) * np.kaiser(21, 5.0)
    taps /= taps.sum()
    for c, (t, v) in curves.items():
        n = len(v)
        at = lambda i: v[-i] if i < 0 else v[2 * n - 2 - i] if i >= n else v[i]  # noqa: B023, E731
        want = [sum(w[k] * at(i + k - 5) for k in range(11)) / w.sum() for i in range(n)]
        assert np.allclose([smooth[c, int(k)][0] for k in t], want, atol=2e-6)
        pad = min(21, n - 1)
        x = [2 * v[0] - v[k] for k in range(pad, 0, -1)] + list(v) + [2 * v[-1] - v[n - 1 - k] for k in range(1, pad + 1)]
        for _ in range(2):
            x = [sum(taps[k] * x[i + 10 - k] for k in range(21) if 0 <= i + 10 - k < len(x)) for i in range(len(x))][::-1]
        assert np.allclose([low[c, int(k)][0] for k in t], x[pad : pad + n], atol=2e-6)
        found, most, least, up = [], 0, 0, True
        for i in range(n):
            if v[i] > v[most]:
                most = i
            if v[i] < v[least]:
                least = i
            if up and v[i] < v[most] - 1.0:
                found.append((int(t[most]), 1))
                least, up = i, False
            elif not up and v[i] > v[least] + 1.0:
                found.append((int(t[least]), -1))
                most, up = i, True
        assert sorted((r["t"], r["kind"]) for r in peaks if r["cell"] == c) == sorted(found)


def brute_trim(t, v, k):
    v = v.copy()
    for _ in range(10):
        ok = ~np.isnan(v)
        if ok.sum() < 3:
            break
        x, y = t[ok], v[ok]
        errors = []
        for degree in (1, 2, 3):
            e = []
            for f in range(5):
                out = np.arange(len(x)) % 5 == f
                if out.any() and (~out).sum() > degree:
                    e.append(np.mean((np.polyval(np.polyfit(x[~out], y[~out], degree), x[out]) - y[out]) ** 2))
            errors.append(np.mean(e) if e else np.inf)
        r = v - np.polyval(np.polyfit(x, y, int(np.argmin(errors)) + 1), t)
        sd = np.sqrt(np.nansum((r - np.nanmean(r)) ** 2) / (ok.sum() - 1))
        gone = np.abs(r) > k * sd
        if not gone.any():
            break
        v[gone] = np.nan
    return v


def test_peaks_and_wavelets(spark, curves):
    kept, power = rows(spark, "OP-POST-PEAK", "t", "y"), core.queries()["OP-SPEC-CWT"](spark, DIR).collect()
    power = {(r["cell"], r["scale"]): r["power"] for r in power if r["wavelet"] == "morlet" and r["spacing"] == "log"}
    for c, (t, v) in curves.items():
        assert np.allclose([kept[c, int(k)][0] for k in t], np.nan_to_num(brute_trim(t, v, 2.0), nan=-1.0), atol=2e-6)
    for c, (t, v) in list(curves.items())[:3]:
        n = len(v)
        x = v - v.mean()
        spectrum = [sum(x[j] * np.exp(-2j * np.pi * k * j / n) for j in range(n)) for k in range(n)]
        for s in (2.0, 4.0, 8.0, 16.0):
            f = [2 * np.pi * (k if k < (n + 1) // 2 else k - n) / n for k in range(n)]
            product = [spectrum[k] * np.pi**-0.25 * np.sqrt(2 * np.pi * s) * np.exp(-0.5 * (s * f[k] - 6) ** 2) * (f[k] > 0) for k in range(n)]
            w = [sum(product[k] * np.exp(2j * np.pi * k * j / n) for k in range(n)) / n for j in range(n)]
            assert abs(power[c, s] - np.mean(np.abs(w) ** 2)) < 1e-5 * max(1, power[c, s])


def test_trends_of_all_kinds(spark, curves):
    got = {}
    for r in core.queries()["OP-FIT-TRENDALL"](spark, DIR).collect():
        got.setdefault(r["cell"], []).append(r)
    for c, (t, v) in curves.items():
        own = sorted(got[c], key=lambda r: r["t"])
        y = v - v.mean()
        slope = ((t - t.mean()) @ y) / ((t - t.mean()) @ (t - t.mean()))
        assert np.allclose([r["v"] for r in own], y, atol=2e-6) and np.allclose([r["line"] for r in own], slope * (t - t.mean()), atol=2e-6)
        assert all(abs(r["line_rate"] - slope) < 2e-6 for r in own)
        lasso = np.array([r["lasso"] for r in own])
        want = [(lasso[min(i + 1, len(t) - 1)] - lasso[max(i - 1, 0)]) / (0.25 * (min(i + 1, len(t) - 1) - max(i - 1, 0))) for i in range(len(t))]
        assert np.allclose([r["derivative"] for r in own], want, atol=1e-5)
        assert all(abs(r["lasso_rate"] - (lasso[-1] - lasso[0]) / (t[-1] - t[0])) < 2e-6 for r in own)


def test_post_processing(spark, curves):
    got = rows(spark, "OP-POST", "t", "v", "e")
    seen = 0
    for c, (t, v) in curves.items():
        use = (t > 2) & (t < 70)
        t, e, v = t[use], v[use] / 50, v[use].copy()
        n = len(t)
        if c in (3, 17):
            v[:] = np.nan
        else:
            m = [np.median([v[min(max(i + k, 0), n - 1)] for k in range(-2, 3)]) for i in range(n)]
            jump = np.diff(m, prepend=m[0])
            v = brute_trim(t, v - np.cumsum(np.where(np.abs(jump) > 2, jump, 0)), 2.0)
            v[:] = v - np.nanmean(v) if (~np.isnan(v)).mean() >= 0.7 else np.nan
        for k, x, y in zip(t, v, e):
            a, b = got[c, int(k)]
            assert (a is None) == np.isnan(x) == (b is None)
            seen += a is not None
            assert a is None or abs(a - x) < 2e-6 and abs(b - y) < 2e-6
    assert seen


def test_solutions_of_nodes(spark):
    """Each node's value from a dense inverse."""
    from tidemark.plans.composites import _TABLE, _near

    near = {}
    for r in _near(spark, DIR).collect():
        near.setdefault(r["node"], []).append(r)
    look = lambda d: np.interp(d, np.arange(12) * 0.5, _TABLE, right=0.0)
    got = {r["node"]: (r["value"], r["error"]) for r in core.queries()["OP-LSC-SOLVE"](spark, DIR).collect()}
    assert got.keys() == near.keys() and got
    for node, own in near.items():
        x, y, v, far = (np.array([r[k] for r in own]) for k in ("x", "y", "v", "distance"))
        c = look(np.hypot(x[:, None] - x, y[:, None] - y)) + 0.09 * np.eye(len(x))
        s = look(far)
        assert np.allclose(got[node], (s @ np.linalg.inv(c) @ v, np.sqrt(max(_TABLE[0] - s @ np.linalg.inv(c) @ s, 0))), atol=1e-5)


def test_equal_points_stay_apart(spark):
    grid = spark.createDataFrame([(0, 0, 2.0)], "ix int, iy int, v double")
    p = spark.createDataFrame([(0.7, 0.0), (0.7, 0.0), (0.2, 0.1), (-5.0, 1.0)], "x double, y double")
    assert [r["value"] for r in spatial.bilinear(p, grid, "x", "y").orderBy("x").collect()] == [None, 2.0, None, None]


def test_pairs_come_once(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.uniform(-10, 10, (120, 2)))]
    got = [tuple(sorted((r["a_id"], r["b_id"]))) for r in spatial.pairs_within(spark.createDataFrame(pts, "id long, x double, y double, v double"), 3.0).collect()]
    want = {(a, b) for a, x, y, _ in pts for b, u, w, _ in pts if a <= b and math.hypot(x - u, y - w) <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_sigma_cuts_of_emptied_groups(spark):
    """Values far from zero with a small deviation all go; the group's cut stays, and null keys are a group."""
    df = spark.createDataFrame([(None, 5.0), (None, 5.1), (None, 4.9), (1, 0.1), (1, 9.0), (2, 3.0), (2, -3.0)], "k int, x double")
    for e in (cells.edit_sigma(df, ["k"], "x", 1.5), cells.edit_sigma_repeated(df, ["k"], "x", 1.5), cells.edit_sigma_repeated(df, ["k"], "x", 1.5, small=0)):
        assert sorted((str(r["k"]), r["x"], r["ok"]) for r in e.collect()) == sorted([("None", 5.0, False), ("None", 5.1, False), ("None", 4.9, False), ("1", 0.1, True), ("1", 9.0, True), ("2", 3.0, True), ("2", -3.0, True)])


def test_sigma_edit_goes_on_to_the_end(spark):
    """Uniform values lose a part in every pass: over a dozen passes, in a task and by sums alone, equal to the loop."""
    rng = np.random.default_rng(6)
    groups = {None: rng.uniform(-1, 1, 400), 1: rng.uniform(-5, 5, 90), 2: rng.normal(0, 0.1, 50), 3: np.array([1.0, 2.0]), 4: np.repeat(7.0, 30)}
    rows = [(k, float(x), "clash") for k, v in groups.items() for x in v] + [(1, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, cut string").repartition(3)
    want, most = set(), 0
    for k, v in groups.items():
        passes = 0
        while len(v) >= 3:
            kept = v[np.abs(v) <= 1.5 * v.std(ddof=1)]
            passes += 1
            if len(kept) == len(v):
                break
            v = kept
        most = max(most, passes)
        want |= {(k, float(x)) for x in v}
    assert most > 12
    for small in (1 << 16, 120):
        got = {(r["k"], r["x"]) for r in cells.edit_sigma_repeated(df.drop("cut"), ["k"], "x", 1.5, small=small).where("ok").collect()}
        assert got == want


def test_sigma_edit_keeps_what_every_pass_keeps(spark):
    """The second pass's cut (7.6) takes the tens, the third one's (12.1) would let them in again: in a task, by sums, and by sums first."""
    df = spark.createDataFrame([(1, x) for x in [-7.0, 7.0, 7.0, 1000.0, *[10.0] * 8]] + [(2, 1.0)], "k int, x double")
    for small in (1 << 16, 11, 0):
        got = sorted((r["k"], r["x"]) for r in cells.edit_sigma_repeated(df, ["k"], "x", 1.5, small=small).where("ok").collect())
        assert got == [(1, -7.0), (1, 7.0), (1, 7.0), (2, 1.0)]


def test_bounds_and_open_boxes(spark):
    selection.check_bounds(0, 10, -80, -70)
    with pytest.raises(ValueError):
        selection.check_bounds(10, 0, -80, -70)
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5), (0.5, 0.5), (2.0, 0.5)], "x double, y double")
    box = (0.0, 1.0, 0.0, 1.0)
    assert selection.open_box(df, "x", "y", box).count() == 1 and selection.open_box(df, "x", "y", box, False).count() == 1


def test_records_pack_and_unpack(spark):
    """Negative numbers and 16-bit words come back; bytes after the last whole record don't matter."""
    v = {"retstat": F.lit(0x2123), "dsec": F.lit(-5), "lat": F.lit(-71_500_000), "lon": F.lit(1), "surf": F.lit(-9999), "surf_raw": F.lit(-9999), "otide": F.lit(-32768)}
    x = spark.range(1).select(F.unhex(F.concat(records.pack(112, "ID", records.RA2.data, v), F.lit("00FF"))).alias("content"), F.lit("a").alias("path"))
    r = records.decode_records(x, records.RA2).first()
    assert (r["tag"], r["retstat"], r["dsec"], r["lat"], r["surf"], r["surf_raw"], r["otide"], r["orbit"]) == ("ID", 0x2123, -5e-6, -71.5, -99.99, -9999, -32.768, None)
    with pytest.raises(ValueError):
        composites.backscatter(x, "other", "c", "t", "h", "g")


def test_flat_tables_and_rasters(spark):
    df = spark.createDataFrame([(1, i, float(i) / 3) for i in range(12)], "k int, i int, v double")
    for dtype in ("<f8", ">f8"):
        got = storage.read_flat(storage.write_flat(df, "k", ["i"], ["i", "v"], dtype), ["i", "v"], dtype).orderBy("rowno").collect()
        assert [(r["rowno"], r["i"], r["v"]) for r in got] == [(i, float(i), i / 3) for i in range(12)]
    r = storage.read_raster(storage.write_flat(df, "k", ["i"], ["v"], "<f4"), 4, 2).collect()
    assert sorted((x["ix"], x["iy"], round(x["v"], 4)) for x in r) == [(0, 0, round(8 / 3, 4)), (0, 1, 0.0), (1, 0, round(10 / 3, 4)), (1, 1, round(2 / 3, 4))]


def test_circular_and_look_up(spark):
    r = spark.range(1).select(
        G.circular(F.array(*map(F.lit, (1, 2, 3))), F.lit(-4)).alias("a"), G.horner(F.lit(2.0), [1.0, 0.0, -1.0]).alias("b"), *[covariances.look_up(F.lit(x), [4.0, 2.0, 1.0], 0.5).alias(f"c{i}") for i, x in enumerate((0.0, 0.25, 1.0, 1.01))]
    ).first()
    assert tuple(r) == (3, 3.0, 4.0, 3.0, 1.0, 0.0)
