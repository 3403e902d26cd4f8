"""Linear interpolation of scattered points at nodes: each node's triangle of the Delaunay triangulation of all points, found without one task that holds them.

The triangle around a node q is the one whose circumcircle holds no point, which is the optimum of a linear program in three unknowns: the highest plane at q below the points lifted to
x**2 + y**2. Every node starts with a triangle of the convex hull's corners and exchanges corners (simplex steps) as points inside its circle turn up:

1. from a coarse set, one point for each of at most SAMPLE cells of the extent, which is broadcast;
2. from the points of the node's own tile, one task a tile;
3. from the other tiles that its circle reaches: circles and points are joined by tile, the deepest point of each tile is combined per circle before it moves on, and nodes with such
   points take part in the next round. A node is settled once a round finds nothing inside its circle, that is, after an empty-circle test against all points.

Tiles are squares of the extent; one that holds more than `most` points is divided further, so that no task holds more than about that many, whatever the density. Signs that float64
can't tell are computed with fractions. Points on a settled circle are all gathered, and the fan from the one that is first in order of (x, y) decides between the equally good
triangulations, so results don't depend on tiles or order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch

SAMPLE = 4096  # points of the coarse set
CORNERS = 1 << 16  # most corners of the convex hull, which is broadcast
LIST = "array<struct<x: double, y: double, v: double>>"


def hull(xy: np.ndarray) -> np.ndarray:
    """Positions of the corners of the convex hull, anticlockwise; fewer than three if all points are in one line. Signs are exact."""
    order = np.lexsort((xy[:, 1], xy[:, 0]))

    def half(positions) -> list[int]:
        out: list[int] = []
        for i in positions:
            while len(out) > 1 and turn(xy[out[-2]], xy[out[-1]], xy[i]) <= 0:
                out.pop()
            out.append(i)
        return out

    lower, upper = half(order), half(order[::-1])
    return np.array([*lower[:-1], *upper[:-1]] if len(xy) > 1 else lower, int)


def turn(a, b, c) -> int:
    """The sign of the area of (a, b, c): 1 anticlockwise, 0 in a line."""
    (ax, ay), (bx, by), (cx, cy) = ((float(p[0]), float(p[1])) for p in (a, b, c))
    one, two = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    if abs(one - two) > 1e-14 * (abs(one) + abs(two)):
        return 1 if one > two else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (ax, ay, bx, by, cx, cy))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def _shares(q, a, b, c) -> tuple | None:
    """Exact barycentric coordinates of q in (a, b, c); None if these are in a line."""
    (qx, qy), (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, map(float, p))) for p in (q, a, b, c))
    area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    if not area:
        return None
    one = ((qx - ax) * (cy - ay) - (qy - ay) * (cx - ax)) / area
    two = ((bx - ax) * (qy - ay) - (by - ay) * (qx - ax)) / area
    return 1 - one - two, one, two


def _depth(p, a, b, c) -> Fraction:
    """Exact: over 0 inside the circle through (a, b, c), 0 on it."""
    rows = []
    px, py = Fraction(float(p[0])), Fraction(float(p[1]))
    for r in (a, b, c):
        dx, dy = Fraction(float(r[0])) - px, Fraction(float(r[1])) - py
        rows.append((dx, dy, dx * dx + dy * dy))
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = rows
    d = a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)
    return d * turn(a, b, c)


def _leaves(q, xy: np.ndarray, tri: tuple, new: int) -> int:
    """Which corner of a triangle around q goes when a point comes in, so that the new triangle holds q too; exact."""
    share, of_new = _shares(q, *xy[list(tri)]), _shares(xy[new], *xy[list(tri)])
    return min((k for k in range(3) if of_new[k] > 0), key=lambda k: (share[k] / of_new[k], tri[k]))


def _settle_exactly(q, xy: np.ndarray, tri: tuple) -> tuple[tuple, list[int]]:
    """(corners, positions on their circle) of few points by exact steps from a triangle around q: the circle is empty among them and q in the triangle."""
    while True:
        depth = [_depth(p, *xy[list(tri)]) for p in xy]
        inside = [i for i, d in enumerate(depth) if d > 0]
        if not inside:
            return tri, [i for i, d in enumerate(depth) if d == 0]
        k = _leaves(q, xy, tri, inside[0])
        tri = tuple(inside[0] if j == k else t for j, t in enumerate(tri))


SLACK = 1e-11  # of the terms of a point's depth: float64 doesn't tell its sign within this


def enclose(q: np.ndarray, xy: np.ndarray, tri=(0, 1, 2), most: int = 1000) -> tuple[tuple, np.ndarray, tuple]:
    """(corners of q's triangle with an empty circle, positions of all points that may be on that circle, plane (a, b, c)) among xy; tri: a triangle around q.

    A point's depth in the circle is a * dx + b * dy + c - dx**2 - dy**2 with (dx, dy) from q.
    """
    u = xy - q
    s = (u * u).sum(1)
    tri = np.array(tri)

    def depths():
        a, b, c = np.linalg.solve(np.column_stack([u[tri], np.ones(3)]), s[tri])
        depth = u @ (a, b) + c - s
        depth[tri] = 0
        return (a, b, c), depth, SLACK * (np.abs(u[:, 0] * a) + np.abs(u[:, 1] * b) + abs(c) + s)

    for _ in range(most):
        plane, depth, slack = depths()
        i = int(np.argmax(depth - slack))
        if depth[i] <= slack[i]:
            break
        both = np.linalg.solve(np.column_stack([u[tri], np.ones(3)]).T, np.array([[0.0, 0.0, 1.0], [u[i, 0], u[i, 1], 1.0]]).T)
        share, of_new = both[:, 0], both[:, 1]
        ratio = np.where(of_new > 0, share / np.where(of_new > 0, of_new, 1), np.inf)
        first, second = np.sort(ratio)[:2]
        clear = share.min() > 1e-9 and np.abs(of_new).min() > 1e-9 and second - first > 1e-9 * second
        k = int(np.argmin(ratio)) if clear else _leaves(q, xy, tuple(tri), i)
        tri[k] = i
    near = np.union1d(np.flatnonzero(depth >= -2 * slack), tri)
    if len(near) > 3:
        found, _ = _settle_exactly(q, xy[near], tuple(np.searchsorted(near, tri)))
        tri = near[list(found)]
        plane, depth, slack = depths()
        near = np.union1d(np.flatnonzero(depth >= -2 * slack), tri)
    return tuple(tri), near, plane


def interpolate(q, points: np.ndarray) -> float:
    """The value at q from points (x, y, v), the first three a triangle around q: linear in q's triangle of the fan, from the point that is first in order of (x, y), of those on the empty circle."""
    _, on = _settle_exactly(q, points[:, :2], (0, 1, 2)) if len(points) > 3 else (None, [0, 1, 2])
    p = points[on]
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    first, rest = p[0], []
    # anticlockwise around the first: all others are within half a turn
    for r in p[1:]:
        k = len(rest)
        while k and turn(first, rest[k - 1], r) < 0:
            k -= 1
        rest.insert(k, r)
    for a, b in zip(rest, rest[1:]):
        share = _shares(q, first[:2], a[:2], b[:2])
        if share and min(share) >= 0:
            return float(sum(float(w) * r[2] for w, r in zip(share, (first, a, b))))
    raise ArithmeticError("no triangle of the fan holds the node")


def _saved(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _corners(points: DataFrame) -> np.ndarray:
    """The hull's corners (x, y, v): of each task's points, of the results in few tasks, then of what these leave."""

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            held = held.iloc[hull(held[["x", "y"]].to_numpy())]
        if held is not None:
            yield held

    schema = "x double, y double, v double"
    left = points.select("x", "y", "v").mapInPandas(some, schema)
    parts = left.repartition(8).mapInPandas(some, schema).limit(CORNERS + 1).toPandas()
    if len(parts) > CORNERS:
        raise ValueError(f"the convex hull has over {CORNERS} corners")
    return parts.iloc[hull(parts[["x", "y"]].to_numpy())].to_numpy(float) if len(parts) else np.zeros((0, 3))


def grid_linear(points: DataFrame, nodes: DataFrame, most: int = 512, sides: int | None = None) -> DataFrame:
    """nodes (node, x, y) with v: the points' (x, y, v) value by linear interpolation in the Delaunay triangulation; null outside the convex hull.

    Points that share a place count as one with the mean of their values; points and nodes with a null or non-finite coordinate or value are left out (such nodes stay with a null v). Under three places,
    or all in one line, every v is null. node tells nodes apart. sides: tiles across the extent (default: about most / 2 points a tile on average).
    """
    sound = lambda *c: " AND ".join(f"{x} IS NOT NULL AND abs({x}) < double('infinity')" for x in c)
    places = points.select(*[F.col(c).cast("double").alias(c) for c in "xyv"]).where(sound("x", "y", "v")).select((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "v")
    places = _saved(places.groupBy("x", "y").agg(F.avg("v").alias("v")))
    corner = _corners(places)
    if len(corner) < 3:
        return nodes.select("node", "x", "y", F.lit(None).cast("double").alias("v"))
    low, high = corner[:, :2].min(0), corner[:, :2].max(0)
    n = places.count()
    sides = sides or max(1, int((2 * n / most) ** 0.5))
    step = (high - low) / sides
    tile = lambda c, k: F.least(F.lit(sides - 1), F.greatest(F.lit(0), F.floor((F.col(c) - float(low[k])) / float(step[k]))))

    def part(c, k, i, parts):
        inside = (F.col(c) - float(low[k])) / float(step[k]) - F.col(i)
        return F.least(F.col(parts) - 1, F.greatest(F.lit(0), F.floor(inside * F.col(parts))))

    tiled = places.withColumn("ix", tile("x", 0)).withColumn("iy", tile("y", 1))
    # how often a tile is divided in each direction
    tiles = _saved(tiled.groupBy("ix", "iy").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / most)).alias("parts")))
    divide = lambda df: df.withColumn("jx", part("x", 0, "ix", "parts")).withColumn("jy", part("y", 1, "iy", "parts")).drop("parts")
    tiled = _saved(divide(tiled.join(tiles, ["ix", "iy"])))
    cell = max(1, int(SAMPLE**0.5))
    coarse = places.groupBy(*[F.least(F.lit(cell - 1), F.floor((F.col(c) - float(low[k])) / float((high - low)[k]) * cell)) for k, c in enumerate("xy")]).agg(F.min_by(F.struct("x", "y", "v"), F.xxhash64("x", "y")).alias("p"))
    sample = coarse.select("p.x", "p.y", "p.v").toPandas().to_numpy(float)
    known = np.concatenate([corner, sample])
    known = known[np.sort(np.unique(known[:, :2], axis=0, return_index=True)[1])]  # the corners stay first
    shared = nodes.sparkSession.sparkContext.broadcast((corner, known))

    state = f"node long, x double, y double, ring {LIST}, a double, b double, c double"

    def row(node, q, have, tri=(0, 1, 2)):
        tri, near, plane = enclose(q, have[:, :2], tri)
        ring = have[[*tri, *np.setdiff1d(near, tri)]]
        return node, q[0], q[1], [dict(zip("xyv", p)) for p in ring.tolist()], *plane

    def frame(rows):
        return pd.DataFrame(rows, columns=["node", "x", "y", "ring", "a", "b", "c"])

    def distinct(ring, more):
        """ring, then what of more isn't in it."""
        return np.concatenate([ring, more[~(more[:, None, :2] == ring[None, :, :2]).all(2).any(1)]])

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corner, known = shared.value
        for f in frames:
            out = []
            for node, x, y in f[["node", "x", "y"]].itertuples(index=False):
                q = np.array([x, y])
                # the fan from the first corner: q is in the last triangle whose near side it isn't right of
                for k in range(1, len(corner) - 1):
                    share = _shares(q, *corner[[0, k, k + 1], :2]) if turn(corner[0], corner[k + 1], q) <= 0 else None
                    if share and min(share) >= 0:
                        out.append(row(node, q, known, (0, k, k + 1)))
                        break
            yield frame(out)

    def own(f: pd.DataFrame) -> pd.DataFrame:
        p = f[f["node"].isna()][["x", "y", "v"]].to_numpy(float)
        rows = f[f["node"].notna()]
        return frame([row(int(n), np.array([x, y]), distinct(_array(ring), p)) for n, x, y, ring in rows[["node", "x", "y", "ring"]].itertuples(index=False)])

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield frame([row(n, np.array([x, y]), distinct(_array(ring), _array(more))) for n, x, y, ring, more in f[["node", "x", "y", "ring", "more"]].itertuples(index=False)])

    good = nodes.select(F.col("node").cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(sound("x", "y"))
    found = good.mapInPandas(begin, state).withColumn("ix", tile("x", 0)).withColumn("iy", tile("y", 1)).join(tiles, ["ix", "iy"], "left").fillna(1, ["parts"])
    found = divide(found)
    keys = ["ix", "iy", "jx", "jy"]
    both = found.select(*keys, "node", "x", "y", F.lit(None).cast("double").alias("v"), "ring").unionByName(
        tiled.select(*keys, F.lit(None).cast("long").alias("node"), "x", "y", "v", F.lit(None).cast(LIST).alias("ring"))
    )
    open_ = _saved(both.groupBy(*keys).applyInPandas(own, state))
    done = []
    centre, radius = {"x": F.col("x") + F.col("a") / 2, "y": F.col("y") + F.col("b") / 2}, F.sqrt(F.greatest(F.lit(0.0), F.col("c") + (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / 4))

    def span(c, k, sign):
        at = (F.col("c" + c) + sign * F.col("r") * (1 + 1e-9) - float(low[k])) / float(step[k])
        return F.least(F.lit(float(sides - 1)), F.greatest(F.lit(0.0), F.floor(at).cast("double"))).cast("long")

    def inner(c, k, i, sign):
        at = ((F.col("c" + c) + sign * F.col("r") * (1 + 1e-9) - float(low[k])) / float(step[k]) - F.col(i)) * F.col("parts")
        return F.least((F.col("parts") - 1).cast("double"), F.greatest(F.lit(0.0), F.floor(at).cast("double"))).cast("long")

    while True:
        circles = open_.select("node", F.col("x").alias("qx"), F.col("y").alias("qy"), "a", "b", "c", "ring", centre["x"].alias("cx"), centre["y"].alias("cy"), radius.alias("r"))
        reach = circles.withColumn("ix", F.explode(F.sequence(span("x", 0, -1), span("x", 0, 1)))).withColumn("iy", F.explode(F.sequence(span("y", 1, -1), span("y", 1, 1)))).join(tiles, ["ix", "iy"])
        reach = reach.withColumn("jx", F.explode(F.sequence(inner("x", 0, "ix", -1), inner("x", 0, "ix", 1)))).withColumn("jy", F.explode(F.sequence(inner("y", 1, "iy", -1), inner("y", 1, "iy", 1))))
        # inside the circle, or so near to it that only fractions can tell
        dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
        square = dx * dx + dy * dy
        depth = F.col("a") * dx + F.col("b") * dy + F.col("c") - square
        slack = SLACK * (F.abs(F.col("a") * dx) + F.abs(F.col("b") * dy) + F.abs("c") + square)
        hit = reach.join(tiled, keys).where(depth >= -slack).where(~F.exists("ring", lambda p: (p.x == F.col("x")) & (p.y == F.col("y"))))
        deepest = hit.groupBy("node", *keys).agg(F.max_by(F.struct("x", "y", "v"), depth).alias("p")).groupBy("node").agg(F.collect_list("p").alias("more"))
        new = _saved(deepest)
        if new.limit(1).count() == 0:
            break
        step_ = open_.join(new, "node", "left")
        kept = step_.where("more IS NULL").drop("more")
        done.append(kept)
        open_ = _saved(step_.where("more IS NOT NULL").mapInPandas(again, state))
    done.append(open_)

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "v": [interpolate((x, y), _array(ring)) for x, y, ring in f[["x", "y", "ring"]].itertuples(index=False)]})

    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    return nodes.select("node", "x", "y").join(settled.mapInPandas(values, "node long, v double"), "node", "left")


def _array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["v"]) for p in ring], float).reshape(-1, 3)
