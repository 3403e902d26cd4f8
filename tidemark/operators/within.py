"""What lies within a distance of nodes, without a row per pair: sums, sums of distances and the nearest places.

Nodes of a tile meet the places of the nine tiles around them in one group; tiles with many are dealt over several groups. In a group the places are cut into slabs of equal or like y and sorted by x there, so that the places
surely within reach of a node are one range of each slab, whose sums are differences of running sums. Only places near the border are looked at one by one, with the very test of the definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES, NODES = 1 << 19, 1 << 17  # in one group
SLABS = 256  # at most, of places without so few different y
PAIRS = 1 << 20  # looked at together


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return {name: kinds[kind] for name, kind in (f.split() for f in schema.split(", "))}


def _finite(x: str, y: str) -> Column:
    return (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))


def by_tiles(nodes: DataFrame, places: DataFrame, reach: float, kernel: Callable[[dict, dict], dict], schema: str, most: tuple[int, int] = (NODES, PLACES), pieces: bool = False) -> DataFrame:
    """kernel(nodes, places) on groups of nodes (node, nx, ny, ...) and of places (x, y, ...) of the tiles around them, as arrays by column; it returns arrays by column of the schema.

    Every node meets each place within `reach` once. A tile with more nodes or places around it than `most` is several groups, and a node's results are as many parts. Nodes without places around them have none. With pieces the kernel
    yields such arrays one after the other, and no more than one is held.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = lambda df: df.withColumn("_o", F.explode(around)).withColumns({"_tx": F.col("_tx") + F.col("_o.i"), "_ty": F.col("_ty") + F.col("_o.j")}).drop("_o")
    a = nodes.where(_finite("nx", "ny")).withColumns({"_tx": tile("nx"), "_ty": tile("ny")})
    b = places.select(*[F.col(c).alias(c) for c in places.columns]).where(_finite("x", "y")).withColumns({"_tx": tile("x"), "_ty": tile("y")})
    parts = lambda n, k: F.ceil(F.col(n) / k).cast("int")
    sizes = a.groupBy("_tx", "_ty").agg(F.count(F.lit(1)).alias("_a")).join(spread(b.groupBy("_tx", "_ty").agg(F.count(F.lit(1)).alias("_b"))).groupBy("_tx", "_ty").agg(F.sum("_b").alias("_b")), ["_tx", "_ty"])
    sizes = sizes.select("_tx", "_ty", parts("_a", most[0]).alias("_na"), parts("_b", most[1]).alias("_nb"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(sizes, ["_tx", "_ty"]).withColumn("_p", F.pmod(F.xxhash64("node", "nx", "ny"), "_na").cast("int")).withColumn("_q", each("_nb")).drop("_na", "_nb")
    b = spread(b).join(sizes, ["_tx", "_ty"]).withColumn("_q", F.pmod(F.xxhash64("x", "y"), "_nb").cast("int")).withColumn("_p", each("_na")).drop("_na", "_nb")
    keys = ["_tx", "_ty", "_p", "_q"]
    types = arrow_types(schema)

    def arrays(t: pa.Table) -> dict:
        return {c: t[c].to_numpy() for c in t.column_names if c not in keys}

    if pieces:
        own, other = [c for c in a.columns if c not in keys], [c for c in b.columns if c not in keys]

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches))
            left, right = t.filter(pc.equal(t["_s"], 0)).select(own), t.filter(pc.equal(t["_s"], 1)).select(other)
            for out in kernel(arrays(left), arrays(right)):
                yield pa.record_batch({c: pa.array(out[c], kind) for c, kind in types.items()})

        both = a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1)), allowMissingColumns=True)
        return both.groupBy(*keys).applyInArrow(stream, schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = kernel(arrays(left), arrays(right))
        return pa.table({c: pa.array(out[c], t) for c, t in types.items()})

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


class Slab:
    """Places of like y, sorted by x: their rows, coordinates and running sums of columns."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray, columns: list[np.ndarray]):
        self.rows = rows[np.argsort(x[rows], kind="stable")]
        self.x, self.y = x[self.rows], y[self.rows]
        self.low, self.high = self.y.min(), self.y.max()
        self.columns = [c[self.rows] for c in columns]
        self.sums = [np.concatenate([np.zeros(1, c.dtype), np.cumsum(c)]) for c in self.columns]


def slabs(x: np.ndarray, y: np.ndarray, columns: list[np.ndarray] = ()) -> list[Slab]:
    """One slab for each y where these are few, else slabs of equal numbers of places."""
    if not len(x):
        return []
    order = np.argsort(y, kind="stable")
    starts = np.flatnonzero(np.diff(y[order], prepend=np.nan) != 0)
    cut = starts[1:] if len(starts) <= SLABS else np.linspace(0, len(x), min(SLABS, len(x) // 16 + 1) + 1).astype(int)[1:-1]
    return [Slab(rows, x, y, columns) for rows in np.split(order, cut)]


def margin(reach: float, *coordinates: np.ndarray) -> float:
    """A width that no rounding of coordinates and distances crosses."""
    return 1e-9 * reach + 1e-14 * max((float(np.abs(c).max()) for c in coordinates if len(c)), default=0.0)


def circle(reach: float, eps: float) -> Callable:
    """Half widths at y distances `near` to `far` from the centre: of what surely is in (negative: nothing) and of what may be."""

    def widths(near, far):
        return np.where(far < reach - eps, np.sqrt(np.maximum((reach - eps) ** 2 - far**2, 0.0)), -1.0), np.sqrt(np.maximum((reach + eps) ** 2 - near**2, 0.0))

    return widths


def square(half: float, eps: float) -> Callable:
    def widths(near, far):
        return np.where(far < half - eps, half - eps, -1.0), np.full(len(near), half + eps)

    return widths


def ranges(nx: np.ndarray, ny: np.ndarray, slab: Slab, reach: float, eps: float, widths: Callable) -> tuple[np.ndarray, ...]:
    """Of the nodes that the slab may reach: their rows and four places in the slab, a <= b <= c <= d: all of b .. c are within reach, of a .. b and c .. d some are, others aren't."""
    near, far = np.maximum(np.maximum(slab.low - ny, ny - slab.high), 0.0), np.maximum(slab.high - ny, ny - slab.low)
    at = np.flatnonzero(near <= reach + eps)
    x = nx[at]
    sure, may = widths(near[at], far[at])
    a, d = np.searchsorted(slab.x, x - may, "left"), np.searchsorted(slab.x, x + may, "right")
    # few nodes have places at their border where the slab's places have one y: the others need no second search
    b, c, last, none = a.copy(), d.copy(), len(slab.x) - 1, sure < 0
    left = np.flatnonzero((slab.x[np.minimum(a, last)] < x - sure) & (a < d))
    b[left] = np.searchsorted(slab.x, x[left] - sure[left], "left")
    right = np.flatnonzero((slab.x[np.maximum(d - 1, 0)] > x + sure) & (a < d))
    c[right] = np.searchsorted(slab.x, x[right] + sure[right], "right")
    return at, a, np.where(none, a, b), np.where(none, a, np.maximum(b, c)), d


def pairs(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, j) for every j in first[k] .. end[k], in pieces of about PAIRS, in the order of k; a longer range is a piece, or several, of its own."""
    n = end - first
    use = np.flatnonzero(n > 0)
    total = np.cumsum(n[use])
    start = 0
    while start < len(use):
        stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")), start + 1)
        k = use[start:stop]
        size = n[k]
        at = np.repeat(first[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        yield np.repeat(k, size), at
        start = stop


def sums_within(nx: np.ndarray, ny: np.ndarray, cut: list[Slab], reach: float, eps: float, widths: Callable, inside: Callable) -> list[np.ndarray]:
    """Sums of the slabs' columns over the places within reach of each node; inside(dx, dy) decides at the border. Nodes in the order of x are searched fastest."""
    out = [np.zeros(len(nx), c.dtype) for c in (cut[0].sums if cut else [])]
    for slab in cut:
        at, a, b, c, d = ranges(nx, ny, slab, reach, eps, widths)
        for o, s in zip(out, slab.sums, strict=True):
            o[at] += s[c] - s[b]
        for first, end in ((a, b), (c, d)):
            for k, j in pairs(first, end):
                ok = inside(nx[at[k]] - slab.x[j], ny[at[k]] - slab.y[j])
                k, j = at[k[ok]], j[ok]
                for o, v in zip(out, slab.columns, strict=True):
                    np.add.at(o, k, v[j])
    return out


def distances_within(nx: np.ndarray, ny: np.ndarray, cut: list[Slab], reach: float, eps: float, inside: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Number of places and sum of their distances in a straight line, of each node; the slabs' column is the number of places with the same coordinates."""
    n, total = np.zeros(len(nx), np.int64), np.zeros(len(nx))
    for slab in cut:
        at, a, b, c, d = ranges(nx, ny, slab, reach, eps, circle(reach, eps))
        number, level = slab.columns[0].astype(float), slab.low == slab.high
        n[at] += slab.sums[0][c] - slab.sums[0][b]
        long = c - b >= 512
        for i in np.flatnonzero(long):
            own, node = slice(b[i], c[i]), at[i]
            far = slab.x[own] - nx[node]
            far *= far
            far += (slab.low - ny[node]) ** 2 if level else (slab.y[own] - ny[node]) ** 2
            total[node] += np.sqrt(far, out=far) @ number[own]
        for first, end, sure in ((b, np.where(long, b, c), True), (a, b, False), (c, d, False)):
            for k, j in pairs(first, end):
                dx, dy = nx[at[k]] - slab.x[j], ny[at[k]] - slab.y[j]
                far = np.sqrt(dx * dx + dy * dy)
                if not sure:
                    ok = inside(dx, dy)
                    k, j, far = k[ok], j[ok], far[ok]
                    np.add.at(n, at[k], slab.columns[0][j])
                total[at] += np.bincount(k, far * number[j], len(at))
    return n, total


def _once(nodes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different coordinates of nodes in the order of x, and each node's number among them."""
    at, back = np.unique(np.stack([nodes["nx"], nodes["ny"]], 1), axis=0, return_inverse=True)
    return at[:, 0].copy(), at[:, 1].copy(), back.reshape(-1)


def _in_circle(reach: float) -> Callable:
    return lambda dx, dy: dx * dx + dy * dy <= reach * reach


def merged(places: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Places with the same coordinates as one: x, y, their number n, and the columns' sums as doubles, 0 where there is no value."""
    return places.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(k) for k, c in columns.items()])


def _per_node(nodes: DataFrame, places: DataFrame, reach: float, names: list[str], found: Callable, most: tuple[int, int]) -> DataFrame:
    def kernel(a: dict, b: dict) -> dict:
        if not len(a["node"]) or not len(b["x"]):
            return {c: [] for c in ("node", *names)}
        nx, ny, back = _once(a)
        return {"node": a["node"]} | {c: v[back] for c, v in zip(names, found(nx, ny, b, margin(reach, nx, ny, b["x"], b["y"])), strict=True)}

    out = by_tiles(nodes.select("node", "nx", "ny"), places, reach, kernel, ", ".join(["node long", "n long", *[f"{c} double" for c in names[1:]]]), most)
    return out.groupBy("node").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")


def node_sums(nodes: DataFrame, places: DataFrame, reach: float, columns: dict[str, Column], box: bool = False, most: tuple[int, int] = (NODES, PLACES)) -> DataFrame:
    """(node, n, columns): of each node with places within `reach` (with box in x and in y, else in a straight line, closed), their number and the columns' sums."""
    inside = (lambda dx, dy: (np.abs(dx) <= reach) & (np.abs(dy) <= reach)) if box else _in_circle(reach)
    names = ["n", *columns]

    def found(nx, ny, b, eps):
        return sums_within(nx, ny, slabs(b["x"], b["y"], [b[c] for c in names]), reach, eps, (square if box else circle)(reach, eps), inside)

    return _per_node(nodes, merged(places, columns), reach, names, found, most)


def node_distances(nodes: DataFrame, places: DataFrame, reach: float, most: tuple[int, int] = (NODES, PLACES)) -> DataFrame:
    """(node, n, distance): of each node with places within `reach`, closed, their number and mean distance."""

    def found(nx, ny, b, eps):
        return distances_within(nx, ny, slabs(b["x"], b["y"], [b["n"]]), reach, eps, _in_circle(reach))

    return _per_node(nodes, merged(places, {}), reach, ["n", "distance"], found, most).withColumn("distance", F.col("distance") / F.col("n"))


def class_products(places: DataFrame, width: float, classes: int, most: tuple[int, int] = (NODES, PLACES)) -> DataFrame:
    """(class, cov, n) of classes with pairs: the mean product of values and the number of unordered pairs of places (x, y, v), each with itself too, whose distance is in the class: from (class - 1/2) * width on.

    Pairs are counted in both orders, then halved together with the places' own.
    """
    reach = (classes - 0.5) * width
    one = merged(places.where(_finite("x", "y") & F.col("v").isNotNull()), {"s": F.col("v"), "q": F.col("v") * F.col("v")})

    def kernel(a: dict, b: dict) -> dict:
        nx, ny, back = _once(a)
        eps = margin(reach, nx, ny, b["x"], b["y"])
        weight, value = np.zeros(len(nx), np.int64), np.bincount(back, a["s"], len(nx))
        np.add.at(weight, back, a["n"])
        cut = slabs(b["x"], b["y"], [b["n"], b["s"]])
        n, s = [0], [0.0]
        for k in range(1, classes + 1):
            r = (k - 0.5) * width
            upto = sums_within(nx, ny, cut, r, eps, circle(r, eps), lambda dx, dy, k=k: np.floor(np.sqrt(dx * dx + dy * dy) / width + 0.5) < k)
            n.append(int(weight @ upto[0]) if upto else 0)
            s.append(float(value @ upto[1]) if upto else 0.0)
        return {"class": np.arange(classes, dtype=np.int32), "n": np.diff(n), "s": np.diff(s)}

    nodes = one.select(F.lit(0).cast("long").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"), "n", "s")
    found = by_tiles(nodes, one.select("x", "y", "n", "s"), reach, kernel, "class int, n long, s double", most)
    own = one.agg(F.lit(0).alias("class"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("s"))
    both = found.unionByName(own).groupBy("class").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    return both.select("class", (F.col("s") / F.col("n")).alias("cov"), F.expr("n div 2").alias("n"))


def _nearest(nx: np.ndarray, ny: np.ndarray, b: dict, reach: float, most: int, order: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, place, distance) of the `most` nearest places in each quadrant around each node: circles grow from a few expected places on, for the quadrants that aren't full yet."""
    cut = slabs(b["x"], b["y"])
    rows, x, y = (np.concatenate([getattr(s, c) for s in cut]) for c in ("rows", "x", "y"))
    start, ids, eps = np.cumsum([0, *[len(s.x) for s in cut]]), b[order][rows], margin(reach, nx, ny, x, y)
    area = max(np.ptp(x), 1e-9 * reach) * max(np.ptp(y), 1e-9 * reach)
    r = min(reach, float(np.sqrt(12 * most * area / (np.pi * len(x)))))
    missing, out = np.ones((len(nx), 4), bool), []
    while missing.any():
        use = np.flatnonzero(missing.any(1))
        for nodes in np.array_split(use, len(use) // 8192 + 1):
            found = [(at, a + s, d + s) for slab, s in zip(cut, start, strict=False) for at, a, _, _, d in [ranges(nx[nodes], ny[nodes], slab, r, eps, circle(r, eps))]]
            at, first, end = (np.concatenate(c) for c in zip(*found, strict=True))
            by = np.argsort(at, kind="stable")
            at, first, end = at[by], first[by], end[by]
            upto = np.cumsum(np.bincount(at, end - first, len(nodes)))
            for own in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(upto // PAIRS)) + 1):
                part = slice(*np.searchsorted(at, (own[0], own[-1] + 1)))
                n = end[part] - first[part]
                k = nodes[np.repeat(at[part], n)]
                j = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                dx, dy = nx[k] - x[j], ny[k] - y[j]
                far = dx * dx + dy * dy
                side = k * 4 + (dx <= 0) * 2 + (dy <= 0)
                keep = (far <= r * r) & missing.reshape(-1)[side]
                k, j, side, far = k[keep], j[keep], side[keep], np.sqrt(far[keep])
                # equally near to 9 digits: half away from zero, as SQL rounds
                near = far * 1e9
                near = np.floor(near) + (near - np.floor(near) >= 0.5)
                by = np.lexsort((ids[j], near, side))
                k, j, side, far = k[by], j[by], side[by], far[by]
                rank = np.arange(len(side)) - np.searchsorted(side, side, "left")
                # places that rounding could put before others of the next circle don't make a quadrant full
                low = nodes[own[0]] * 4
                full = np.bincount(side[far <= r - 1e-8] - low, minlength=int(nodes[own[-1]] * 4 + 4 - low)) >= most
                ready = (rank < most) & (full[side - low] if r < reach else True)
                out.append((k[ready], rows[j[ready]], far[ready]))
                missing.reshape(-1)[low : low + len(full)] &= ~full if r < reach else False
        r = min(reach, 2 * r)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest_places(nodes: DataFrame, places: DataFrame, reach: float, keep: int, columns: list[str], order: str = "id", most: tuple[int, int] = (NODES, PLACES)) -> DataFrame:
    """(node, nx, ny, id, x, y, distance, columns): the `keep` nearest places (id, x, y and double columns) within `reach` in each quadrant around each node, equally near ones (to 9 digits) by `order`.

    A node whose places are in several groups has so many from each of them.
    """

    def kernel(a: dict, b: dict) -> dict:
        names = ["node", "nx", "ny", order, "x", "y", *columns]
        if not len(a["node"]) or not len(b["x"]):
            return {c: [] for c in (*names, "distance")}
        by = np.argsort(a["nx"], kind="stable")
        a = {c: v[by] for c, v in a.items()}
        k, j, far = _nearest(a["nx"], a["ny"], b, reach, keep, order)
        return {c: a[c][k] if c in a else b[c][j] for c in names} | {"distance": far}

    schema = ", ".join(["node long", "nx double", "ny double", f"{order} long", "x double", "y double", "distance double", *[f"{c} double" for c in columns]])
    return by_tiles(nodes.select("node", "nx", "ny"), places.select(order, "x", "y", *columns), reach, kernel, schema, most)


def pairs_apart(places: DataFrame, least: float, reach: float, digits: int = 6, most: tuple[int, int] = (NODES, PLACES)) -> DataFrame:
    """(a_id, b_id, distance): every pair of places (id, x, y) with a_id < b_id whose distance is `least` or more and under `reach`, once; distances are rounded, halves away from zero."""

    def kernel(a: dict, b: dict) -> Iterator[dict]:
        by = np.argsort(a["nx"], kind="stable")
        node, nx, ny = (a[c][by] for c in ("node", "nx", "ny"))
        eps = margin(reach, nx, ny, b["x"], b["y"])
        for slab in slabs(b["x"], b["y"], [b["id"]]):
            at, first, _, _, end = ranges(nx, ny, slab, reach, eps, circle(reach, eps))
            for k, j in pairs(first, end):
                k, ids = at[k], slab.columns[0][j]
                up = node[k] < ids
                k, j, ids = k[up], j[up], ids[up]
                dx, dy = nx[k] - slab.x[j], ny[k] - slab.y[j]
                far = np.sqrt(dx * dx + dy * dy)
                ok = (far >= least) & (far < reach)
                t = far[ok] * 10.0**digits
                yield {"a_id": node[k[ok]], "b_id": ids[ok], "distance": (np.floor(t) + (t - np.floor(t) >= 0.5)) / 10.0**digits}

    nodes = places.select(F.col("id").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return by_tiles(nodes, places.select("id", "x", "y"), reach, kernel, "a_id long, b_id long, distance double", most, pieces=True)
