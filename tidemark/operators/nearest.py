"""The nearest of irregular nodes for each point, exactly, at any density: two trees of tiles are walked down together, and only tiles that can hold a nearest node stay.

A tile's box is that of what lies in it. A tile of points has a node within the smallest of its largest distances to the boxes of node tiles, so a node tile further away than that holds
no nearest node of any of its points. Each level is one equi-join with the children of either side; tiles of at most LEAF places are not divided. Points meet nodes at the end only,
by the number of their tile: candidates per point depend on LEAF and the shape of the neighbourhood, not on the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch

LEAF = 16
DEPTH = 12  # levels; each divides a side by four
_SLACK = 1 + 1e-9  # bounds are rounded; differences and hypot are right to some units in the last place

_BOX = ("l", "r", "b", "t")


def _saved(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """The table written and read back, and aggregates (none, or all of an empty table null) observed on the way, which saves a job each."""
    path, seen = scratch(df.sparkSession), Observation()
    (df.observe(seen, *metrics) if metrics else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if metrics else {}


def _finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    return ok


def _place(x: str, low: float, width: float) -> Column:
    """The number of the finest tile."""
    return F.greatest(F.least(F.floor((F.col(x) - low) / width * 4.0**DEPTH), F.lit(4**DEPTH - 1)), F.lit(0)).cast("long")


def _at(level: str | int, c: str) -> Column:
    return F.expr(f"shiftright({c}, 2 * ({DEPTH} - {level}))")


def _tree(df: DataFrame, x: str, y: str, depth: int) -> DataFrame:
    """level, tx, ty, n and the box of every tile of the levels 0 .. depth that isn't empty. Rows are summed up in the tiles of the last level first."""
    fine = df.groupBy(_at(depth, "_fx").alias("fx"), _at(depth, "_fy").alias("fy")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("l"), F.max(x).alias("r"), F.min(y).alias("b"), F.max(y).alias("t")
    )
    every = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    up = lambda c: F.expr(f"shiftright({c}, 2 * ({depth} - level))")
    return every.groupBy("level", up("fx").alias("tx"), up("fy").alias("ty")).agg(F.sum("n").alias("n"), F.min("l").alias("l"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("t").alias("t"))


def _leaves(tree: DataFrame) -> DataFrame:
    """The tiles down to the first that has at most LEAF places, with leaf."""
    parent = tree.select((F.col("level") + 1).alias("level"), F.col("tx").alias("_ux"), F.col("ty").alias("_uy"), F.col("n").alias("_un"))
    t = tree.withColumn("_ux", F.shiftright("tx", 2)).withColumn("_uy", F.shiftright("ty", 2)).join(parent, ["level", "_ux", "_uy"], "left")
    t = t.where(F.col("_un").isNull() | (F.col("_un") > LEAF)).drop("_ux", "_uy", "_un")
    return t.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == DEPTH))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _pruned(pairs: DataFrame, reach: float | None) -> DataFrame:
    """Pairs of tiles without those that can't hold a nearest node; done tells whether all node tiles left of a point tile are leaves."""
    gap = lambda a, b: F.greatest(F.lit(0.0), F.col(f"n_{a}") - F.col(f"p_{b}"), F.col(f"p_{a}") - F.col(f"n_{b}"))
    span = lambda a, b: F.greatest(F.col(f"n_{b}") - F.col(f"p_{a}"), F.col(f"p_{b}") - F.col(f"n_{a}"))
    w = Window.partitionBy("p_tx", "p_ty")
    out = pairs.withColumn("_lo", F.hypot(gap("l", "r"), gap("b", "t"))).withColumn("_hi", F.min(F.hypot(span("l", "r"), span("b", "t"))).over(w))
    out = out.where(F.col("_lo") <= F.col("_hi") * _SLACK)
    if reach is not None:
        out = out.where(F.col("_lo") <= reach * _SLACK)
    return out.withColumn("done", F.min("n_leaf").over(w)).drop("_lo", "_hi")


def candidates(points: DataFrame, nodes: DataFrame, reach: float | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(points with the keys level, tx, ty of their tile, per such tile the nodes that can be nearest); None if either side is empty."""
    p, n = points.where(_finite("x", "y")), nodes.where(_finite("nx", "ny")).groupBy("nx", "ny").agg(F.min("node").alias("node"))
    both = p.select("x", "y").unionByName(n.select(F.col("nx").alias("x"), F.col("ny").alias("y")))
    e = both.agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t")).first()
    if e["l"] is None:
        return None
    width = max(e["r"] - e["l"], e["t"] - e["b"]) or 1.0
    n = n.withColumn("_fx", _place("nx", e["l"], width)).withColumn("_fy", _place("ny", e["b"], width))
    p = p.withColumn("_fx", _place("x", e["l"], width)).withColumn("_fy", _place("y", e["b"], width))
    tree, seen = _saved(_leaves(_tree(n, "nx", "ny", DEPTH)), F.max("level").alias("depth"))
    depth = seen["depth"]
    if depth is None:
        return None
    own, _ = _saved(_named(_tree(p, "x", "y", depth), "p_"))
    of = _named(tree, "n_")
    pairs = own.where("p_level = 0").join(of.where("n_level = 0"), F.col("p_level") == F.col("n_level"))
    left = (F.count(F.when(F.col("done"), 1)).alias("done"), F.count(F.when(~F.col("done"), 1)).alias("open"))
    now, seen = _saved(_pruned(pairs, reach), *left)
    tiles, levels = None, []
    for level in range(depth + 1):
        if seen["done"]:
            some = now.where("done").select("p_level", "p_tx", "p_ty", "n_level", "n_tx", "n_ty")
            tiles, levels = some if tiles is None else tiles.unionByName(some), [*levels, level]
        if not seen["open"]:
            break
        open_ = now.where("NOT done")
        kids = own.where(F.col("p_level") == level + 1).withColumn("_ux", F.shiftright("p_tx", 2)).withColumn("_uy", F.shiftright("p_ty", 2))
        open_ = open_.withColumnsRenamed({"p_tx": "_ux", "p_ty": "_uy"}).drop("p_level", "p_n", "done", *[f"p_{c}" for c in _BOX]).join(kids, ["_ux", "_uy"]).drop("_ux", "_uy")
        below = of.where(F.col("n_level") == level + 1).withColumn("_ux", F.shiftright("n_tx", 2)).withColumn("_uy", F.shiftright("n_ty", 2))
        deeper = open_.where("NOT n_leaf").withColumnsRenamed({"n_tx": "_ux", "n_ty": "_uy"}).drop("n_level", "n_n", "n_leaf", *[f"n_{c}" for c in _BOX]).join(below, ["_ux", "_uy"]).drop("_ux", "_uy")
        now, seen = _saved(_pruned(deeper.unionByName(open_.where("n_leaf")), reach), *left)
    if tiles is None:
        return None
    keyed = lambda df, prefix, every: df.withColumn(f"{prefix}level", F.explode(F.array(*[F.lit(k) for k in every]))).withColumn(
        f"{prefix}tx", _at(f"{prefix}level", "_fx")).withColumn(f"{prefix}ty", _at(f"{prefix}level", "_fy")).drop("_fx", "_fy")
    placed = keyed(n, "n_", range(depth + 1)).join(of.where("n_leaf").select("n_level", "n_tx", "n_ty"), ["n_level", "n_tx", "n_ty"])
    near = placed.join(tiles, ["n_level", "n_tx", "n_ty"]).select("p_level", "p_tx", "p_ty", "node", "nx", "ny")
    return keyed(p, "p_", levels), near


def nearest_node(points: DataFrame, nodes: DataFrame, reach: float | None = None) -> DataFrame:
    """Adds to each point (id, x, y) the nearest node (node, nx, ny), the smallest number of equally near ones, and its distance; within `reach` if that is given.

    Points without a node go, and so do those whose place is null or not finite; such nodes take no part. Repeated points stay repeated. A table without rows on either side gives none.
    """
    found = candidates(points.select("id", "x", "y"), nodes.select("node", "nx", "ny"), reach)
    kind = nodes.schema["node"].dataType
    if found is None:
        return points.where("false").withColumn("node", F.lit(None).cast(kind)).withColumn("distance", F.lit(None).cast("double"))
    keyed, near = found
    j = keyed.join(near, ["p_level", "p_tx", "p_ty"]).withColumn("distance", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    if reach is not None:
        j = j.where(F.col("distance") <= reach)
    best = j.groupBy(F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min(F.struct("distance", "node")).alias("_best"))
    out = points.join(best, F.col("id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    return out.select(*points.columns, F.col("_best.node").alias("node"), F.col("_best.distance").alias("distance"))
