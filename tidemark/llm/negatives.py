"""Operator 12: hard negatives by exact inner products, with an orthogonal rotation onto principal components to discard rows early.

A row's score is the inner product of its integers with the anchor's. Both are rotated onto the principal axes of the table (second moments, added up in the
tasks; d x d numbers reach the driver), so most of a product lies in the leading components. With the product p of the first m components and the norms r of the
other components, a score is at most p + r(row) * r(anchor) + slack, where slack bounds every rounding (rotation in float64, storage and products in float32) relative to both
norms. One float32 matrix product gives this bound for a chunk of rows and anchors, since the residual norms and the slack are two more columns. Rows whose bound is below an anchor's
present threshold are out; a second step adds the next components for those left; what still is in is scored in 64-bit integers. So the result is that of scoring everything.

Anchors are taken in shards of a fixed number, one broadcast at a time, and every shard reads the table twice: for the best rows of the anchor's label, then for the best
rows of other labels in each positive's window of scores. A task keeps the best few rows per anchor and passes on only these; they are combined per anchor. Rows are never
shuffled, so a label with a third of all rows is no group anywhere. The work is anchors x rows, as an exact search of a query set against all rows is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, settle, table
from .vectors import UNIT, integers, norms, whole

DIM, FACTOR = 64, 256
BITS = 22  # products then stay below 2**53 up to 512 components
LEAD = (16, 32)  # components of the first and second bound
SHARD = 32768  # anchors broadcast at a time
ROWS, ANCHORS, PAIRS = 2048, 4096, 16384  # of one matrix product, and pairs scored at a time
LEAST = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes after all others


def rotation(vectors: DataFrame, dim: int, factor: int) -> np.ndarray:
    """d x d: the principal axes of the integer vectors, by falling second moment. Any orthogonal matrix gives the same result; this one discards most."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = integers(batch.column("v"), dim, factor, BITS).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    sums = vectors.mapInArrow(emit, "i int, row array<double>").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(dim)])
    moments = np.zeros((dim, dim))
    for r in sums.collect():
        moments[r["i"]] = [r[f"s{j}"] for j in range(dim)]
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


class Rotated:
    """Integer rows with what the bounds need: float32 coordinates, norms, and the residual norms behind each number of leading components."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        z = x.astype(np.float64) @ axes
        self.x, self.z, self.size = x, z.astype(np.float32), norms(x)
        tail = np.cumsum((z * z)[:, ::-1], 1)[:, ::-1]
        self.rest = [np.sqrt(tail[:, m]) * (1 + 1e-6) if m < x.shape[1] else np.zeros(len(x)) for m in LEAD]

    def columns(self, slack: float, as_anchor: bool) -> np.ndarray:
        """The leading coordinates, the residual norm and the (slack times) norm, so that a product of two such rows is the first bound."""
        ends = np.stack([self.rest[0], self.size * (1.0 if as_anchor else slack)], 1) * (1 + 1e-6)
        return np.concatenate([self.z[:, : LEAD[0]], ends.astype(np.float32)], 1)


def slack_of(m: int, axes: np.ndarray) -> float:
    """A bound on |score - rotated product| / (norm * norm) for m float32 products: storage, products and sums, and what the axes lack to be orthogonal."""
    d = len(axes)
    skew = np.linalg.norm(axes.T @ axes - np.eye(d)) + 1e-13 * d
    return ((m + 8) * UNIT * 1.01 + 4 * skew) * (1 + 1e-3)


class Best:
    """The k best (score, id) of every slot: higher scores, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), LEAST), np.full((slots, k), NO_ID)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k = self.score.shape[1]
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, k), slot])
        score, ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        at = first[:, None] + np.arange(k)
        self.score[touched], self.id[touched] = score[at], ids[at]


def _survivors(rows: Rotated, bounds: np.ndarray, anchors: Rotated, own: np.ndarray, least: np.ndarray, slack: tuple, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, score) of the pairs of all rows and the anchors lo .. hi - 1 whose bounds reach least[anchor]; the score is exact and reaches it too."""
    a, b = LEAD
    for at in range(lo, hi, ANCHORS):
        to = min(at + ANCHORS, hi)
        row, anchor = np.nonzero(bounds @ own[at:to].T >= least[at:to].astype(np.float32)[None, :])
        for p in range(0, len(row), PAIRS):
            r, q = row[p : p + PAIRS], anchor[p : p + PAIRS] + at
            lead = (rows.z[r, :b].astype(np.float64) * anchors.z[q, :b]).sum(1)
            keep = lead + rows.rest[1][r] * anchors.rest[1][q] + slack[1] * rows.size[r] * anchors.size[q] >= least[q]
            r, q = r[keep], q[keep]
            score = (rows.x[r] * anchors.x[q]).sum(1)
            keep = score >= least[q]
            yield r[keep], q[keep], score[keep]


def _groups(batches: Iterator[pa.RecordBatch], shared, dim: int, factor: int) -> Iterator[tuple[int, np.ndarray, Rotated, np.ndarray]]:
    """(label, ids, rows, bounds) of runs of rows with one label; the first runs of a label are short, so that thresholds exist when the long ones come."""
    axes, slack, known = shared["axes"], shared["slack"], shared["labels"]
    seen: dict = {}
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        x = integers(batch.column("v"), dim, factor, BITS)
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            p = 0
            while p < len(mine):
                n = min(ROWS, max(32, seen.get(label, 0)))
                take = mine[p : p + n]
                seen[label] = seen.get(label, 0) + len(take)
                p += n
                rows = Rotated(x[take], axes)
                yield int(label), ids[take], rows, rows.columns(slack[0], False)


def _span(labels: np.ndarray, label: int) -> tuple[int, int]:
    return int(np.searchsorted(labels, label)), int(np.searchsorted(labels, label, "right"))


def _float_least(least: np.ndarray) -> np.ndarray:
    """Thresholds as float64 that survive the cast to float32 from above: never above the true ones."""
    f = least.astype(np.float64)
    return np.where(np.isfinite(f), f - np.abs(f) * 2.0**-23, f)


def _positives(shared, k: int, dim: int, factor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        anchors = Rotated(s["x"], s["axes"])
        own = anchors.columns(s["slack"][0], True)
        best = Best(len(s["x"]), k)
        for label, ids, rows, bounds in _groups(batches, s, dim, factor):
            lo, hi = _span(s["labels"], label)
            least = _float_least(best.score[:, -1])
            for r, q, score in _survivors(rows, bounds, anchors, own, least, s["slack"], lo, hi):
                other = ids[r] != s["ids"][q]
                best.add(q[other], score[other], ids[r[other]])
        yield from _emit(best)

    return emit


def _negatives(shared, k: int, low: int, high: int, dim: int, factor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        anchors = Rotated(s["x"], s["axes"])
        own = anchors.columns(s["slack"][0], True)
        positive = s["positive"]  # anchors x positives, LEAST where there is none
        n, m = positive.shape
        there = (positive != LEAST) & (positive >= 0)
        p = np.where(there, positive, 0)
        floor, ceiling = np.where(there, -((-low * p) // 100), NO_ID), np.where(there, high * p // 100, LEAST)
        best = Best(n * m, k)
        for label, ids, rows, bounds in _groups(batches, s, dim, factor):
            lo, hi = _span(s["labels"], label)
            least = _float_least(np.maximum(floor, best.score[:, -1].reshape(n, m)).min(1))
            for a, b in ((0, lo), (hi, n)):
                for r, q, score in _survivors(rows, bounds, anchors, own, least, s["slack"], a, b):
                    for j in range(m):
                        fits = (score >= floor[q, j]) & (score <= ceiling[q, j])
                        best.add(q[fits] * m + j, score[fits], ids[r[fits]])
        yield from _emit(best)

    return emit


def _emit(best: Best) -> Iterator[pa.RecordBatch]:
    slot, at = np.nonzero(best.score != LEAST)
    ids = best.id[slot, at]
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(best.score[slot, at]), pa.array(ids, pa.int64(), mask=ids == NO_ID)], ["slot", "score", "id"])


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _shards(anchors: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of key, which counts on from (partition << 33), of at most `most` anchors each."""
    counts = {r["part"]: r["n"] for r in anchors.groupBy(F.shiftright("key", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out, start, held, end = [], None, 0, 0
    for part in sorted(counts):
        base, left = part << 33, counts[part]
        while left:
            start = base if start is None else start
            n = min(left, most - held)
            held, left, base = held + n, left - n, base + n
            end = base
            if held == most:
                out.append((start, end))
                start, held = None, 0
    return [*out, (start, end)] if held else out


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, dim: int = DIM, factor: int = FACTOR, shard: int = SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its positives, the best negatives.

    anchor: a condition on the columns of vectors (null: no anchor). An anchor's positives are the best `positives` rows of its label with another id, its negatives for a
    positive the best `negatives` rows of other labels whose score is low to high per cent of the positive's; higher scores first, then smaller ids, null ids last. Rows with a
    null label, a null vector, a null or non-finite component, or another number of components than dim take no part. Rows that repeat count one by one, anchors that agree in id,
    label and vector once. A positive without negatives gives no row, nor does an empty table. Components of 2**22 / factor or more are an error: exact products
    would leave the range in which bounds hold. Other columns are ignored.
    """
    kept = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), "_anchor"
    ).where(F.col("label").isNotNull() & whole(F.col("v"), dim))
    rows = kept.select("vec_id", "label", "v")
    spark = rows.sparkSession
    chosen = settle(kept.where("_anchor AND vec_id IS NOT NULL").select("vec_id", "label", "v").distinct().withColumn("key", F.monotonically_increasing_id()))
    axes = rotation(rows, dim, factor)
    slack = (slack_of(LEAD[0] + 2, axes), slack_of(LEAD[1], axes))
    schema = "slot long, score long, id long"
    parts = []
    for lo, hi in _shards(chosen, shard):
        own = chosen.where(f"key >= {lo} AND key < {hi}").drop("key").toArrow().combine_chunks()
        own = own.take(np.lexsort((own["vec_id"].to_numpy(), own["label"].to_numpy())))
        model = {"ids": own["vec_id"].to_numpy(), "labels": own["label"].to_numpy(), "x": integers(own["v"].combine_chunks(), dim, factor, BITS), "axes": axes, "slack": slack}
        shared = spark.sparkContext.broadcast(model)
        found = _top(rows.mapInArrow(_positives(shared, positives, dim, factor), schema), positives)
        best = settle(found)
        pairs = best.toArrow()
        shared.destroy()
        score = np.full((len(model["ids"]), positives), LEAST)
        score[pairs["slot"].to_numpy(), pairs["rank"].to_numpy() - 1] = pairs["score"].to_numpy()
        shared = spark.sparkContext.broadcast(model | {"positive": score})
        found = _top(rows.mapInArrow(_negatives(shared, negatives, low, high, dim, factor), schema), negatives)
        names = spark.createDataFrame(pa.table({"a": pa.array(range(len(model["ids"])), pa.int64()), "anchor_id": own["vec_id"]}))
        negative = found.select(F.floor(F.col("slot") / positives).alias("a"), (F.col("slot") % positives + 1).cast("int").alias("p"), F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        positive = best.select(F.col("slot").alias("a"), F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        parts.append(settle(negative.join(positive, ["a", "p"]).join(names, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
        discard(best)
        shared.destroy()
    discard(chosen)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(parts[0].schema).parquet(*[p.settled_at for p in parts])


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
