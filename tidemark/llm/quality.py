"""Operator 2: quality scores by Naive Bayes support vectors.

Features: indicators of hashed n-grams in a space of 2**BITS cells. Two alphabets are used, bytes of the text (orders 1 to 3) and word shapes (orders 1 to 3; which
kinds of characters a word holds, whether it is a single character and whether it repeats the word before), so that both spelling and layout count.

1. Log-count ratios: the indicators are counted per class over every labelled training row, and r = log((p + a) / |p + a|) - log((n + a) / |n + a|).
2. Hinge loss: a linear model over the indicators times r (unit length) is fitted by dual coordinate descent with the squared hinge, on a sample of about `fit_rows`
   labelled rows. That bound is the only sample; the ratios above and the scores below cover all rows.
3. Margins become scores from 0 to 1 by a logistic curve fitted on the same sample, each row judged by the model of the folds without it.

What reaches the driver is the model: a few arrays of 2**BITS numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .words import chunks

BITS = 16
SIZE = 1 << BITS
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x9E3779F9)  # odd multipliers, one per alphabet and order


def _cells(x: np.ndarray, kind: int) -> np.ndarray:
    x = x.astype(np.uint32) + np.uint32(kind + 1)
    x *= np.uint32(_SEEDS[kind])
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(32 - BITS)).astype(np.int64)


def _shapes(w) -> np.ndarray:
    d = w.data
    upper = (d >= 65) & (d <= 90)
    lower = ((d >= 97) & (d <= 122)) | (d >= 128)
    digit = (d >= 48) & (d <= 57)
    code = np.zeros(w.n, np.uint32)
    for bit, kind in enumerate((upper, lower, digit, ~(upper | lower | digit))):
        c = np.zeros(len(d) + 1, np.int64)
        np.cumsum(kind, out=c[1:])
        code |= (c[w.end] > c[w.start]).astype(np.uint32) << np.uint32(bit)
    code |= (w.end - w.start == 1).astype(np.uint32) << np.uint32(4)
    h = w.cells()
    again = np.zeros(w.n, bool)
    again[1:] = h[1:] == h[:-1]
    at = w.first[:-1]
    again[at[at < w.n]] = False
    return code | again.astype(np.uint32) << np.uint32(5)


def feature_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the cells of its n-grams (with repeats)."""
    for a, b, w in chunks(column):
        d = w.data.astype(np.uint32)
        s = _shapes(w)
        grams, starts = [], []
        for base, values, bits in ((0, d, 8), (3, s, 6)):
            x = values
            for k in range(3):
                if k:
                    x = (x[:-1] << np.uint32(bits)) | values[k:]
                grams.append(_cells(x, base + k))
                starts.append((k, base))
        for i in range(b - a):
            own = []
            for (k, base), g in zip(starts, grams, strict=True):
                lo, hi = (w.offsets[i], w.offsets[i + 1]) if base == 0 else (w.first[i], w.first[i + 1])
                own.append(g[lo : max(lo, hi - k)])
            yield np.concatenate(own)


class Distinct:
    """The distinct cells of texts, each in time that grows with its own cells only."""

    def __init__(self):
        self.last = np.zeros(SIZE, np.int64)

    def of(self, cells: np.ndarray) -> np.ndarray:
        place = np.arange(len(cells))
        self.last[cells] = place
        return cells[self.last[cells] == place]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's rows: per class the number of texts that have each cell."""
    totals, distinct = np.zeros((2, SIZE), np.int64), Distinct()
    for batch in batches:
        for y, idx in zip(batch.column("label").to_pylist(), feature_rows(batch.column("text")), strict=True):
            totals[y, distinct.of(idx)] += 1
    for y in (0, 1):
        cells = np.flatnonzero(totals[y])
        if len(cells):
            yield pa.RecordBatch.from_pydict({"label": pa.array([y] * len(cells), pa.int32()), "cell": pa.array(cells.astype(np.int32)), "n": pa.array(totals[y, cells])})


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss: the weights w (the last one of a constant feature)."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0 + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i], values[i]
            g = y[i] * (w[idx] @ v + w[size]) - 1.0 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / square[i], 0.0)
            step = new - alpha[i]
            if step:
                w[idx] += step * y[i] * v
                w[size] += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with label 1 at probability 1 / (1 + exp(-(a * margin + b))), by Newton's method with smoothed targets."""
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (t - p) - 1e-3 * ab)
        ab = ab + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


def _fit(ratio: np.ndarray, cost: float, folds: int = 3):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for key, y, idx in zip(batch.column("spot").to_pylist(), batch.column("label").to_pylist(), feature_rows(batch.column("text")), strict=True):
                idx = np.unique(idx).astype(np.int32)
                got.append((key, y, len(idx), idx))
        got.sort(key=lambda g: g[:3])  # the same order in every run
        rows = [g[3] for g in got]
        y = np.array([1.0 if g[1] else -1.0 for g in got])
        values = [ratio[idx] for idx in rows]
        values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
        a, b = 0.0, 0.0
        w = np.zeros(SIZE + 1)
        if len(rows):
            w = descend(rows, values, y, SIZE, cost)
            margin = np.zeros(len(rows))
            for k in range(folds):
                fit, rest = [i for i in range(len(rows)) if i % folds != k], range(k, len(rows), folds)
                part = descend([rows[i] for i in fit], [values[i] for i in fit], y[fit], SIZE, cost)
                for i in rest:
                    margin[i] = part[rows[i]] @ values[i] + part[SIZE]
            a, b = logistic(margin, y)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([a]), pa.array([b])], ["w", "a", "b"])

    return emit


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, smooth: float = 1.0, cost: float = 1.0) -> dict:
    """The model from all rows of docs (doc_id, text) with a label (doc_id, label 0 or 1); see the module's text. fit_rows: rows of the hinge-loss sample, about."""
    spark = docs.sparkSession
    spot = F.xxhash64(F.col("doc_id").cast("string"))
    # texts and labels meet by a shuffle at every size: labels grow with the corpus, so a broadcast of them has no bound
    labelled = docs.join(labels.hint("merge"), "doc_id")
    counts = labelled.select("label", "text").mapInArrow(_count, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    zeros, ones = np.zeros(SIZE), np.zeros(SIZE)
    for r in counts.collect():  # SIZE numbers per class at most
        (ones if r["label"] else zeros)[r["cell"]] = r["n"]
    p, n = ones + smooth, zeros + smooth
    ratio = np.log(p / p.sum()) - np.log(n / n.sum())
    # cells that no training text has say nothing
    ratio[(ones + zeros) == 0] = 0.0

    total = labels.count()
    share = min(1.0, fit_rows / max(total, 1))
    chosen = labels.withColumn("spot", spot).where(F.pmod("spot", F.lit(1 << 40)) < int(share * (1 << 40)))
    # about fit_rows rows, whatever the size of the corpus: a bounded broadcast, so that only their texts move
    sample = docs.join(F.broadcast(chosen), "doc_id").select("spot", "label", "text").repartition(1)
    model = sample.mapInArrow(_fit(ratio, cost), "w array<double>, a double, b double").first()
    if model is None:
        return {"weights": np.zeros(SIZE), "bias": 0.0, "squares": ratio**2, "a": 0.0, "b": 0.0}
    w = np.array(model["w"])
    return {"weights": w[:SIZE] * ratio, "bias": float(w[SIZE]), "squares": ratio**2, "a": model["a"], "b": model["b"]}


def _score(shared):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, distinct = shared.value, Distinct()
        for batch in batches:
            out = np.zeros(len(batch))
            for i, idx in enumerate(feature_rows(batch.column("text"))):
                own = distinct.of(idx)
                square = m["squares"][own].sum()
                margin = m["bias"] + (m["weights"][own].sum() / np.sqrt(square) if square > 0 else 0.0)
                out[i] = 1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -30, 30)))
            keep = [batch.column(k) for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out)], [*[k for k in batch.schema.names if k != "text"], "score"])

    return emit


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0,
    threshold: float = 0.3, fit_rows: int = 6000, carry: str | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, held_out (crc32 of the id as text modulo folds is held), score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Only labels of rows that aren't held out are learned; an id with several labels has its smallest. Null labels are ignored. Null text counts as empty and gets the
    score of a text without n-grams. Repeated rows count one by one. Without any labelled row the score is 0.5. Other columns are ignored, but
    the one named carry is passed along.
    """
    own = [F.col(carry)] if carry else []
    carried = f"{carry} {docs.schema[carry].dataType.simpleString()}, " if carry else ""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
    learned = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where((crc_mod("doc_id", folds) != held) & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    model = train(docs.select("doc_id", "text"), learned, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.mapInArrow(_score(shared), f"doc_id {id_type}, {carried}score double")
        .select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *own)
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
