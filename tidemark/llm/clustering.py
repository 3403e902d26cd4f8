"""Operator 11: k-means on exact integers; float32 products screen the centroids, intervals around them decide where integers must.

A vector's order of centroids is that of |c|**2 - 2 x.c. One float32 matrix product per chunk gives x.c with an error of at most
gamma(d + 2) * |x| * |c| (d products and sums, and the rounding of both factors), so every centroid has an interval that holds its true value. Centroids
whose interval starts above the lowest end are out. Where one is left it is the nearest; where intervals overlap, the squared distances of those left are
computed in 64-bit integers, and the smallest number wins a tie.

Every round is one pass over the table: a task adds up its vectors per centroid, so k rows a task are shuffled, and k sums of d numbers reach the driver
whatever the table's size. A popular cluster is no group of rows anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .vectors import UNIT, integers, norms, whole

DIM, FACTOR, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
BITS = 26  # distances then fit 64 bits up to 1,024 components
CHUNK = 8192  # vectors a matrix product


def nearest(x: np.ndarray, c: np.ndarray, unit: float = UNIT) -> np.ndarray:
    """The number of the nearest row of c (integers) for every row of x (integers); ties go to the smallest number. A larger unit only makes more rows exact."""
    d = x.shape[1]
    dots = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    gamma = (d + 2) * unit / (1 - (d + 2) * unit)
    squares = (c * c).sum(1).astype(np.float64)
    value = squares - 2 * dots
    radius = 2 * gamma * norms(x)[:, None] * norms(c)[None, :] * (1 + 1e-9) + (squares + 2 * np.abs(dots)) * 2.0**-50
    left = value - radius <= (value + radius).min(1, keepdims=True)
    out = left.argmax(1)
    open_rows = np.flatnonzero(left.sum(1) > 1)
    if len(open_rows):
        row, number = np.nonzero(left[open_rows])
        exact = np.full((len(open_rows), len(c)), np.iinfo(np.int64).max)
        for lo in range(0, len(row), CHUNK):
            r, k = row[lo : lo + CHUNK], number[lo : lo + CHUNK]
            exact[r, k] = ((x[open_rows[r]] - c[k]) ** 2).sum(1)
        out[open_rows] = exact.argmin(1)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], dim: int, factor: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            yield part.column("vec_id"), integers(part.column("v"), dim, factor, BITS)


def _sums(shared, dim: int, factor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, x in _chunks(batches, dim, factor):
            to = nearest(x, c)
            n += np.bincount(to, minlength=len(c))
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.diff(to[order], prepend=-1))
            total[to[order][at]] += np.add.reduceat(x[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return emit


def _assign(shared, dim: int, factor: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for ids, x in _chunks(batches, dim, factor):
            to = nearest(x, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(((x - c[to]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return emit


def first_centroids(vectors: DataFrame, clusters: int, factor: int, seed: int) -> np.ndarray:
    """The integers of the `clusters` vectors with the smallest sha256 of 'seed:id'; rows that share an id go by their components, rows without an id come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    whole_numbers = F.transform("v", lambda x: F.floor(x.cast("double") * factor).cast("long"))
    first = vectors.orderBy(mark.asc_nulls_last(), F.col("v")).limit(clusters).select(whole_numbers.alias("v")).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, factor: int = FACTOR, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): per vector that takes part vec_id, cluster, distance (squared); and the final centroids, k rows of integers.

    Vectors with another number of components than dim, or with a null or non-finite one, are left out; null vectors too. A null id is passed along. Rows that repeat
    count one by one. Fewer vectors than clusters give as many centroids as there are vectors, an empty table gives no rows. Components of 2**26 / factor or more
    are an error: exact distances would not fit a long. Other columns are ignored.
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(whole(F.col("v"), dim))
    spark = own.sparkSession
    c = first_centroids(own, clusters, factor, seed)
    id_type = own.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {id_type}, cluster int, distance long"
    if not len(c):
        return spark.createDataFrame([], out), np.zeros((0, dim), np.int64)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)
        found = own.mapInArrow(_sums(shared, dim, factor), "cluster int, n long, total array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)])
        c = c.copy()
        for r in found.collect():
            c[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(dim)]
        shared.destroy()
    return own.mapInArrow(_assign(spark.sparkContext.broadcast(c), dim, factor), out), c


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256: sums of distance over each cluster and over all rows (k numbers), and a digest of the final centroid."""
    spark = assigned.sparkSession
    kept = settle(assigned)
    sums = {r["cluster"]: r["s"] for r in kept.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(k, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sums.items()]
    return kept.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings")))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY k LIMIT 16)",
    ]
    for i in range(4):
        steps += [
            f"d{i} AS (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i})",
            f"a{i} AS (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY r)",
        ]
        if i < 3:
            steps += [
                f"u{i} AS (SELECT k, pos, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM v JOIN a{i} USING (r)) GROUP BY k, pos)",
                f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM u{i} GROUP BY k)",
                f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)",
            ]
    return "WITH " + ",\n".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps) + """
SELECT v.vec_id, CAST(a3.k AS INTEGER) AS cluster, CAST(a3.d AS BIGINT) AS distance, CAST(sum(a3.d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a3.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM v JOIN a3 USING (r) JOIN c3 ON c3.k = a3.k"""


OP11_SQL = _sql()
