"""Operator 10: near-duplicate documents by circulant MinHash.

Signatures: a document's set of word shingles is hashed to 64 bits; the first permutation (a mixing bijection, the upper 32 bits of the hash) places
it on a circle of 2**32 cells, and coordinate k is the smallest value of the second permutation over the set shifted by k steps around the circle.
So two permutations make all `bands * rows` coordinates.

Candidates: documents that agree in all rows of a band share a bucket. With 40 bands of 5 rows, a pair of similarity 0.8 misses every bucket with
probability 1.3e-7.

Links without the pairs of a group:

1. Documents with equal sets form a class. Classes are numbered, so that one id with several texts is in several classes that aren't tied by it.
2. Every class is compared with one centre, the member with the smallest id of a bucket with which it shares most buckets, on the full sets.
   Connected components of these links follow.
3. Buckets whose members are all in one component are settled. In every other bucket, the members outside its largest component are the queries: each
   is compared, on the full sets, with the members of other components, in blocks of bounded numbers of documents and shingles. A pair is compared in the first bucket that it
   shares only, and a block reports the links of a spanning forest: fewer than it has documents, however many pairs are alike.
4. The components are joined along these links and named by the smallest id of their documents.

Nothing is capped: a pair in a common bucket is compared unless its members are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, settle, table
from .words import chunks, mix32, mix64, runs, signed

_STEP = 0x9E3779B1  # cells by which the circle turns from one coordinate to the next (odd: never the same twice)
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # documents and shingles (8 bytes each) of either side of a block, about


def shingle_sets(words, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of `width` words; of all its words where it has fewer."""
    h = words.hashes()
    all_runs = runs(h, width)
    out = []
    for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if e - s >= width:
            out.append(np.unique(all_runs[s : e - width + 1]))
        elif e > s:
            out.append(runs(h[s:e], e - s) ^ np.uint64(0xD6E8FEB86659FD93 + e - s))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """(size, sets) circulant MinHash coordinates of non-empty sets that follow one another in values."""
    cells = (mix64(values) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((size, len(offsets)), np.uint32)
    for k in range(size):
        out[k] = np.minimum.reduceat(mix32(cells + np.uint32((k * _STEP) & 0xFFFFFFFF)), offsets)
    return out


def _sign(width: int, bands: int, rows: int, carry: str | None = None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, w in chunks(batch.column("text"), lower=True):
                sets = shingle_sets(w, width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((2, len(n)), np.uint64)
                bucket = np.zeros((bands, len(full)), np.uint64)
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    offsets = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    keys[0, full] = np.add.reduceat(mix64(values), offsets)
                    keys[1, full] = np.add.reduceat(mix64(values ^ np.uint64(0xE7037ED1A0B428DB)), offsets)
                    sig = signatures(values, offsets, bands * rows).astype(np.uint64)
                    for i in range(bands):
                        x = np.full(len(full), i + 1, np.uint64)
                        for k in range(i * rows, (i + 1) * rows):
                            x = mix64(x * np.uint64(0x9FB21C651E98DF25) + sig[k])
                        bucket[i] = x
                lengths = np.zeros(len(n) + 1, np.int32)
                lengths[1:][full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), signed(bucket.T.ravel()))
                own = [batch.column(carry).slice(a, b - a)] if carry else []
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(n), signed(keys[0]), signed(keys[1]), lists, *own],
                    ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands", *([carry] if carry else [])],
                )

    return emit


def _sets(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep")
            for a, b, w in chunks(batch.column("text"), lower=True):
                sets = shingle_sets(w, width)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([reps.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), signed(values))], ["rep", "shingles"])

    return emit


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; the rows arrive with equal keys together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(c[s] for c in cols)
            if this != key and held:
                yield pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _compare(percent: int):
    """In each block, links that join what its queries (q) and members of other components join; a pair that earlier links of the block join isn't compared."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "mb", "qb"]):
            t = t.combine_chunks()
            asks = t.column("asks").to_numpy()
            query, member = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(query) or not len(member):
                continue
            ids, roots = t.column("rep").to_numpy(), t.column("root").to_numpy()
            outer = t.column("outer").to_numpy()
            at = t.column("band").to_numpy()[0]
            col = t.column("bands").combine_chunks()
            bands = col.flatten().to_numpy().reshape(len(t), -1)
            sets = t.column("shingles").combine_chunks()
            values = sets.flatten().to_numpy().view(np.uint64)
            size = sets.value_lengths().to_numpy().astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            left, right = [], []
            joined = np.unique(roots, return_inverse=True)[1]
            for q in query:
                # of two queries, the one with the smaller id asks
                m = member[(joined[member] != joined[q]) & (~outer[member] | (ids[member] > ids[q]))]
                m = m[(100 * np.minimum(size[m], size[q]) >= percent * np.maximum(size[m], size[q]))]
                if not len(m):
                    continue
                shared = bands[m] == bands[q]
                m = m[shared.any(1) & (shared.argmax(1) == at)]
                if not len(m):
                    continue
                own = values[begin[q] : begin[q] + size[q]]
                rest = np.concatenate([values[begin[i] : begin[i] + size[i]] for i in m])
                place = np.minimum(np.searchsorted(own, rest), len(own) - 1)
                offsets = np.concatenate([[0], np.cumsum(size[m])[:-1]])
                both = np.add.reduceat((own[place] == rest).astype(np.int64), offsets)
                hit = m[100 * both >= percent * (size[m] + size[q] - both)]
                if len(hit):
                    met, one = np.unique(joined[hit], return_index=True)
                    left += [roots[q]] * len(one)
                    right += roots[hit[one]].tolist()
                    joined[np.isin(joined, met)] = joined[q]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return emit


def near_dedup(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text",
    carry: str | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id is component_id).

    A document's set: its distinct runs of `width` words (A-Z lower-cased); with fewer words, the whole sequence as one. Two documents are linked if 100 *
    intersection size >= percent * union size. Null text and text without words: empty set, linked with nothing. A null id: linked with nothing,
    component_id null, kept true. Ids are integers. Rows that repeat an id are documents of their own: each is linked by its own text, a shared id links
    nothing, and a group's rows with its smallest id are all kept. Other columns are ignored, but the one named carry is passed along.
    """
    own = [carry] if carry else []
    carried = f", {carry} {docs.schema[carry].dataType.simpleString()}" if carry else ""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *own)
    signed_docs = settle(
        docs.mapInArrow(_sign(width, bands, rows, carry), f"doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>{carried}")
    )
    some = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # the numbers of the classes are settled with them: a step that runs again reads the same ones
    classes = settle(some.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("m")).select(
        "k1", "k2", "n_shingles", F.monotonically_increasing_id().alias("rep"), "m.doc_id", "m.text_hash", "m.bands"
    ))

    member = classes.select("rep", "doc_id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowd = member.groupBy("bucket").agg(F.min(F.struct("doc_id", "rep")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = crowd.select("bucket", "centre.rep", "n").withColumnRenamed("rep", "centre")
    member = settle(member.join(crowd, "bucket").select("bucket", "band", "rep", "n_shingles", "centre"))
    best = (
        member.where("rep <> centre")
        .groupBy("rep", "centre")
        .count()
        .groupBy("rep")
        .agg(F.max(F.struct("count", (-F.col("centre")).alias("c"))).alias("m"))
        .select(F.col("rep").alias("x"), (-F.col("m.c")).alias("c"))
    )
    needed = classes.select("rep", "doc_id", "text_hash").join(member.select("rep").distinct(), "rep", "left_semi")
    texts = docs.select("doc_id", "text_hash", "text").join(needed, ["doc_id", "text_hash"]).select("rep", "text")
    sets = settle(texts.mapInArrow(_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep"]))

    one = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    two = sets.select(F.col("rep").alias("c"), F.col("shingles").alias("sc"))
    both = F.size(F.array_intersect("sx", "sc"))
    linked = best.join(one, "x").join(two, "c").select("x", "c", both.alias("i"), (F.size("sx") + F.size("sc") - both).alias("u"))
    first = components(linked.where(F.col("i") * 100 >= F.col("u") * percent).select(F.col("x").alias("a"), F.col("c").alias("b")))

    placed = settle(
        member.join(first, member["rep"] == first["node"], "left").select("bucket", "band", "rep", "n_shingles", F.coalesce("root", "rep").alias("root"))
    )
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s"))
    open_buckets = (
        parts.groupBy("bucket")
        .agg(F.max(F.struct("k", "root", "s")).alias("m"), F.sum("k").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("roots"))
        .where("roots > 1")
        .select(
            "bucket",
            F.col("m.root").alias("largest"),
            F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("m_blocks"),
            F.ceil(F.greatest((F.col("n") - F.col("m.k")) / BLOCK, (F.col("s") - F.col("m.s")) / BLOCK_SHINGLES)).cast("int").alias("q_blocks"),
        )
    )
    opened = settle(placed.join(open_buckets, "bucket").withColumn("outer", F.col("root") != F.col("largest")))
    spot = F.xxhash64("rep", "bucket")
    asks = opened.where("outer").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"), F.pmod(spot, F.col("q_blocks")).cast("int").alias("qb"),
        F.lit(True).alias("asks"), "outer", "band", "rep", "root",
    )
    told = opened.select(
        "bucket", F.pmod(spot, F.col("m_blocks")).cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"),
        F.lit(False).alias("asks"), "outer", "band", "rep", "root",
    )
    facts = classes.select("rep", "bands").join(sets, "rep")
    found = (
        asks.unionByName(told)
        .join(facts, "rep")
        .repartition("bucket", "mb", "qb")
        .sortWithinPartitions("bucket", "mb", "qb")
        .mapInArrow(_compare(percent), "a long, b long")
    )
    second = components(found)

    rooted = settle(
        classes.select("k1", "k2", "n_shingles", "rep", "doc_id")
        .join(first.select(F.col("node").alias("rep"), F.col("root").alias("r1")), "rep", "left")
        .withColumn("r1", F.coalesce("r1", "rep"))
        .join(second.select(F.col("node").alias("r1"), F.col("root").alias("r2")), "r1", "left")
        .select("k1", "k2", "n_shingles", "doc_id", F.coalesce("r2", "r1").alias("root"))
    )
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = rooted.join(names, "root").select("k1", "k2", "n_shingles", "component_id")
    return (
        signed_docs.select("doc_id", "n_shingles", "k1", "k2", *own)
        .join(roots, ["k1", "k2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *own)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=2)
