"""Operator 1: benchmark decontamination by a BM25 inverted index of test items, searched with block-max WAND.

Index: every test item is cut into units of at most `UNIT` words. A unit's impact of a term is its BM25 weight divided by the unit's own total, so the score of a
passage against a unit is the share of the unit's BM25 mass that the passage holds (1: all of it), and one threshold holds for all units. Posting lists are ordered by
unit and cut into blocks of `BLOCK` units; a list keeps its largest impact, a block of a list too.

Search: every passage of a training text (2 * UNIT words, a new one every UNIT words, so that any unit lies whole in one) is a query and gets all units that score the
threshold or more. Passages are processed in batches, each step for all of them at once:

1. WAND: terms are ordered by their lists' bounds. Passages whose bounds sum to less than the threshold end here; the low lists whose bounds
   together stay under a part of it (CLOSED) cannot bring up a unit alone, so only the other lists are opened.
2. Block maxima: the opened lists add up their block maxima per block, plus the bounds of the lists left closed. Blocks under the threshold are skipped.
3. In the blocks that are left, units are scored exactly.

Every pair found is verified on the whole text: the share of the item's runs of five words that the text holds, and those of its question and its answer.
The question ends at the first question mark, else at the first line break, else in the middle.

The index is broadcast in shards of about `shard_words` words, so that its size has a bound whatever the benchmark holds. Each shard reads the documents once; with several, each
one's result is written to the shared folder and its broadcast released before the next is built, so that one is alive at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle, table
from .words import Words, chunks, runs

UNIT = 64
BLOCK = 8
WIDTH = 5
K1, B = 1.2, 0.75
CLOSED = 0.3
DENSE = 1 << 25  # cells of a table up to which lookups go to a table and not to sorted keys


def _part_end(text: str) -> int:
    """Where the question ends (characters); 0: in the middle of the words."""
    for mark in ("?", "\n"):
        at = text.find(mark)
        if at > 0 and text[at + 1 :].strip() and text[:at].strip():
            return at + 1
    return 0


def _words(text: str) -> np.ndarray:
    data = pc.utf8_lower(text).as_py().encode("utf-8", "replace")
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), "alnum", False).hashes()


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ends = [], []
        for text in batch.column("text").to_pylist():
            h = _words(text)
            at = _part_end(text)
            words.append(h.view(np.int64))
            ends.append(len(_words(text[:at])) if at else len(h) // 2)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(ends, pa.int32()), pa.array(words, pa.list_(pa.int64()))], ["item_id", "question", "words"])


def _units(n: int) -> np.ndarray:
    """The unit of each of an item's n words: as few units as possible, of about equal size."""
    k = -(-n // UNIT)
    return np.arange(n) * k // max(n, 1)


@dataclass
class Index:
    """One shard. Terms are numbered by ascending list bound."""

    items: list  # item ids
    words: list  # per item its word hashes
    question: list  # per item the number of words of its question
    unit_item: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    term: np.ndarray  # of each entry of vocabulary
    bound: np.ndarray  # per term the largest impact
    block_at: np.ndarray  # per term where its blocks begin in block, block_max
    block: np.ndarray
    block_max: np.ndarray
    unit_at: np.ndarray  # per unit where its terms begin in unit_term, impact
    unit_term: np.ndarray
    impact: np.ndarray


def build(items: list, words: list[np.ndarray], question: list[int], frequency: dict[int, int], units: int, mean: float) -> Index:
    """frequency: units that hold a term, of `units` units of `mean` words in the whole benchmark."""
    owner, keys, lengths = [], [], []
    for i, h in enumerate(words):
        of = _units(len(h))
        for u in range(int(of[-1]) + 1 if len(of) else 0):
            keys.append(h[of == u])
            owner.append(i)
            lengths.append(len(keys[-1]))
    unit = np.repeat(np.arange(len(keys)), lengths)
    word = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    vocabulary, number = np.unique(word, return_inverse=True)
    pairs, tf = np.unique(unit * max(len(vocabulary), 1) + number, return_counts=True)
    unit, number = pairs // max(len(vocabulary), 1), pairs % max(len(vocabulary), 1)
    df = np.array([frequency[int(v)] for v in vocabulary], float)
    size = np.array(lengths, float)
    idf = np.log(1 + (units - df + 0.5) / (df + 0.5))
    impact = idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[unit] / max(mean, 1)))
    impact /= np.bincount(unit, impact, len(lengths))[unit]
    bound = np.zeros(len(vocabulary))
    np.maximum.at(bound, number, impact)
    order = np.argsort(bound, kind="stable")
    term = np.empty(len(order), np.int64)
    term[order] = np.arange(len(order))
    number = term[number]
    sort = np.lexsort((number, unit))
    unit_at = np.searchsorted(unit[sort], np.arange(len(lengths) + 1))
    blocks = len(lengths) // BLOCK + 1
    cell, where = np.unique(number * blocks + unit // BLOCK, return_inverse=True)
    block_max = np.zeros(len(cell))
    np.maximum.at(block_max, where, impact)
    return Index(
        items, words, question, np.array(owner, np.int64), vocabulary, term, bound[order], np.searchsorted(cell // blocks, np.arange(len(vocabulary) + 1)),
        cell % blocks, block_max, unit_at, number[sort], impact[sort],
    )


def _spread(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the ranges at[k] .. at[k + 1] of each k in which: (index into which, member)."""
    n = at[which + 1] - at[which]
    of = np.repeat(np.arange(len(which)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[which][of]


def search(index: Index, hashes: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit, score): all units that a passage of a row scores threshold or more against, each row and unit with its best score."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    V = len(index.vocabulary)
    if not V or not len(hashes):
        return none
    h = hashes.view(np.int64)
    at = np.minimum(np.searchsorted(index.vocabulary, h), V - 1)
    where = np.flatnonzero(index.vocabulary[at] == h)
    if not len(where):
        return none
    term = index.term[at[where]]
    row = np.searchsorted(first, where, "right") - 1
    n = np.diff(first)
    passages = np.maximum(1, -(-(n - UNIT) // UNIT))
    base = np.concatenate([[0], np.cumsum(passages)])
    k = (where - first[row]) // UNIT
    key = np.concatenate([(base[row] + k)[k < passages[row]] * V + term[k < passages[row]], (base[row] + k - 1)[k > 0] * V + term[k > 0]])
    held = None
    if base[-1] * V <= DENSE:
        held = np.zeros(base[-1] * V, bool)
        held[key] = True
        key = np.flatnonzero(held)
    else:
        key = np.unique(key)
    passage, term = key // V, key % V

    # WAND: bounds of the lists, ascending within a passage
    bound = index.bound[term]
    total = np.cumsum(bound)
    new = np.concatenate([[True], passage[1:] != passage[:-1]])
    begin = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    below = np.concatenate([[0.0], total])[begin]
    so_far = total - below[which]
    whole = so_far[np.append(begin[1:], len(key)) - 1]
    closed = so_far < threshold * CLOSED
    rest = np.zeros(len(begin))
    np.maximum.at(rest, which[closed], so_far[closed])
    opened = np.flatnonzero(~closed & (whole[which] >= threshold - 1e-9))
    if not len(opened):
        return none

    # block maxima
    of, cell = _spread(index.block_at, term[opened])
    blocks = len(index.unit_item) // BLOCK + 1
    live, most = which[opened][of] * blocks + index.block[cell], index.block_max[cell]
    if len(begin) * blocks <= DENSE:
        most = np.bincount(live, most, len(begin) * blocks).reshape(-1, blocks)
        live = np.flatnonzero((most + rest[:, None] >= threshold - 1e-9) & (most > 0))
    else:
        live, inverse = np.unique(live, return_inverse=True)
        live = live[np.bincount(inverse, most) + rest[live // blocks] >= threshold - 1e-9]
    if not len(live):
        return none

    # exact scores
    who, block = live // blocks, live % blocks
    edges = np.minimum(np.arange(blocks + 1) * BLOCK, len(index.unit_item))
    of, unit = _spread(edges, block)
    who = who[of]
    of, entry = _spread(index.unit_at, unit)
    want = passage[begin][who][of] * V + index.unit_term[entry]
    if held is not None:
        has = held[want]
    else:
        has = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want
    score = np.bincount(of, index.impact[entry] * has, len(unit))
    hit = np.flatnonzero(score >= threshold - 1e-9)
    row = np.searchsorted(base, passage[begin][who[hit]], "right") - 1
    pairs, inverse = np.unique(row * len(index.unit_item) + unit[hit], return_inverse=True)
    best = np.zeros(len(pairs))
    np.maximum.at(best, inverse, score[hit])
    return pairs // len(index.unit_item), pairs % len(index.unit_item), best


def overlap(text: np.ndarray, part: np.ndarray) -> float:
    """The share of the part's distinct runs of WIDTH words (of all its words, where it has fewer) that the text holds; 1 for an empty part."""
    if not len(part):
        return 1.0
    width = min(WIDTH, len(part))
    own = np.unique(runs(part.view(np.uint64), width))
    return float(np.isin(own, runs(text, width)).mean())


def _found(index: Index, texts: pa.Array, threshold: float, share: float, part_share: float) -> list[tuple]:
    """(row, item id, score, overlap, question's, answer's) of the verified leaks of a batch of texts."""
    out = []
    for a, _, w in chunks(pc.utf8_lower(texts.cast(pa.string())), "alnum"):
        h = w.hashes()
        row, unit, score = search(index, h, w.first, threshold)
        best: dict[tuple[int, int], float] = {}
        for r, u, s in zip(row.tolist(), unit.tolist(), score.tolist(), strict=True):
            pair = r, int(index.unit_item[u])
            best[pair] = max(s, best.get(pair, 0.0))
        for (r, i), s in best.items():
            text, item, q = h[w.first[r] : w.first[r + 1]], index.words[i], index.question[i]
            found = overlap(text, item), overlap(text, item[:q]), overlap(text, item[q:])
            if found[0] >= share and min(found[1:]) >= part_share:
                out.append((r + a, index.items[i], s, *found))
    return out


def _leaks(shared, *limits: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _found(shared.value, batch.column("text"), *limits)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                )

    return emit


def _clean(shared, *limits: float):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[row for row, *_ in _found(shared.value, batch.column("text"), *limits)]] = False
            yield batch.filter(pa.array(keep))

    return emit


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> Iterator[tuple[Index, bool]]:
    """The shards of the index, one at a time, and whether there are several."""
    items = (
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
        .where("text IS NOT NULL")
        .mapInArrow(_item_words, "item_id long, question int, words array<long>")
        .where(F.size("words") > 0)
    )
    n_units, size = F.ceil(F.size("words") / UNIT), F.size("words")
    units, words = items.agg(F.sum(n_units), F.sum(size)).first()
    if not units:
        return
    shards = -(-words // shard_words)
    items = items.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    # document frequencies over all units: a word's unit follows from its place
    placed = items.select(F.posexplode("words").alias("p", "h"), size.alias("n"), n_units.alias("k"), F.struct("item_id", "words").alias("it"))
    frequency = (
        placed.select("h", F.xxhash64("it", F.floor(F.col("p") * F.col("k") / F.col("n"))).alias("u")).distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    )
    if shards > 1:
        items, frequency = settle(items), settle(frequency)
    for shard in range(shards):
        own = items.where(F.col("shard") == shard)
        # a shard: about shard_words words and their frequencies
        rows = own.select("item_id", "question", "words").orderBy("item_id", "words").collect()
        df = {r["h"]: r["df"] for r in own.select(F.explode("words").alias("h")).distinct().join(frequency, "h").collect()}
        yield build([r["item_id"] for r in rows], [np.array(r["words"], np.int64) for r in rows], [r["question"] for r in rows], df, units, words / units), shards > 1
    if shards > 1:
        discard(items)
        discard(frequency)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, share: float = 0.8, part_share: float = 0.5, shard_words: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of docs and test item that it leaks: doc_id, item_id, score (BM25 share of the best unit), overlap, question_overlap, answer_overlap.

    A leak scores threshold or more in a passage, holds `share` of the item's runs of five words and `part_share` of its question's and its answer's. Words are runs of letters, digits
    and non-ASCII characters, lower-cased. Null and empty texts and items without words leak nothing; a null doc_id or item_id is carried along. Repeated rows count one by one, repeated
    items too. Item ids are integers. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for index, several in _indexes(benchmark, item_col, item_text_col, shard_words):
        shared = spark.sparkContext.broadcast(index)
        found = docs.mapInArrow(_leaks(shared, threshold, share, part_share), schema)
        if several:
            found = settle(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, share: float = 0.8, part_share: float = 0.5, shard_words: int = 500_000,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of docs, with all their columns, that leak no test item (see find_leaks). Each row is judged by its own text, in the task that reads it; nothing is shuffled."""
    names = docs.columns
    docs = docs.withColumn("text", F.col(text_col).cast("string")) if text_col != "text" or dict(docs.dtypes)["text"] != "string" else docs
    before = None
    for index, several in _indexes(benchmark, item_col, item_text_col, shard_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(_clean(shared, threshold, share, part_share), docs.schema)
        if several:
            docs = settle(docs)
            shared.destroy()
            if before is not None:
                discard(before)
            before = docs
    return docs.select(*names)


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
