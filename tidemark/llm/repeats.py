"""Operators 3 and 7: removing passages that repeat across or within documents.

Both find *anchors*, runs of words at a few selected positions, such that any two equal windows share an equal anchor at the same offset. Anchors are sorted, and neighbours
are compared and extended:

* An anchor whose whole context (every window around it) an earlier anchor has too is settled there: all windows around it are repeats.
* Of the anchors left, one per context, those without a neighbour that could share a window end there.
* For the others, the windows that a neighbour may share are hashed to 128 bits, sorted, and compared; the later ones of equal windows are repeats.

Operator 3 (difference cover): anchors lie at positions p with p mod 13 in {0, 1, 3, 9}. Every residue modulo 13 is a difference of two members, so for any two starts there is an
offset under 13 at which both positions are in the cover; a window of `window` words holds an anchor of `window - 12` words at each of these offsets. Anchors are sorted by their words'
hash and then by that of their context (128 bits in all), which extends them by 12 words to both sides.

Operator 7 (sparse suffix array): anchors lie at minimisers, the positions whose run of words hashes smallest among its neighbours. Runs that occur once are dropped; of the others
the suffixes are retained, as the codes of the words that follow (as many as a window has) and of those before, nearest first. They are sorted by their words; each is compared with its neighbours word
by word: the common words to the right bound which windows it can share with any other suffix, since a neighbour shares the most; those to the left bound them too where only one
other suffix begins with the same run. Windows within these bounds are then checked by hash.

Sorting is by range over (words or hash, context, document, position): a passage that a third of all documents share is split over as many partitions as its rows need. What lies beyond
the ends of a partition counts as possibly equal: a needless candidate costs one look and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, settle, table
from .words import chunks, counting, inside, runs, signed, span_hashes

# A perfect difference cover; every residue modulo 13 is a difference of two members.
COVER_PERIOD = 13
COVER = (0, 1, 3, 9)

KEY = ["doc_id", "tk"]  # a document: its id, and a hash of its text for rows that share an id


def _cover_positions(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    width = window - COVER_PERIOD + 1
    at = inside(first, width)
    begin = np.repeat(first[:-1], np.diff(first))
    at = at[np.isin((at - begin[at]) % COVER_PERIOD, COVER)]
    return at, runs(hashes, width)[at]


def _minimiser_positions(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(4, window // 5)
    span = window - width + 1  # a window holds so many runs, and so at least one minimiser
    at = inside(first, width)
    all_runs = runs(hashes, width)
    if not len(at):
        return at, all_runs
    order = all_runs ^ np.uint64(0xA0761D6478BD642F)  # an order of its own, so that no word is favoured
    keep = np.zeros(len(all_runs), bool)
    counts = np.diff(first) - width + 1
    for row in np.flatnonzero(counts > 0):
        own = order[first[row] : first[row] + counts[row]]
        if len(own) >= span:
            view = np.lib.stride_tricks.sliding_window_view(own, span)
            keep[first[row] + np.unique(view.argmin(1) + np.arange(len(view)))] = True
    at = np.flatnonzero(keep)
    return at, all_runs[at]


_POSITIONS = {"cover": _cover_positions, "minimiser": _minimiser_positions}
_WIDTH = {"cover": lambda window: window - COVER_PERIOD + 1, "minimiser": lambda window: max(4, window // 5)}


def _context(first: np.ndarray, row: np.ndarray, at: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows around anchors at these positions begin and end, within their rows."""
    return np.maximum(first[row], at - (window - width)), np.minimum(first[row + 1], at + window)


def _anchors(kind: str, window: int):
    """Anchors of texts that hold a window: h (their words), with cover c too (their context)."""
    width = _WIDTH[kind](window)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, w in chunks(batch.column("text")):
                hashes = w.hashes()
                at, h = _POSITIONS[kind](hashes, w.first, window)
                row = np.searchsorted(w.first, at, "right") - 1
                enough = np.diff(w.first)[row] >= window
                at, h, row = at[enough], h[enough], row[enough]
                if not len(at):
                    continue
                lo, hi = _context(w.first, row, at, window, width)
                around = {"c": signed(span_hashes(w.hashes(1), lo, hi, 2) ^ ((at - lo) * 64 + hi - at).astype(np.uint64))} if kind == "cover" else {}
                own = {k: batch.column(k).take(pa.array(row + a)) for k in KEY}
                yield pa.RecordBatch.from_pydict({"h": signed(h), **around, **own, "pos": pa.array((at - w.first[row]).astype(np.int32))})

    return emit


def _same(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Per row whether it equals the row before in these columns (nulls are equal); False for the first."""
    same = np.ones(len(batch), bool)
    same[:1] = False
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, len(batch) - 1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return same


def _joined(before: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch if before is None else pa.concat_batches([before, batch])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those with an equal neighbour, and the first and last of the partition."""
    before = None  # the last row so far, whose right neighbour isn't known
    alike = True  # whether it has an equal left neighbour, or none in this partition
    for batch in batches:
        if not len(batch):
            continue
        t = _joined(before, batch)
        same = np.append(_same(t, ["h"]), False)
        same[0] = alike
        mask = (same[:-1] | same[1:])[:-1]
        if mask.any():
            yield t.slice(0, len(t) - 1).filter(pa.array(mask)).select([*KEY, "pos"])
        before, alike = t.slice(len(t) - 1), bool(same[-2])
    if before is not None:
        yield before.select([*KEY, "pos"])


def _suffixes(window: int, width: int):
    """Around each mark of a document the codes of the words that follow, and of those before, nearest first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text")):
                marks = batch.column("marks").slice(a, b - a)
                row = np.repeat(np.arange(b - a), marks.value_lengths().to_numpy())
                at = w.first[row] + marks.flatten().to_numpy().astype(np.int64)
                hashes = w.hashes()
                codes = (hashes >> np.uint64(32)).astype(">u4")
                lo, hi = _context(w.first, row, at, window, width)
                words = {
                    "suffix": _binary(codes[np.repeat(at, hi - at) + counting(hi - at)], hi - at),
                    "prefix": _binary(codes[np.repeat(at, at - lo) - 1 - counting(at - lo)], at - lo),
                }
                own = {k: batch.column(k).take(pa.array(row + a)) for k in KEY}
                yield pa.RecordBatch.from_pydict({**words, "c": signed(span_hashes(w.hashes(1), lo, hi, 2)), **own, "pos": pa.array((at - w.first[row]).astype(np.int32))})

    return emit


def _binary(codes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of n[k] codes as binary values."""
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * np.int32(4)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])


def common_words(column: pa.Array, at: np.ndarray, most: int) -> np.ndarray:
    """The number of leading codes that the values at[k] and at[k] - 1 have in common."""
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    codes = np.frombuffer(data, np.uint32, data.size // 4) if data is not None else np.zeros(0, np.uint32)
    n = np.minimum(np.diff(offsets)[at], np.diff(offsets)[at - 1])
    equal = np.zeros((len(at), most + 1), bool)
    step = np.arange(most)
    inside_both = step < n[:, None]
    where = np.nonzero(inside_both)
    equal[where] = codes[offsets[at][where[0]] + where[1]] == codes[offsets[at - 1][where[0]] + where[1]]
    return np.argmin(equal, axis=1)


def _near(kind: str, t: pa.RecordBatch, at: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the rows `at` may share with the row before: words to the right of the anchor's start, and to its left."""
    if kind == "minimiser":
        return common_words(t.column("suffix"), at, window), common_words(t.column("prefix"), at, window - width)
    return np.where(_same(t, ["h"])[at], window, 0), np.full(len(at), window - width)


def _decide(right: np.ndarray, left: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts 1 .. n - 3 of n in order, right and left being what each may share with the one before: the most words to the right and to the left shared with any other.

    A neighbour shares the most to the right. To the left only a single other context is known to bound it.
    """
    before, own, after, beyond = right[:-3], right[1:-2], right[2:-1], right[3:]
    lefts = np.full(len(own), window - width)
    lefts = np.where((own >= width) & (after < width) & (before < width), left[1:-2], lefts)
    lefts = np.where((after >= width) & (own < width) & (beyond < width), left[2:-1], lefts)
    return np.maximum(own, after), lefts


def _resolve(kind: str, window: int):
    """Of anchors sorted by words, context, document and position: per anchor the span of words that it settles (gone), or the starts lo .. hi of the windows to be checked."""
    width = _WIDTH[kind](window)
    same_words = ["h", "c"] if kind == "cover" else ["suffix", "prefix", "c"]

    def rows(t, at, lo, hi, gone):
        own = {k: t.column(k).take(pa.array(at)) for k in KEY}
        return pa.RecordBatch.from_pydict({**own, "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)), "gone": pa.array(np.full(len(at), gone))})

    def checked(own, right, left):
        """The windows to be checked of all contexts but the first one and the last two, which come again."""
        most_right, most_left = _decide(right, left, window, width)
        pos = own.column("pos").to_numpy().astype(np.int64)[1 : 1 + len(most_right)]
        lo, hi = pos - most_left, pos - (window - most_right)
        at = np.flatnonzero((most_right >= width) & (lo <= hi))
        return rows(own, at + 1, lo[at], hi[at], False) if len(at) else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = own = None
        opened = True  # whether the row before is its context's first row, or repeats it
        right = left = np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            t = _joined(before, batch)
            skip = 0 if before is None else 1
            start, again = ~_same(t, same_words), _same(t, [*KEY, "pos"])
            start[:skip] = False
            i = np.arange(len(t))
            last_start = np.maximum.accumulate(np.where(start, i, -1))
            last_other = np.maximum.accumulate(np.where(~start & ~again & (i >= skip), i, -1))
            first = start | (last_other < last_start) | ((last_start < 0) & (last_other < 0) & opened)
            first[:skip] = True
            at = np.flatnonzero(~first)
            if len(at):
                pos = t.column("pos").to_numpy().astype(np.int64)[at]
                yield rows(t, at, np.maximum(pos - (window - width), 0), pos + window, True)
            at = np.flatnonzero(start)
            if len(at):
                r, l = (np.full(len(at), x) for x in (window, window - width))
                known = at > 0
                r[known], l[known] = _near(kind, t, at[known], window, width)
                fresh = t.take(pa.array(at)).select([*KEY, "pos"])
                if own is None:  # a context before the first one, of which nothing is known
                    own, right, left = fresh.slice(0, 1), np.array([window]), np.array([window - width])
                own, right, left = pa.concat_batches([own, fresh]), np.append(right, r), np.append(left, l)
                out = checked(own, right, left)
                if out is not None:
                    yield out
                keep = max(len(own) - 3, 0)
                own, right, left = own.slice(keep), right[keep:], left[keep:]
            before, opened = t.slice(len(t) - 1), bool(first[-1])
        if own is not None:
            out = checked(pa.concat_batches([own, own.slice(0, 1), own.slice(0, 1)]), np.append(right, [window] * 2), np.append(left, [window - width] * 2))
            if out is not None:
                yield out

    return emit


def _windows(window: int):
    """The windows that start in the ranges to be checked, with 128 bits of their words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in chunks(batch.column("text")):
                part = batch.column("checked").slice(a, b - a)
                n = np.diff(w.first)
                row = np.repeat(np.arange(b - a), part.value_lengths().fill_null(0).to_numpy())
                lo, hi = (part.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
                lo, hi = np.maximum(lo, 0), np.minimum(hi, n[row] - window) + 1
                ok = hi > lo
                cover = np.zeros(w.n + 1, np.int32)
                np.add.at(cover, w.first[row[ok]] + lo[ok], 1)
                np.add.at(cover, w.first[row[ok]] + hi[ok], -1)
                at = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                if not len(at):
                    continue
                h = w.hashes()
                row = np.searchsorted(w.first, at, "right") - 1
                own = {k: batch.column(k).take(pa.array(row + a)) for k in KEY}
                yield pa.RecordBatch.from_pydict(
                    {"h1": signed(runs(h, window)[at]), "h2": signed(runs(w.hashes(1), window, 1)[at]), **own, "pos": pa.array((at - w.first[row]).astype(np.int32))}
                )

    return emit


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (hash, document, position): those after another one of their hash; edge 0 and 1: the partition's first and last.

    Repeated rows give the same window at the same place several times: it is not later than itself.
    """
    part = TaskContext.get().partitionId()
    before = None

    def out(batch, edge):
        n = len(batch)
        own = {k: batch.column(k) if edge is not None else pa.nulls(n, pa.int64()) for k in ("h1", "h2")}
        return pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in [*KEY, "pos"]}, "part": pa.array([part] * n, pa.int32()), "edge": pa.array([edge] * n, pa.int32()), **own})

    for batch in batches:
        if not len(batch):
            continue
        t = _joined(before, batch)
        later = _same(t, ["h1", "h2"]) & ~_same(t, [*KEY, "pos"])
        if before is None:
            yield out(t.slice(0, 1), 0)
        if later.any():
            yield out(t.filter(pa.array(later)), None)
        before = t.slice(len(t) - 1)
    if before is not None:
        yield out(before, 1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans that may overlap to spans that don't."""
    for batch in batches:
        column = batch.column("spans")
        held = column.value_lengths().to_numpy()
        first, stop = (column.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
        row = np.repeat(np.arange(len(held)), held)
        # running ends within a row: rows are set apart by more than any position
        apart = row * (int(stop.max(initial=0)) + 1)
        end = np.maximum.accumulate(stop + apart)
        fresh = np.ones(len(first), bool)
        fresh[1:] = ((first + apart)[1:] > end[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(first)) - 1 if len(begin) else begin
        merged = pa.StructArray.from_arrays([pa.array(first[begin].astype(np.int32)), pa.array((end[last] - apart[last]).astype(np.int32))], ["first", "stop"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=len(held)))]).astype(np.int32)
        yield pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in KEY}, "gone": pa.ListArray.from_arrays(pa.array(offsets), merged)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the words of removed spans."""
    for batch in batches:
        ids, texts, gone = batch.column("doc_id"), batch.column("text"), batch.column("gone")
        for a, b, w in chunks(texts):
            part = gone.slice(a, b - a)
            held = part.value_lengths().fill_null(0).to_numpy()
            n = np.diff(w.first)
            row = np.repeat(np.arange(b - a), held)
            lo, hi = (part.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            hi = np.minimum(hi, n[row])
            cover = np.zeros(w.n + 1, np.int32)
            np.add.at(cover, w.first[row] + lo, 1)
            np.add.at(cover, w.first[row] + hi, -1)
            kept = np.cumsum(cover)[:-1] <= 0
            removed = np.zeros(b - a, np.int64)
            digests, texts_out = [], []
            for i in range(b - a):
                own = np.flatnonzero(kept[w.first[i] : w.first[i + 1]]) + w.first[i]
                removed[i] = n[i] - len(own)
                text = b" ".join([w.data[s:e].tobytes() for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)])
                digests.append(hashlib.sha256(text).hexdigest())
                texts_out.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n), pa.array(removed), pa.array(digests, pa.string()), pa.array(texts_out, pa.string()), part],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"],
            )


_SPANS = "array<struct<first:int,stop:int>>"


def _on_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["tk"] == right["tk"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def repeated_spans(docs: DataFrame, window: int, kind: str) -> DataFrame:
    """(doc_id, tk, gone): per document the spans [first, stop) of word positions that windows with an earlier occurrence cover.

    docs: doc_id, tk, text. Rows that share id and text are one document.
    """
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tk long"
    order = [*KEY, "pos"]
    # marks and spans grow with the corpus, so the joins with texts are merge joins at every size
    if kind == "cover":
        anchors = docs.mapInArrow(_anchors(kind, window), f"h long, c long, {key}, pos int")
        compared = _sorted(anchors, "h", "c", *order)
        marks = None
    else:
        anchors = docs.mapInArrow(_anchors(kind, window), f"h long, {key}, pos int")
        marks = settle(_sorted(anchors, "h", *order).mapInArrow(_repeated, f"{key}, pos int").groupBy(*KEY).agg(F.array_sort(F.collect_set("pos")).alias("marks")))
        marked = docs.join(marks.hint("merge"), _on_key(docs, marks)).select(docs["doc_id"], docs["tk"], "text", "marks")
        suffixes = marked.mapInArrow(_suffixes(window, _WIDTH[kind](window)), f"suffix binary, prefix binary, c long, {key}, pos int")
        compared = _sorted(suffixes, "suffix", "prefix", "c", *order)
    span = F.struct(F.col("lo").alias("first"), F.col("hi").alias("stop"))
    found = settle(
        compared.mapInArrow(_resolve(kind, window), f"{key}, lo int, hi int, gone boolean")
        .groupBy(*KEY)
        .agg(F.collect_set(F.when(~F.col("gone"), span)).alias("checked"), F.array_sort(F.collect_set(F.when(F.col("gone"), span))).alias("spans"))
    )
    if marks is not None:
        discard(marks)
    some = found.where(F.size("checked") > 0)
    looked_at = docs.join(some.hint("merge"), _on_key(docs, some)).select(docs["doc_id"], docs["tk"], "text", "checked")
    later = settle(
        _sorted(looked_at.mapInArrow(_windows(window), f"h1 long, h2 long, {key}, pos int"), "h1", "h2", *order)
        .mapInArrow(_later, f"{key}, pos int, part int, edge int, h1 long, h2 long")
    )
    # The first row of a partition is a later start if the last row of the partition before has its hash: two rows a partition, in order.
    w = Window.orderBy("part", "edge")
    before = {c: F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("h1", "h2", *order)}
    edges = later.where("edge IS NOT NULL").select(*order, "edge", (before["h1"] & before["h2"] & ~(before["doc_id"] & before["tk"] & before["pos"])).alias("same"))
    starts = later.where("edge IS NULL").select(*order).unionByName(edges.where("edge = 0 AND same").select(*order))
    spans = found.select(*KEY, F.explode("spans").alias("s")).unionByName(starts.select(*KEY, F.struct(F.col("pos").alias("first"), (F.col("pos") + window).alias("stop")).alias("s")))
    out = settle(spans.groupBy(*KEY).agg(F.array_sort(F.collect_set("s")).alias("spans")).mapInArrow(_merge, f"{key}, gone {_SPANS}"))
    discard(found)
    discard(later)
    return out


def remove_repeats(docs: DataFrame, window: int = 20, kind: str = "cover", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word covered by a window of `window` words whose words also start earlier (smaller id, or same document and earlier start).

    Returns a row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space), kept_text, removed_spans (array of
    word positions first, stop; null if none). Windows are judged on the input. Null text and text without words: 0 words, nothing removed. A null id counts as
    the smallest. Rows that repeat id and text are one document and keep or lose the same words; rows that share an id (null is one) but not the text are documents of their own,
    in the order of their texts' hashes. Other columns are ignored. kind: cover (operator 3) or minimiser (operator 7).
    """
    if kind == "cover" and window < COVER_PERIOD + 3:
        raise ValueError(f"a difference cover of period {COVER_PERIOD} needs windows of {COVER_PERIOD + 3} words or more")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tk", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, window, kind)
    joined = docs.join(spans.hint("merge"), _on_key(docs, spans), "left").select(docs["doc_id"], "text", "gone")
    return joined.mapInArrow(_cut, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string, removed_spans {_SPANS}")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 20, "cover").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also start earlier, by the sparse suffix array."""
    return remove_repeats(table(spark, sf_dir, "documents"), 50, "minimiser").select("doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans")
