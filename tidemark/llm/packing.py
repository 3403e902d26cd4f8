"""Operator 13: pieces of documents packed into as few sequences as the search finds, by bin completion.

A document longer than a sequence is cut from its end into whole sequences, so that only its first piece is shorter; whole ones are sequences by themselves.
How the shorter pieces combine depends only on how many there are of each length, capacity - 1 numbers whatever the table's size. These reach the driver; the
search there makes a plan (a filling, how often it is used, and which pieces of each length it takes), and Spark deals the pieces by it: they are numbered within their length, in
lanes so that a frequent length is no single group, and meet the plan in a broadcast join by length.

Search (`plan_fillings`): branch and bound over the counts. A node takes the largest length left and tries the undominated fillings of a sequence that holds it, least waste
first; a filling is used as often as its pieces last. Remaining pieces are also packed by best fit decreasing, at the root and every few nodes, and the best total so far is the incumbent. A
branch ends where its sequences and the waste bound (tokens left, and large pieces that can't share) reach the incumbent's number; the search ends when the root's bound is met or its
budget of nodes is used up, since the problem has no fast exact solution. Results are whole in any case; `plan_fillings` returns the bound beside the plan.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table
from .words import counting

CAPACITY = 1024
END = 2
NODES, WIDTH, STEPS = 1500, 2, 150  # budget of the search: nodes, fillings tried at a node, and steps to find them
LOOK = 64  # nodes from one best-fit incumbent to the next
LANE = 1 << 16  # pieces of a lane, about
BATCH_BYTES = 1 << 23
KNOWN = 1 << 20  # units kept with their ids in a task
JOINED = 2000  # units encoded as one text

# Classes of bytes: 0 space or newline, which begins a unit unless it stands before one of 0 and 1; 1 other white space, and lead bytes of white space beyond ASCII; 2 anything else; 3 letters; 4 marks, but the apostrophe.
_CLASS = bytearray(b"\2" * 256)
for _kind, _of in enumerate((b" \n", bytes([0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]), b"", string.ascii_letters.encode(), string.punctuation.replace("'", "").encode())):
    for _byte in _of:
        _CLASS[_byte] = _kind


def _classes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(_CLASS), np.uint8)


class _Numbers(dict):
    """Numbers units as they come."""

    def __missing__(self, unit: bytes) -> int:
        n = self[unit] = len(self)
        return n


class Encoder:
    """Token ids of texts by a tokenizers file, without special tokens added.

    With `units`, the tokenizer must be a byte-level BPE that cuts texts as its own pattern (GPT-2's) does. That pattern never joins what stands before a space or newline to it if
    a visible character follows it, nor a letter to a mark that isn't an apostrophe, and BPE never joins what the pattern cuts. So texts are cut before such spaces and newlines, and
    between a letter and the marks after it, so that a word is one unit whatever ends it. Every distinct unit of a task is encoded once (many in one text, whose ids are dealt back by
    their bytes), and the ids of a text are those of its units. Texts that hold an added token's string are encoded whole.
    """

    def __init__(self, path: str, units: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.units = units and not any(c.isspace() for t in self.added for c in t)  # units in one text could make such a token
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.ends = _Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def _learn(self, fresh: list[bytes]) -> None:
        """Encodes units: those that begin with a space or newline and a visible character in texts of many, the others one by one."""
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        starts, kind = np.cumsum(lengths) - lengths, _classes(b"".join(fresh) + b" ")
        lead = (kind[starts] == 0) & (kind[np.minimum(starts + 1, len(kind) - 1)] > 1) & (lengths > 1)
        spaced = [u for u, ok in zip(fresh, lead, strict=True) if ok]
        size = np.zeros(len(fresh), np.int64)
        many, _ = self._whole([b"".join(spaced[i : i + JOINED]).decode() for i in range(0, len(spaced), JOINED)])
        to = np.searchsorted(np.cumsum(self.bytes[many]), np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))) + 1
        size[lead] = np.diff(to, prepend=0)
        single, size[~lead] = self._whole([u.decode() for u, ok in zip(fresh, lead, strict=True) if not ok])
        ids = np.empty(len(many) + len(single), np.uint32)
        from_many = np.repeat(lead, size)
        ids[from_many], ids[~from_many] = many, single
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, how many each text has) of a string column without nulls."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.units or any(pc.any(pc.match_substring(column, t)).as_py() for t in self.added):
            return self._whole(column.to_pylist())
        if len(self.numbers) > KNOWN:
            self._forget()
        _, raw, text = column.buffers()
        offsets = np.frombuffer(raw, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]] if text is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        begins, kind = np.zeros(len(data) + 1, bool), _classes(data.tobytes())
        begins[: len(data) - 1] = (kind[:-1] == 0) & (kind[1:] > 1)
        begins[1 : len(data) - 1] |= (kind[:-2] == 3) & (kind[1:-1] == 4) & ((kind[2:] == 0) | (data[2:] == data[1:-1]))
        begins[offsets[1:] - 1] = False  # the last byte of a text, or of one before empty texts
        begins[offsets] = True
        starts = np.flatnonzero(begins).astype(np.int32)  # ends with the end of the data
        units = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        before = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, units.dictionary.to_pylist()), np.int64, len(units.dictionary))
        self._learn(list(islice(reversed(self.numbers), len(self.numbers) - before))[::-1])
        w = number[units.indices.to_numpy()]
        first = self.ends[w]
        n = self.ends[w + 1] - first
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((first - upto[:-1]).astype(np.int32), n)
        at += np.arange(upto[-1], dtype=np.int32)
        return self.ids[at], np.diff(upto[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def _encoder(path: str, units: bool) -> Encoder:
    return Encoder(path, units)


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, piece, start, length) for rows of so many ids: whole sequences from the end, the first piece holds the rest. No ids, no piece."""
    many = -(-sizes // capacity)
    row, piece = np.repeat(np.arange(len(sizes)), many), counting(many)
    first = (sizes[row] - 1) % capacity + 1
    return row, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def _pieces(path: str, units: bool, capacity: int, end: int | None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path, units)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            upto = pc.cumulative_sum(pc.binary_length(text).cast(pa.int64())).to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH_BYTES, "right")))
                ids, sizes = encode(text.slice(lo, hi - lo))
                if end is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end)
                    sizes = sizes + 1
                row, piece, start, length = cuts(sizes, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)])
                flat = ids.astype("<u4")
                bytes_of = memoryview(flat).cast("B")
                crc = [zlib.crc32(bytes_of[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )
                lo = hi

    return emit


Filling = tuple[tuple[int, int], ...]  # (length, how many) by falling length


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences. For each limit k up to half: pieces over capacity - k share with none of k or more, other pieces over half with none of their kind, and the rest from k on fills what room these leave."""
    pieces = np.zeros(capacity + 2, np.int64)
    pieces[list(counts)] = list(counts.values())
    upto = np.cumsum(pieces)
    tokens = np.cumsum(pieces * np.arange(capacity + 2))
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = upto[-1] - upto[capacity - k]
    pairs = upto[capacity - k] - upto[half]
    room = pairs * capacity - (tokens[capacity - k] - tokens[half])
    small = tokens[half] - np.where(k > 0, tokens[np.maximum(k - 1, 0)], 0)
    return int((alone + pairs + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing over counts: equal pieces are placed together, a piece goes to the fullest sequence that has room. (filling, how often) in all."""
    room: dict[int, dict[Filling, int]] = {}  # by room left
    for n in sorted(counts, reverse=True):
        left = counts[n]
        for r in sorted(r for r in room if r >= n):
            if not left:
                break
            for filling in list(room[r]):
                have, each = room[r][filling], r // n
                full = min(have, left // each)
                for used, m in ((full, each), (min(1, have - full), min(each, left - full * each))):
                    if used and m:
                        room[r][filling] -= used
                        left -= used * m
                        to = room.setdefault(r - m * n, {})
                        made = (*filling, (n, m))
                        to[made] = to.get(made, 0) + used
                if not room[r][filling]:
                    del room[r][filling]
                if not left:
                    break
        each = capacity // n
        for used, m in ((left // each, each), (1, left % each)):
            if used and m:
                to = room.setdefault(capacity - m * n, {})
                made = ((n, m),)
                to[made] = to.get(made, 0) + used
    return [(f, used) for group in room.values() for f, used in group.items() if used]


def fillings(counts: dict[int, int], capacity: int, width: int, steps: int, most_waste: int) -> list[Filling]:
    """Undominated fillings around the largest piece with at most most_waste left, least waste first, then fewest pieces: the first `width` found within `steps`.

    Dominated, and so left out: another piece would fit; a piece could be exchanged for a larger one; two could be exchanged for one as large or larger.
    """
    lengths = sorted(counts)
    top = lengths[-1]
    found: set[tuple[int, int, Filling]] = set()
    exact = 0

    def undominated(chosen: dict[int, int], waste: int) -> bool:
        free = [n for n in lengths if counts[n] > chosen.get(n, 0)]
        if free and free[0] <= waste:
            return False
        rest = [n for n, c in chosen.items() for _ in range(min(c - (n == top), 2))]
        sums = {a + b - 1 for i, a in enumerate(rest) for b in rest[:i]}
        for n in {*rest, *sums}:
            at = bisect_right(free, n)
            if at < len(free) and free[at] <= n + (n in sums) + waste:
                return False
        return True

    def extend(at: int, left: int, chosen: dict[int, int]) -> None:
        nonlocal steps, exact
        steps -= 1
        closed = True
        for i in range(min(at, bisect_right(lengths, left) - 1), -1, -1):
            if steps < 0 or exact >= width:
                return
            n = lengths[i]
            if counts[n] > chosen.get(n, 0):
                closed = False
                extend(i, left - n, chosen | {n: chosen.get(n, 0) + 1})
        if closed and left <= most_waste and undominated(chosen, left):
            found.add((left, sum(chosen.values()), tuple(sorted(chosen.items(), reverse=True))))
            exact += left == 0

    extend(len(lengths) - 1, capacity - top, {top: 1})
    return [f for _, _, f in sorted(found)[:width]]


def plan_fillings(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH, steps: int = STEPS) -> tuple[list[tuple[Filling, int]], int]:
    """(fillings and how often each is used, lower bound of the number of sequences) for counts of pieces by length."""
    counts = {n: c for n, c in counts.items() if c}
    bound = waste_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    most = sum(u for _, u in incumbent)
    plan: list[tuple[Filling, int]] = []
    # a node: pieces left, sequences used, and the fillings still to be tried; the fillings that lead to it are in plan
    stack = [(counts, 0, iter(fillings(counts, capacity, width, steps, (most - 1) * capacity - sum(n * c for n, c in counts.items()))))] if most > bound else []
    while stack and most > bound and nodes > 0:
        left, used, more = stack[-1]
        filling = next(more, None)
        if filling is None:
            stack.pop()
            plan[len(stack) - 1 :] = []
            continue
        plan[len(stack) - 1 :] = []
        times = min(left[n] // m for n, m in filling)
        after = {n: c for n, c in left.items() if c}
        for n, m in filling:
            after[n] -= times * m
        after, used = {n: c for n, c in after.items() if c}, used + times
        plan.append((filling, times))
        nodes -= 1
        if not after:
            if used < most:
                incumbent, most = list(plan), used
            continue
        if nodes % LOOK == 0 or sum(after.values()) < LOOK:
            rest = best_fit(after, capacity)
            if (total := used + sum(u for _, u in rest)) < most:
                incumbent, most = [*plan, *rest], total
        # what a better packing may waste in all, and so in its next sequence
        spare = (most - 1 - used) * capacity - sum(n * c for n, c in after.items())
        if spare >= 0 and used + waste_bound(after, capacity) < most:
            stack.append((after, used, iter(fillings(after, capacity, width, steps, spare))))
    return incumbent, bound


def plan_rows(plan: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, pieces a sequence, offset): pieces number from .. to - 1 of a length go to sequences from `first sequence` on."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for n, m in filling:
            at = taken.get(n, 0)
            out.append((n, at, at + times * m, sequence, m, offset))
            taken[n] = at + times * m
            offset += n * m
        sequence += times
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int | None = END, units: bool = True, nodes: int = NODES,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, ids (array), sequence_id, offset.

    Every row's ids are those of its whole text by the tokenizers file, then `end`; null counts as empty, so it is `end` alone (without `end`, no piece). Pieces lie in their
    sequence from offset 0 on without gaps. Rows that repeat an id are documents of their own; null ids are passed along; an empty table gives no rows. Sequence ids
    are 0, 1, ... where pieces share, and negative for pieces of full length. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    cut = docs.mapInArrow(_pieces(tokenizer, units, capacity, end), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids array<int>")
    pieces = settle(cut.withColumn("key", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_rows(plan_fillings(counts, capacity, nodes)[0]), "n long, first long, last long, sequence long, each long, place long")
    lanes = sum(counts.values()) // LANE + 64
    short = pieces.where(F.col("length") < capacity).select("key", "length", F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane"))
    held = short.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("length", "lane", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    numbered = short.withColumn("i", F.row_number().over(Window.partitionBy("length", "lane").orderBy("key")) - 1).join(base, ["length", "lane"])
    rank = F.col("base") + F.col("i")
    dealt = numbered.withColumn("rank", rank).join(F.broadcast(plan), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    placed = dealt.select(
        "key", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("place") + nth % F.col("each") * F.col("length")).cast("long").alias("offset")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(placed, "key").select(*names, "sequence_id", "offset").unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (all pieces one after the other), doc_ids and lengths of the pieces in order; at most `capacity` ids a row."""
    members = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select("sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids"), F.col("m.length").alias("lengths"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
