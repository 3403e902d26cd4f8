"""Operator 9: language by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of `dim` entries +1 or -1, drawn from a hash of its code point, so that no alphabet is given. An n-gram's
vector binds its letters' vectors: each is permuted (rotated) once per place that follows it, and they are multiplied. A text's vector bundles (sums) those of
its n-grams; a language's prototype bundles those of all its training texts. A text gets the language whose prototype has the largest cosine.

In a task, equal n-grams of a batch of texts are bound once, and bundling is the product of the batch's count matrix with their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .words import mix64

DIM = 1024
ORDER = 3
BATCH_BYTES = 1 << 18
PIECE = 4096  # n-grams bound at a time
_GAP = 32
MOST_LANGS = 2000  # languages that may be learned; with more, an error: none is left out


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Code point to its lower-case letter; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@lru_cache(maxsize=65536)
def _letter(code: int, dim: int) -> np.ndarray:
    words = mix64(np.arange(dim // 64, dtype=np.uint64) + np.uint64((code * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1))
    return (np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1).astype(np.int8)


def _bind(grams: np.ndarray, order: int, dim: int) -> np.ndarray:
    """The vectors of n-grams given as (n, order) code points."""
    out = np.ones((len(grams), dim), np.int8)
    for k in range(order):
        codes, where = np.unique(grams[:, k], return_inverse=True)
        out *= np.stack([np.roll(_letter(int(c), dim), order - 1 - k) for c in codes])[where]
    return out


class _Bound:
    """The vectors of n-grams bound so far in this process, up to MOST of them."""

    MOST = 32768

    def __init__(self, order: int, dim: int):
        self.order, self.dim = order, dim
        self.keys, self.vectors = np.zeros(0, np.uint64), np.zeros((0, dim), np.int8)

    def get(self, grams: np.ndarray) -> np.ndarray:
        key = np.zeros(len(grams), np.uint64)
        for k in range(self.order):
            key = (key << np.uint64(21)) | grams[:, k].astype(np.uint64)
        at = np.searchsorted(self.keys, key)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == key[known]
        out = np.empty((len(grams), self.dim), np.float32)
        out[known] = self.vectors[at[known]]
        if not known.all():
            fresh = _bind(grams[~known], self.order, self.dim)
            out[~known] = fresh
            if len(self.keys) + len(fresh) <= self.MOST:
                keys = np.concatenate([self.keys, key[~known]])
                sort = np.argsort(keys)
                self.keys, self.vectors = keys[sort], np.concatenate([self.vectors, fresh])[sort]
        return out


@lru_cache(maxsize=4)
def _bound(order: int, dim: int) -> _Bound:
    return _Bound(order, dim)


def _sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, every run of others as one gap, and where each text begins (one more at the end)."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _folded()[raw]
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    gap = code == 0
    keep = np.ones(len(code), bool)
    keep[1:] = ~(gap[1:] & gap[:-1] & (row[1:] == row[:-1]))
    code = np.where(gap, _GAP, code)[keep]
    return code, np.searchsorted(row[keep], np.arange(len(texts) + 1))


def bundle(texts: list[str], dim: int = DIM, order: int = ORDER, into: np.ndarray | None = None) -> np.ndarray:
    """(texts, dim): the sum of the n-gram vectors of each text, with a gap before and after it; zeros for a text without letters.

    into: numbers of bundles from 0 on, one per text, where several texts share a bundle.
    """
    into = np.arange(len(texts)) if into is None else into
    size = int(into.max()) + 1 if len(into) else 0
    # a gap in front, so that a first letter is known as one
    code, first = _sequences([" " + t for t in texts])
    out = np.zeros((size, dim), np.float32)
    if len(code) < order:
        return out
    used = np.zeros(0x110000, np.int32)
    used[code] = 1
    letters = np.flatnonzero(used)
    n = len(letters)
    used[letters] = np.arange(n)
    code = used[code]
    at = np.arange(len(code) - order + 1)
    row = np.repeat(np.arange(len(texts)), np.diff(first))[: len(at)]
    ok = at + order <= first[1:][row]
    gram = np.zeros(len(at), np.int64)
    for k in range(order):
        gram = gram * n + code[k : k + len(at)]
    gram, row = gram[ok], into[row[ok]]
    if n**order <= 1 << 21:
        present = np.bincount(gram, minlength=n**order) > 0
        kinds = np.flatnonzero(present)
        where = (np.cumsum(present) - 1)[gram]
    else:
        kinds, where = np.unique(gram, return_inverse=True)
    spelled = np.stack([letters[kinds // n ** (order - 1 - k) % n] for k in range(order)], 1)
    for lo in range(0, len(kinds), PIECE):
        hi = min(lo + PIECE, len(kinds))
        own = (where >= lo) & (where < hi)
        counts = np.bincount(row[own] * (hi - lo) + where[own] - lo, minlength=size * (hi - lo)).reshape(size, hi - lo)
        out += counts.astype(np.float32) @ _bound(order, dim).get(spelled[lo:hi])
    return out


def _portions(column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """(first row, last row + 1, texts, whether they have letters), by runs of rows of bounded size; texts without letters come as empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    row = 0
    ends = np.cumsum(size)
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BATCH_BYTES, "right")))
        texts = [t or "" for t in column.slice(row, stop - row).to_pylist()]
        letters = np.array([any(map(str.isalpha, t)) for t in texts])
        yield row, stop, [t if ok else "" for t, ok in zip(texts, letters, strict=True)], letters
        row = stop


def _learn(dim: int, order: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, texts, letters in _portions(batch.column("text")):
                kinds, into = np.unique(langs[a:b].astype(str), return_inverse=True)
                for lang, v in zip(kinds.tolist(), bundle(texts, dim, order, into), strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(s)], ["lang", "i", "v"])

    return emit


def prototypes(docs: DataFrame, dim: int = DIM, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """The languages of docs (text, lang) in order, and their unit prototypes: `dim` numbers per language are all that reaches the driver."""
    sums = docs.where("lang IS NOT NULL").mapInArrow(_learn(dim, order), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    known = [r["lang"] for r in docs.where("lang IS NOT NULL").select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(known) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages: prototypes are broadcast, and lang doesn't look like a language column")
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["v"]
    langs = sorted(found)
    m = np.stack([found[k] for k in langs]) if langs else np.zeros((0, dim))
    return langs, m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def _predict(shared, dim: int, order: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, m = shared.value
        m = m.T.astype(np.float32)
        for batch in batches:
            for a, b, texts, letters in _portions(batch.column("text")):
                v = bundle(texts, dim, order)
                v[~letters] = 0
                v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
                pred, score = np.array(["und"] * (b - a), object), np.zeros(b - a)
                if langs:
                    near = v @ m
                    best = near.argmax(1)
                    pred = np.where(letters, np.array(langs, object)[best], "und")
                    score = np.where(letters, np.clip(near[np.arange(b - a), best].astype(np.float64), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return emit


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, dim: int = DIM, order: int = ORDER
) -> DataFrame:
    """Per row of docs: doc_id, held_out (crc32 of the id as text modulo folds is held), lang_pred (a learned language), score (cosine, 0 to 1).

    Only rows that aren't held out and have a language are learned. A null text or one without letters is `und` with score 0, and so is every text if nothing could be
    learned. Texts of one letter have n-grams with gaps. Ties go to the language that is first in order. Repeated rows count one by one; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = prototypes(docs.where(crc_mod("doc_id", folds) != held).select("text", "lang"), dim, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(_predict(shared, dim, order), f"doc_id {id_type}, lang_pred string, score double")
        .select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
    )


def op9_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
