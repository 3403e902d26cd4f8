"""Operators 11 to 13 against brute force over whole tables, on awkward rows and on empty tables."""

import hashlib
import math
import zlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering, negatives, packing
from tidemark.llm.vectors import UNIT

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance long, v string, score long, key long"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2, "x", 3, 4) for i, v, y in rows], SCHEMA)


def awkward(n=300, dim=64, seed=3, hot=True):
    """Clustered vectors; a third of all rows alike, repeated rows, ties, null ids and labels, and vectors that don't take part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, np.round(centres[i % 5] + rng.normal(size=dim) * 0.3, 3).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    if hot:
        rows += [(n + i, rows[0][1], 0) for i in range(n // 2)]
    rows += [rows[3], rows[50], rows[50], (None, rows[1][1], 1), (None, rows[2][1], 2), (7000, rows[4][1], None), (7050, None, 1), (7100, [], 1), (7150, [1.0] * (dim - 1), 2)]
    rows += [(7200, [None] + [0.5] * (dim - 1), 1), (7250, [math.nan] + [0.5] * (dim - 1), 1), (7300, [math.inf] + [0.5] * (dim - 1), 1), (7350, [0.0] * dim, 3), (7400, [-0.0] * dim, 3)]
    return rows


def takes_part(v, dim=64):
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


# 11


def brute_kmeans(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v], v) for i, v, _ in rows if takes_part(v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    c = [v for _, v, _ in sorted(kept, key=lambda r: (mark(r[0]), r[2]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v, _ in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(o) for col in zip(*o)] if o else m for o, m in zip(own, c)]
    found = [(i, *near(v)[::-1]) for i, v, _ in kept]
    sums = {j: sum(d for _, m, d in found if m == j) for j in range(len(c))}
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


@pytest.mark.parametrize("n", [3, 300])
def test_clusters_match_brute_force(spark, n):
    rows = awkward(n) if n > 3 else [(i, [float(i)] * 64, 0) for i in range(n)]
    got = clustering.with_inertia(*clustering.cluster_vectors(table_of(spark, rows).repartition(5)))
    got = got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_kmeans(rows)))


def test_clusters_of_nothing_and_of_too_large_values(spark):
    assert clustering.with_inertia(*clustering.cluster_vectors(table_of(spark, []))).count() == 0
    assert clustering.cluster_vectors(table_of(spark, [(1, None, 1), (2, [1.0], 2)]))[0].count() == 0
    with pytest.raises(Exception, match="don't fit 64 bits"):
        clustering.cluster_vectors(table_of(spark, [(1, [2.0**21] * 64, 1)]))[0].collect()


@pytest.mark.parametrize("unit", [UNIT, 1e-3, 0.01])
def test_nearest_is_exact_with_ties(unit):
    """Large values, for which float32 products are inexact, centroids that differ by 1, and ties."""
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 22):
        c = rng.integers(-scale, scale, (12, 64))
        c[5], c[7], c[8] = c[2], c[2], c[3]
        c[8, 0] += 1
        x = np.concatenate([rng.integers(-scale, scale, (50, 64)), c, c + 1, (c[:-1] + c[1:]) // 2])
        exact = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (clustering.nearest(x, c, unit) == exact.argmin(1)).all()


# 12


def brute_negatives(rows, dim=64):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if y is not None and takes_part(v, dim)]
    last = lambda i: (i is None, i or 0)
    out, seen = [], set()
    for a, y, v in kept:
        if a is None or a % 50 or (a, y, tuple(v)) in seen:
            continue
        seen.add((a, y, tuple(v)))
        score = [(sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in kept]
        best = sorted([(s, i) for s, i, z in score if z == y and i != a], key=lambda r: (-r[0], last(r[1])))[:5]
        for p, i in best:
            fits = sorted([(s, j) for s, j, z in score if z != y and 50 * p <= 100 * s <= 95 * p], key=lambda r: (-r[0], last(r[1])))[:3]
            out += [(a, i, r, j, p, s) for r, (s, j) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("shard", [3, 100])
def test_negatives_match_brute_force(spark, shard, monkeypatch):
    rows = awkward(700)
    got = negatives.mine_hard_negatives(table_of(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, shard=shard).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_negatives(rows)))
    assert got


def test_negatives_of_nothing(spark):
    assert negatives.mine_hard_negatives(table_of(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    alone = table_of(spark, [(0, [1.0] * 64, 1), (1, [1.0] * 64, 2)])
    assert negatives.mine_hard_negatives(alone, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [10, 1 << 21])
def test_bounds_hold_and_discard(scale):
    """No pair's exact score is above its bound, close pairs included, and correlated components make most bounds useful."""
    rng = np.random.default_rng(4)
    basis = rng.normal(size=(6, 64))
    x = np.clip((rng.normal(size=(200, 6)) @ basis + rng.normal(size=(200, 64)) * 0.05) * scale / 10, -scale, scale).astype(np.int64)
    axes = np.linalg.eigh((x.astype(float).T @ x))[1][:, ::-1]
    slack = negatives.slack_of(negatives.LEAD[0] + 2, axes)
    r = negatives.Rotated(x, axes)
    bound = r.columns(slack, False) @ r.columns(slack, True).T
    exact = x @ x.T
    assert (bound.astype(np.float64) * (1 + 2.0**-22 * np.sign(bound)) >= exact).all()
    if scale > 10:
        assert (bound - exact).mean() < 0.05 * np.abs(exact).mean()


def test_best_keeps_ties_by_id():
    best = negatives.Best(2, 3)
    best.add(np.array([1, 1, 1, 0]), np.array([5, 7, 5, 1]), np.array([9, 3, 2, 4]))
    best.add(np.array([1, 1]), np.array([5, 5]), np.array([1, 2]))
    assert best.id[1].tolist() == [3, 1, 2] and best.score[1].tolist() == [7, 5, 5] and best.id[0, 0] == 4


# 13


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij'é!_9 "), rng.integers(1, 9)))
    long = " ".join(word() for _ in range(3000))
    odd = ["\x1c\x1d a\x0b\x0cb  \x85", "naïve ² ³ ¼ x² ª º µ", "<|endoftext|> a <|endoftext|>", "don't we'll I'D 's  's", "日本語 text ١٢٣ ⅷ", "a_b __ c-d \xa0\xa0 e\xad f", " \n\n  x \r\n", "🙂 é"]
    return [None, "", " ", "a", *odd, long, long, *[" ".join(word() for _ in range(int(n))) for n in rng.integers(1, 700, 60)]]


def test_ids_of_words_are_those_of_the_text():
    fast, whole = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path(), units=False)
    some = [t or "" for t in texts()]
    rng = np.random.default_rng(6)
    marks = ["a", "b'", "'s", " ", " ", "  ", "\n", "\t", "é", "\xa0", "\x85", "\u3000", "\u2003", "\x1c", "9", "²", ".", "語", "🙂", "_"]
    some += ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(3000)]
    for part in (some, [t for t in some if "<|" not in t], some[:1], [""], []):
        column = pa.array(["x ", *part], pa.string()).slice(1)
        for _ in range(2):
            a, b = fast(column), whole(column)
            assert (a[0] == b[0]).all() and a[1].tolist() == b[1].tolist()


def test_a_word_is_one_unit_whatever_ends_it():
    fast, whole = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path(), units=False)
    column = pa.array(["say word, then word. Then word... it's word### word; word\nword: a.b\nsay word!\n\nsay: x", "don't, 9. é, . word.\"\n"])
    assert (fast(column)[0] == whole(column)[0]).all()
    assert {u for u in fast.numbers if b"word" in u} == {b" word", b"\nword", b' word."\n'}
    assert {u for u in fast.numbers if b"say" in u} == {b"say", b"\nsay"}


def test_units_of_a_tokenizer_with_long_white_space(tmp_path):
    """Runs of white space are tokens here: what begins a text with one is never encoded behind what ends another."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    t = Tokenizer(models.BPE())
    t.pre_tokenizer, t.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    some = ["".join(p) for p in product(["  ", " \n", "\n\n", "    \n\n", "\t", "a", "b.", "..", "ab"], repeat=3)]
    t.train_from_iterator(some * 3, trainers.BpeTrainer(vocab_size=400, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    t.save(path := str(tmp_path / "t.json"))
    assert len(t.encode("    ").ids) < 4 and len(t.encode("\n\n").ids) == 1
    fast, whole = packing.Encoder(path), packing.Encoder(path, units=False)
    marks = ["a", "b'", "'s", " ", " ", "  ", "\n", "\n", "\t", "é", "\xa0", "\x1c", "9", ".", ".", ",", "_"]
    rng = np.random.default_rng(8)
    for part in (["x foo ", "  bar"], some, ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(5000)]):
        a, b = fast(pa.array(part)), whole(pa.array(part))
        assert a[1].tolist() == b[1].tolist() and (a[0] == b[0]).all()


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    some = texts()
    rows = [(i, x, 1, 2, 3) for i, x in enumerate(some)] + [(5, some[5], 1, 2, 3), (None, "null id", 1, 2, 3), (6, "another text of id 6", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, key long, sequence_id long")
    packed = packing.pack_documents(docs.repartition(3), tokenizer_path(), capacity=capacity)
    got = packed.collect()
    made = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"]) for r in got)
    want = []
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        for k, (s, e) in enumerate([(0, first), *((s, s + capacity) for s in range(first, len(ids), capacity))]):
            want.append((str(i), k, s, e - s, tuple(ids[s:e]), zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
    assert made == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by) <= -(-sum(r["length"] for r in got) // capacity) + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_packing_of_nothing_and_of_equal_rows(spark):
    schema = "doc_id long, text string"
    assert packing.pack_documents(spark.createDataFrame([], schema), tokenizer_path()).count() == 0
    same = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    packed = packing.pack_documents(same, tokenizer_path()).select("sequence_id", "offset")
    assert packed.distinct().count() == 20000 and packed.select("sequence_id").distinct().count() == -(-20000 // 256)


def optimum(pieces, capacity):
    """The least number of bins by trying every subset for the bin of the largest piece."""
    if not pieces:
        return 0
    rest = pieces[1:]
    best = len(pieces)
    for n in range(len(rest) + 1):
        for take in combinations(range(len(rest)), n):
            if pieces[0] + sum(rest[i] for i in take) <= capacity:
                best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in take], capacity))
    return best


def test_search_finds_the_optimum_of_small_tables():
    rng = np.random.default_rng(8)
    for _ in range(60):
        pieces = sorted(map(int, rng.integers(1, 30, rng.integers(1, 9))), reverse=True)
        counts = {n: pieces.count(n) for n in pieces}
        plan, bound = packing.plan_fillings(counts, 30)
        used = {}
        for filling, times in plan:
            assert times > 0 and sum(n * m for n, m in filling) <= 30
            for n, m in filling:
                used[n] = used.get(n, 0) + m * times
        assert used == counts
        assert bound <= optimum(pieces, 30) == sum(u for _, u in plan)


def test_search_beats_best_fit():
    """Best fit decreasing needs 4 sequences, 3 are enough."""
    counts = {10: 2, 9: 1, 8: 1, 7: 2, 5: 1, 2: 2}
    assert sum(u for _, u in packing.best_fit(counts, 20)) == 4
    assert sum(u for _, u in packing.plan_fillings(counts, 20)[0]) == 3
