"""Operator 6: mixing sources to target weights by entropy balancing. DataFrame functions only.

Rates: every document gets the rate r = exp(lambda of its source), the smallest change from rate 1 in relative entropy of the tokens under the
constraint that the source's sizes times its rates sum to its target. The convex dual, sum over sources of (size * exp(lambda) - target * lambda), is
solved by Newton iterations; each is one aggregation over the documents' current tilted sizes, per source in salted groups. Every document is in one constraint, so the
dual is separable and the iterations end at lambda = ln(target / size): the Newton steps are per source and need no joint system.

Rounding: rows that agree in id, text and source are one entry with a multiplicity, so that any number of equal rows is one member of a block; its copies are spread evenly over
them. Each source is dealt into blocks of about `block` entries by a hash of id and text (rows that share an id, or have none, are dealt apart). Only ids, sizes and hashes are dealt; what is
carried along is joined to the decisions at the end (a merge join by key, or a broadcast where Spark finds the decisions small). In a block, documents are taken by descending size, and each gets the
number of copies that brings the words taken so far closest to the sum of rate * size so far, so that smaller documents make up for what larger ones leave.
Documents of over an eighth of an average block's words, at most eight a block, are dealt first, in blocks of their own. What they leave or take too much is spread over
the source's other documents, whose rate becomes (target - words taken) / their words, so that no block has to absorb a document larger than itself.
A block thus ends about half its smallest document away from its share, and no task holds more than a block. Only a source whose other documents are too few to make up
(their rate ends at 0 or at the cap) stays further from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, settle, table

# Weights of the sources in code point order, repeating; share of all sizes; most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0

LARGE = 8  # documents of over 1 / LARGE of an average block's words are dealt first

CHUNK = 4096  # equal rows that one task writes out at a time

_COPIES = "CASE WHEN m.size = 0 THEN 0L ELSE cast(greatest(0D, least({cap}D * m.many, round((a.left + pace * (m.size * m.many)) / m.size))) AS bigint) END"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target): weights by source order, shared out up to cap times the source's size.

    Sources, not documents, are ordered here. With theta the level at which no source is above its cap, target = min(cap * size, theta * weight); sources are
    capped in ascending order of cap * size / weight, so theta follows from running sums over that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = share * F.sum("source_size").over(Window.partitionBy())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", w).withColumn("total", total).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn(
        "left", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level if this source and all after it are below their caps; from the first one for which it holds on, it only sinks
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", salts: int = 32, block: int = 256, rounds: int = 100, carry: str | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, rate, copies, taken; and the column named carry, which is passed along.

    size: words of the text (null: 0). taken = copies * size with copies from 0 to cap. Null is a source of its own, after the others. A source whose sizes are all 0
    has target 0 and its documents no copies. rate is the dual's, before rounding. cap is a whole number (an error otherwise), since copies are. Repeated rows count one by one: rows that agree in
    id, text, source and carry get copies that differ by one at most, and which of them get one more is open. Reruns give the same rows. Other columns are ignored.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("documents are taken in whole copies: cap must be a whole number from 1 on")
    keyed = docs.select(
        F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col).cast("string")).alias("spot"), F.col(id_col).alias("doc_id"),
        *([F.struct(F.xxhash64(carry).alias("a"), F.xxhash64(F.lit(1), carry).alias("b")).alias("mark"), F.col(carry)] if carry else []),
    )
    keys = ["source", "size", "spot", "doc_id", *(["mark"] if carry else [])]
    rows = settle(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("many")))
    parts = settle(
        rows.groupBy("source", F.pmod("spot", F.lit(salts)).alias("salt")).agg(F.sum(F.col("size") * F.col("many")).alias("tokens"), F.count(F.lit(1)).alias("n"))
    )
    sizes = parts.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    goal = settle(targets(sizes, weights, share, cap))

    # Newton on the dual, one lambda per source. The gradient needs the tilted tokens of the source's documents, and the Hessian is the same sum;
    # documents of a source share their tilt, so the pre-aggregated salted groups carry the sum.
    dual = goal.select(F.col("source").alias("s"), "source_size", "target", F.lit(0.0).alias("lambda"))
    old = None
    for _ in range(rounds):
        tilted = parts.join(dual, parts["source"].eqNullSafe(dual["s"])).groupBy("s", "source_size", "target", "lambda").agg(
            # whole numbers are summed first, so that the sum is the same in any order
            (F.sum("tokens") * F.exp("lambda")).alias("tilt")
        )
        step = settle(
            tilted.select(
                "s", "source_size", "target",
                F.when(F.col("target") > 0, F.col("lambda") - (F.col("tilt") - F.col("target")) / F.nullif("tilt", F.lit(0.0))).otherwise(F.lit(0.0)).alias("lambda"),
                F.when(F.col("target") > 0, F.abs(F.col("tilt") - F.col("target")) / F.nullif("target", F.lit(0.0))).otherwise(F.lit(0.0)).alias("gap"),
            )
        )
        if old is not None:
            discard(old)
        old, dual = step, step.drop("gap")
        if (step.agg(F.max("gap")).first()[0] or 0.0) < 1e-12:
            break
    rate = F.when(F.col("target") > 0, F.least(F.exp("lambda"), F.lit(float(cap)))).otherwise(F.lit(0.0))

    # Rounding: the large documents first, then the others at the pace that makes up for them.
    blocks = F.ceil(F.sum("n") / block)
    plan = parts.groupBy(F.col("source").alias("ps")).agg(blocks.alias("blocks"))
    plan = settle(
        plan.join(dual, plan["ps"].eqNullSafe(dual["s"])).select("ps", "blocks", "source_size", "target", rate.alias("rate"), (F.col("source_size") / F.col("blocks") / LARGE).alias("limit"))
    )
    weight = F.col("size") * F.col("many")
    planned = rows.join(plan.withColumnRenamed("blocks", "all_blocks"), rows["source"].eqNullSafe(plan["ps"]))
    large, small = planned.where(weight > F.col("limit")), planned.where(weight <= F.col("limit"))
    heavy = settle(large.groupBy(F.col("source").alias("hs")).agg(F.sum(weight).alias("heavy"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    kept = [*keys, "many", "source_size", "target", "rate", "blocks", "pace"]
    first = settle(_deal(large.join(heavy, large["source"].eqNullSafe(heavy["hs"])).withColumn("pace", F.col("rate")).select(*kept), cap))
    used = first.groupBy(F.col("source").alias("us")).agg(F.sum(F.col("all_copies") * F.col("size")).alias("used"))
    used = heavy.join(used, heavy["hs"].eqNullSafe(used["us"]))
    rest = plan.join(used, plan["ps"].eqNullSafe(used["hs"]), "left").select(
        F.col("ps").alias("rs"), plan["blocks"],
        F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.coalesce((F.col("target") - F.coalesce("used", F.lit(0))) / F.nullif(F.col("source_size") - F.coalesce("heavy", F.lit(0)), F.lit(0)), F.lit(0.0)))).alias("pace"),
    )
    rest = settle(rest)
    dealt = settle(first.unionByName(_deal(small.join(rest, small["source"].eqNullSafe(rest["rs"])).select(*kept), cap)))
    for t in (rows, parts, goal, old, plan, heavy, first, rest):
        if t is not None:
            discard(t)
    out = ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", *([carry] if carry else [])]
    if not carry:
        return _written_out(dealt).select(*out)
    d = dealt.select(*[F.col(k).alias(f"d_{k}") for k in keys], "many", "source_size", "target", "rate", "all_copies")
    same = F.lit(True)
    for k in keys:
        same = same & keyed[k].eqNullSafe(d[f"d_{k}"])
    even = F.col("all_copies") % F.col("many") == 0
    share_ = (F.col("all_copies") / F.col("many")).cast("long")
    result = keyed.join(d.where(even), same).withColumn("copies", share_).withColumn("taken", share_ * F.col("size")).select(*out)
    if dealt.where(~even).limit(1).count():
        # equal rows of which some get one copy more: one of them stands for all
        uneven = keyed.join(d.where(~even), same).groupBy(*keys, "many", "source_size", "target", "rate", "all_copies").agg(F.any_value(carry).alias(carry))
        result = result.unionByName(_written_out(uneven).select(*out))
    return result


def _deal(rows: DataFrame, cap: float) -> DataFrame:
    """rows (source, size, spot, doc_id, many, blocks, pace and others) with all_copies, the copies of an entry's equal rows together: per block by descending size, what is left is carried to the next entry."""
    others = [c for c in rows.columns if c not in ("source", "size", "spot", "doc_id", "blocks", "pace")]
    grouped = rows.withColumn("block", F.pmod(F.shiftright("spot", 8), F.col("blocks"))).groupBy("source", "block", "pace").agg(
        F.sort_array(F.collect_list(F.struct("size", "spot", "doc_id", *others)), asc=False).alias("members")
    )
    some = _COPIES.format(cap=int(cap))
    copies = F.expr(
        f"""aggregate(members, named_struct('left', 0D, 'made', cast(array() as array<bigint>)), (a, m) ->
              named_struct('left', a.left + pace * (m.size * m.many) - m.size * {some}, 'made', concat(a.made, array({some}))), a -> a.made)"""
    )
    out = grouped.withColumn("copies", copies).select("source", F.explode(F.arrays_zip("members", "copies")).alias("m"))
    return out.select("source", *[f"m.members.{c}" for c in ("size", "spot", "doc_id", *others)], F.col("m.copies").alias("all_copies"))


def _written_out(entries: DataFrame) -> DataFrame:
    """Every entry as its `many` rows with copies and taken. Entries of over CHUNK rows are cut into pieces that are spread over the tasks first."""
    one = entries.where(F.col("many") <= CHUNK).withColumn("start", F.lit(0).cast("long"))
    more = entries.where(F.col("many") > CHUNK).withColumn("start", F.explode(F.expr(f"sequence(0L, many - 1, {CHUNK}L)"))).repartition("spot", "start")
    each = one.unionByName(more).withColumn("at", F.explode(F.expr(f"sequence(start, least(start + {CHUNK}L, many) - 1)")))
    copies = F.expr("all_copies div many + CASE WHEN at < all_copies % many THEN 1L ELSE 0L END")
    return each.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
