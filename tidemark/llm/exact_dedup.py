"""Operator 5: exact deduplication by skew-safe combining.

Equal texts meet in three steps, and every step groups by the digest *and* the whole text, so that a digest collision never merges
different texts:

1. locally: the partial aggregation of step 2 keeps one row per text and task before anything is shuffled;
2. salted: rows of one digest are dealt to `salts` groups by their task's number, each of which picks a winner;
3. globally: the winners of the salts, at most `salts` per text, are combined.

A digest of a third of all rows thus arrives as at most one row per task, in `salts` partitions, and then as `salts` rows.
What step 3 leaves of each text, without the text, is written to the shared folder. If no digest has two texts there, the digest stands for the text that every step has compared, and the groups
are joined to the rows by it (AQE splits that join where a digest is frequent); else by digest and text.

A winner is a row with the smallest id. Only where ids repeat, which a look at the ids alone tells, rows that repeat id and text are numbered, salted too, and one is chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, settle, table

# Runs other than one space: the replacement gives the same text as replacing every run, with far fewer matches.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _RUN, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_bits: int = 256, carry: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts one row stays: the one with the smallest doc_id, and any one of several with that id. Null text counts as empty text; a null id is never the smallest unless
    the group has no other, and then keep_id is null and kept true for one row. Other columns of docs are ignored, but the one named carry is passed along. `digest_bits` under 256
    shortens the grouping digest (for tests of collisions); text_sha256 is always whole.
    """
    own = [F.col(carry)] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"), *own)
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    rows = rows.withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4))

    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    found = settle(winners.drop("norm"))
    clash = found.groupBy("digest").count().where("count > 1").limit(1).count() > 0
    if clash:
        joined = rows.join(settle(winners.where("group_size > 1")), ["digest", "norm"], "left")
    else:
        joined = rows.drop("norm").join(found.where("group_size > 1"), "digest", "left")
    alone = F.col("group_size").isNull()
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *([carry] if carry else [])]
    joined = joined.withColumn("kept", alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")))
    joined = joined.withColumn("alone", alone).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count() == 0:
        return joined.select(*out)
    # ids repeat, and perhaps with their text: of each text's rows with the smallest id one is chosen, first in each of the salts, then among these
    text = ["digest", "text_sha256"]
    numbered = joined.where("kept AND NOT alone").withColumn("salt", F.spark_partition_id() % salts)
    tied = settle(numbered.select(*out, "digest", "salt", F.row_number().over(Window.partitionBy(*text, "salt").orderBy("salt")).alias("i")))
    first = tied.where("i = 1").groupBy(*text).agg(F.min("salt").alias("first"))
    chosen = tied.join(first, text).withColumn("kept", (F.col("i") == 1) & (F.col("salt") == F.col("first")))
    return joined.where("NOT kept OR alone").select(*out).unionByName(chosen.select(*out))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
