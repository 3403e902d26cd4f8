"""The corpus pipeline: quality classifier, exact dedup, near dedup, decontamination, mixing; every stage keeps whole documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, table
from tidemark.llm.decontam import without_leaks
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.quality import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    """The columns, and all of them as one, for operators that pass it along."""
    return docs.select(*COLUMNS, F.struct(*COLUMNS).alias("row"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns, and a key of id and text: rows that share both share every decision, rows that share an id alone (null is one too) share none."""
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    return docs.select(*COLUMNS, F.struct(F.col("doc_id"), text.alias("digest")).alias("key"))


def _drop(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't in keys."""
    own = keys.select(F.col("key.doc_id").alias("dropped_id"), F.col("key.digest").alias("dropped_digest")).distinct()
    same = (F.col("key.digest") == F.col("dropped_digest")) & F.col("key.doc_id").eqNullSafe(F.col("dropped_id"))
    return keyed.join(own, same, "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects, each by its own text; other rows of its id, null or not, stay."""
    scored = score_quality(_rows(docs), table(spark, sf_dir, "labels"), carry="row")
    return scored.where("predicted = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps one row: the one with the smallest id, or one of several with it. A null id stays only if no row of its text has an id."""
    return exact_dedup(_rows(docs), carry="row").where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (runs of five words, similarity 0.8 or more), keeps the one with the smallest id. Rows with a null id are linked with nothing and stay."""
    keyed = _keyed(docs)
    return _drop(keyed, near_dedup(keyed, width=5, percent=80, carry="key").where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that leak a test item, each by its own text; other rows of its id, null or not, stay."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with what the mix takes of each: copies, and the words that they hold."""
    return mix(_rows(docs), carry="row").select("row.*", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminate), ("mixing", mixed)]

#: The classifier, the near duplicates and the leaks have no SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
