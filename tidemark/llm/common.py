"""What the operators share: table access, settled intermediate tables, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_FOLDER = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own (tests); a cluster must name one."""
    folder = spark.conf.get(_FOLDER, None)
    if not folder:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError(f"{_FOLDER} must name a folder that driver and executors share")
        folder = _own_folders.get(context.applicationId) or _own_folders.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Writes df to a new Parquet folder in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the steps before the table. The shuffle files of this write go as soon as it ends,
    not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a settled table that no later step reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The connected components of links (a, b): one row (node, root) per node, root its smallest reachable node.

    Alternates large-star and small-star steps (each node's larger, then smaller, neighbours are tied to its smallest one), which turn any component
    into a star around its smallest node in a logarithmic number of rounds. Every step pre-aggregates per node and is settled, so that
    neither links nor components visit the driver; only the number and checksum of links do.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = None
    for _ in range(rounds):
        # large-star: every neighbour above u is tied to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        # small-star: u and every neighbour below it are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        old, edges = edges, settle(small)
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
