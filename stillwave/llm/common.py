"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stillwave.session import cut_lineage

#: What separates words: the six ASCII white-space characters, as ``bytes.split()`` has them.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="stillwave-llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stash(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it survives lost executors and takes less room than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``key``: joins on the key read it without a shuffle."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table."""
    shared_folder(df.sparkSession)
    return cut_lineage(df)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8_000_000) -> None:
    """Let Arrow batches of this session have at most ``rows`` rows, and end soon after ``size`` bytes: whole texts or
    sets in batches of 10,000 rows take hundreds of MB beside the heap, in Spark and again in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def join_by_measure(spark: SparkSession) -> None:
    """Let joins of this session be broadcast only by a size measured while they run: estimates don't see the rows that
    an explode or a checkpoint brings, so tables of hundreds of MB looked small enough to be collected on the driver."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "4m")


def lean(run: Callable) -> Callable:
    """``run`` over Arrow batches; at its end the worker gives back what it has freed. Workers live on for a while after
    their tasks, and what they keep adds up beside those of the next stage."""
    def outer(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return outer


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph ``(a, b)``: ``(node, root)`` with the smallest node as root.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour until the edges are stars. Each round is two aggregations with a map-side combine, cut by a reliable
    checkpoint. Nodes of any comparable type; loops and repeated edges do no harm; no edges give no rows.
    """
    current = cut(edges.select("a", "b").where("a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        # Now every edge points from the larger node to the smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        current = cut(small.where("a <> b").distinct())
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
