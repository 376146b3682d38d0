"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Shuffled rows that a task should get at most. A chain of windows keeps sorted copies of what its task reads.
ROWS_PER_TASK = 500_000


def plan_by_measure(spark: SparkSession, rows: int | None = None) -> None:
    """Plan joins and tasks by what is measured while a query runs, for tables of ``rows`` rows.

    A calendar makes thousands of rows out of one, which the planner's estimates don't see: few megabytes of events looked
    small enough to broadcast however many rows they gave. Broadcasts now need a measured size. Shuffles begin with as
    many partitions as the rows need, and small partitions are put together to a few megabytes, not to one for each core,
    so that the memory of a task doesn't grow with the table.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "4m")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    # Stored tables are packed: few megabytes hold millions of rows.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    if rows is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, -(-rows // ROWS_PER_TASK))))


def spread_keys(df: DataFrame, keys: Sequence[str], rows: int = 100) -> DataFrame:
    """Deal few rows that each make very many over partitions by ``keys``, ``rows`` of them or fewer to most tasks.

    The number is said explicitly, since adaptive execution would put such small rows into one task.
    """
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


def build_session(app: str = "stillwave", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here relies on.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the
    submit command names the master, and adaptive execution sizes the
    shuffles from the advisory partition size.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    plan_by_measure(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stillwave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is large or read more than once.

    Like a checkpoint it survives lost executors, but its columns are packed: runs of equal values take next to no room.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and forget its plan.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A
    folder of our own is only made when none is named and Spark runs in local
    mode (tests); a cluster without the setting is an error, since a machine
    local folder would not survive the loss of an executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stillwave-checkpoint-"))
    return df.checkpoint(eager=True)
