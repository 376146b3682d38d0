"""Parquet tables in place of per-subject array files: read, write, metadata, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stillwave.functions.expressions import calibrate


def write_table(df: DataFrame, path: str, overwrite: bool = False, keys: Sequence[str] = ("subject",),
                idx: str | None = "idx", buckets: int = 256) -> None:
    """Save rows per subject, partitioned by a hash bucket and ordered inside files.

    With ``overwrite`` the bucket partitions that occur in ``df`` are
    replaced; without it, subjects already stored are kept as they are and
    only new ones are added. A directory per subject would not scale, so
    replacing goes bucket by bucket: stored subjects of a touched bucket that
    ``df`` does not bring are carried over.
    """
    spark = df.sparkSession
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    stored = _stored(spark, path)
    if stored is not None and overwrite:
        touched = rows.select("bucket").distinct()
        kept = stored.join(touched, "bucket", "left_semi").join(rows.select(*keys).distinct(), list(keys), "left_anti")
        from stillwave.session import cut_lineage
        rows = rows.unionByName(cut_lineage(kept))
    elif stored is not None:
        rows = rows.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    # The index range spreads a large subject over several tasks and files.
    spread = [F.col("bucket"), *[F.col(k) for k in keys]] + ([F.col(idx)] if idx else [])
    order = ["bucket", *keys] + ([idx] if idx else [])
    writer = rows.repartitionByRange(*spread).sortWithinPartitions(*order).write.partitionBy("bucket")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def read_table(spark: SparkSession, path: str, subject: object | None = None, start: int | None = None,
               stop: int | None = None, stride: int = 1, idx: str = "idx") -> DataFrame:
    """Rows of one or all subjects, ``[start, stop)`` with a stride; filters reach the scan."""
    from stillwave.operators.axes import slice_rows

    df = spark.read.parquet(path)
    if subject is not None:
        df = df.filter(F.col("subject") == subject)
    return slice_rows(df, start, stop, stride, idx).drop("bucket")


def load_signal(spark: SparkSession, path: str, weights: DataFrame | None = None) -> DataFrame:
    """A signal table, calibrated when weights are given."""
    df = spark.read.parquet(path).drop("bucket")
    return df if weights is None else calibrate(df, weights)


def load_epochs(spark: SparkSession, path: str, meta: DataFrame, epoch_sec: int) -> DataFrame:
    """Epoch counts with a time axis from the start texts in the metadata."""
    from stillwave.functions.expressions import parse_start
    from stillwave.operators.axes import regular_time

    get = lambda k: F.try_element_at("meta", F.lit(k))
    start = meta.select("subject", parse_start(get("Start Date"), get("Start Time"), get("Date Format")).alias("_start"))
    return spark.read.parquet(path).drop("bucket", "ts").join(start, "subject").withColumn(
        "ts", regular_time("_start", "epoch_idx", epoch_sec)).drop("_start")


def subjects(df: DataFrame) -> DataFrame:
    return df.select("subject").distinct()


def dataset_list(catalog: DataFrame) -> DataFrame:
    """Sorted dataset names per subject from ``(subject, dataset)``."""
    return catalog.groupBy("subject").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))


def merge_metadata(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("subject", "dataset")) -> DataFrame:
    """Metadata maps merged per key; a new value replaces an old one."""
    empty = F.create_map().cast("map<string,string>")
    joined = old.select(*keys, F.col("meta").alias("_old")).join(
        new.select(*keys, F.col("meta").alias("_new")), list(keys), "full")
    before, after = F.coalesce("_old", empty), F.coalesce("_new", empty)
    kept = F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k))
    return joined.select(*keys, F.map_concat(kept, after).alias("meta"))


def read_rows_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header)


def write_rows_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_pairs_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A wide result row as ``name,value`` lines."""
    keys = [c for c in df.columns if c not in columns]
    text = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    text.unpivot(keys, list(columns), "name", "value").write.mode("overwrite").csv(path)


EPISODE_SCHEMA = "counter int, start timestamp, stop timestamp, start_index long, stop_index long, label int"


def subject_from_path(path: str | Column = "_metadata.file_path", pattern: str = "[0-9]{8}") -> Column:
    """Subject out of the file name part of a path."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.regexp_extract(name, pattern, 0)


def read_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Episode files, one per subject, as one table."""
    return spark.read.csv(folder, schema=EPISODE_SCHEMA, header=True).withColumn("subject", subject_from_path())


def write_episodes(episodes: DataFrame, path: str) -> None:
    """Episodes as CSV, one folder per bucket of subjects."""
    columns = ["subject", "counter", "start", "stop", "start_index", "stop_index", "label"]
    episodes.select(*columns).write.mode("overwrite").option("header", True).csv(path)
