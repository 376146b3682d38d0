"""Incremental ingestion: files not seen before, each exactly once.

The batch jobs skip subjects that are already stored; a file stream with a
checkpoint does the same without reading what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stillwave.sources.epoch_csv import epoch_rows, parse_epoch_texts
from stillwave.sources.raw_archive import decode_recordings
from stillwave.sources.tables import subject_from_path

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_recordings(spark: SparkSession, folder: str, pattern: str = "*.gt3x", files_per_trigger: int = 1000) -> DataFrame:
    """Stream of decoded seconds of newly arrived recordings."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return decode_recordings(files.withColumn("subject", subject_from_path("path")))


def new_epoch_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of epoch rows of newly arrived epoch files."""
    from pyspark.sql import functions as F

    texts = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    named = texts.select(
        F.split(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), " ")[0].alias("subject"),
        F.col("value").alias("text"))
    return epoch_rows(parse_epoch_texts(named))


def append_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived, then stop."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
