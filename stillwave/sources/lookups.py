"""The fixed lookup tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillwave.functions.fixed_values import EXCLUDED_SUBJECTS, LABEL_CORRECTIONS, MERGED_EPISODES


def excluded_subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in EXCLUDED_SUBJECTS], "subject string")


def label_corrections(spark: SparkSession) -> DataFrame:
    rows = [(s, c) for s, counters in LABEL_CORRECTIONS.items() for c in counters]
    return spark.createDataFrame(rows, "subject string, counter int")


def merge_lookup(spark: SparkSession) -> DataFrame:
    rows = [(s, a, b) for s, (a, b) in MERGED_EPISODES.items()]
    return spark.createDataFrame(rows, "subject string, first_counter int, last_counter int")
