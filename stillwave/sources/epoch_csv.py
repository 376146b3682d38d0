"""Epoch count files: banner, labelled header lines, a dashed line, then counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stillwave.functions.fixed_values import EPOCH_HEADER_LABELS, EPOCH_LAYOUTS
from stillwave.operators.chunked import as_col

# Patterns of the banner line.
BANNER_PATTERNS = {
    "ActiLife Version": r"ActiLife v([0-9.]+)",
    "Actigraph Firmware": r"Firmware v([0-9.]+)",
    "Filter": r"Filter (.*) -+",
    "Date Format": r"date format (.*?) ",
}


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", F.trim(hit))


def header_map(text: str | Column) -> Column:
    """Banner values and labelled lines of the header block as a map."""
    block = as_col(text)
    entries = [F.struct(F.lit(k).alias("key"), _found(block, p).alias("value")) for k, p in BANNER_PATTERNS.items()]
    for label in EPOCH_HEADER_LABELS:
        quoted = label.replace("(", r"\(").replace(")", r"\)")
        entries.append(F.struct(F.lit(label).alias("key"), _found(block, rf"(?m)^{quoted}:? (.*)$").alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def parse_epoch_texts(files: DataFrame) -> DataFrame:
    """``(subject, text)`` of whole files -> ``(subject, meta, first, lines)``."""
    text = F.regexp_replace("text", "\r", "")
    cut = files.select("subject", text.alias("text")).select(
        "subject", F.regexp_extract("text", r"(?s)^(.*?)(?:^|\n)-+\n", 1).alias("head"),
        F.split(F.regexp_replace("text", r"(?s)^.*?(?:^|\n)-+\n", ""), "\n").alias("lines"))
    return cut.select("subject", header_map("head").alias("meta"), F.element_at("lines", 1).alias("first"), "lines")


def epoch_rows(parsed: DataFrame) -> DataFrame:
    """Counts per epoch; the first data line decides where the four count columns are."""
    offset, has_names = F.lit(0), F.lit(False)
    # The shortest name line last, so that a longer line with the same start is met first.
    for line, start in sorted(EPOCH_LAYOUTS.items(), key=lambda kv: len(kv[0])):
        matches = F.startswith(F.col("first"), F.lit(line))
        offset = F.when(matches, F.lit(start)).otherwise(offset)
        has_names = has_names | matches
    laid = parsed.select("subject", offset.alias("_o"), has_names.cast("int").alias("_h"), "lines")
    rows = laid.select("subject", "_o", "_h", F.posexplode("lines").alias("_p", "_line")).filter(
        (F.col("_p") >= F.col("_h")) & (F.trim("_line") != ""))
    parts = F.split("_line", r"[,\t]")
    value = lambda k: F.trim(F.get(parts, F.col("_o") + k)).cast("int")
    return rows.select(
        "subject", (F.col("_p") - F.col("_h")).cast("long").alias("epoch_idx"),
        value(0).alias("axis1"), value(1).alias("axis2"), value(2).alias("axis3"), value(3).alias("steps"))


def read_epoch_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(epochs, metadata)`` of a folder; the subject is the file name up to the first blank."""
    files = spark.read.text(folder, wholetext=True).select(
        F.split(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), " ")[0].alias("subject"),
        F.col("value").alias("text"))
    parsed = parse_epoch_texts(files)
    return epoch_rows(parsed), parsed.select("subject", F.lit("epoch").alias("dataset"), "meta")
