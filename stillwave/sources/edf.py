"""EDF(+) files of the second device: header fields, channels, annotations.

The published layout: a fixed-width ASCII header of ``256 * (1 + signals)``
bytes, then data records with the 16-bit samples of each signal in turn.
Samples leave the decoder record by record in bounded batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stillwave.functions.fixed_values import MS2_TO_G

# Width of the header fields in file order.
FILE_FIELDS = {
    "version": 8, "patient": 80, "recording": 80, "start_date": 8, "start_time": 8, "header_bytes": 8,
    "reserved": 44, "records": 8, "record_seconds": 8, "signals": 4,
}
CHANNEL_FIELDS = {
    "label": 16, "transducer": 80, "dimension": 8, "physical_min": 8, "physical_max": 8, "digital_min": 8,
    "digital_max": 8, "prefilter": 80, "samples": 8, "reserved": 32,
}
ANNOTATIONS = "EDF Annotations"
REQUIRED_CHANNELS = ("ECG0", "X", "Y", "Z", "Estimated HR")

SAMPLE_SCHEMA = "subject string, channel string, first_idx bigint, values array<float>"
BATCH_VALUES = 65_536


def parse_header(content: bytes) -> tuple[dict, list[dict]]:
    """File fields and one dictionary per channel."""
    def cut(fields: Mapping[str, int], start: int, times: int = 1) -> tuple[dict, int]:
        out = {}
        for name, width in fields.items():
            out[name] = [content[start + i * width:start + (i + 1) * width].decode("ascii", "replace").strip() for i in range(times)]
            start += width * times
        return out, start

    head, start = cut(FILE_FIELDS, 0)
    head = {k: v[0] for k, v in head.items()}
    columns, _ = cut(CHANNEL_FIELDS, start, int(head["signals"]))
    return head, [{k: v[i] for k, v in columns.items()} for i in range(int(head["signals"]))]


def _layout(content: bytes):
    head, channels = parse_header(content)
    sizes = [int(c["samples"]) for c in channels]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    begin = int(head["header_bytes"])
    count = (len(content) - begin) // (2 * int(offsets[-1]))
    if int(head["records"]) >= 0:
        count = min(count, int(head["records"]))
    data = np.frombuffer(content, dtype="<i2", offset=begin, count=count * int(offsets[-1])).reshape(count, -1)
    return head, channels, offsets, data


def _samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("subject", "channel", "first_idx", "values")
    rows, held = [], 0
    for frame in frames:
        for subject, content in zip(frame["subject"], frame["content"]):
            _, channels, offsets, data = _layout(content)
            for i, c in enumerate(channels):
                if c["label"] == ANNOTATIONS:
                    continue
                low, high = float(c["digital_min"]), float(c["digital_max"])
                pmin, pmax = float(c["physical_min"]), float(c["physical_max"])
                raw = data[:, offsets[i]:offsets[i + 1]].reshape(-1)
                for s in range(0, len(raw), BATCH_VALUES):
                    part = (raw[s:s + BATCH_VALUES] - low) * (pmax - pmin) / (high - low) + pmin
                    rows.append((subject, c["label"], s, part.astype(np.float32)))
                    held += len(part)
                    if held >= BATCH_VALUES:
                        yield pd.DataFrame(dict(zip(names, zip(*rows))))
                        rows, held = [], 0
    if rows:
        yield pd.DataFrame(dict(zip(names, zip(*rows))))


def decode_samples(files: DataFrame) -> DataFrame:
    """``(subject, content)`` -> ``(subject, channel, first_idx, values)``: arrays of a channel that start at multiples of a batch."""
    return files.select("subject", "content").mapInPandas(_samples, SAMPLE_SCHEMA)


def spread_samples(packed: DataFrame) -> DataFrame:
    """One row per value of what ``decode_samples`` gives."""
    return packed.select("subject", "channel", "first_idx", F.posexplode("values").alias("_p", "value")).select(
        "subject", "channel", (F.col("first_idx") + F.col("_p")).alias("idx"), "value", "first_idx")


def read_samples(files: DataFrame) -> DataFrame:
    """``(subject, content)`` -> ``(subject, channel, idx, value)`` in physical units."""
    return spread_samples(decode_samples(files)).drop("first_idx")


def _annotation_rows(subject: str, content: bytes) -> list:
    _, channels, offsets, data = _layout(content)
    out = []
    for i, c in enumerate(channels):
        if c["label"] != ANNOTATIONS:
            continue
        # A zero after each record keeps its last text apart from the next record.
        text = np.pad(data[:, offsets[i]:offsets[i + 1]], ((0, 0), (0, 1))).tobytes()
        for item in re.findall(rb"[^\x00]+", text):
            if not item.endswith(b"\x14\x14") or item.count(b"\x14") > 2:  # else only the time of the record
                time, *texts = item.split(b"\x14")
                onset, _, length = time.partition(b"\x15")
                for note in texts:
                    if note:
                        out.append({"onset": float(onset), "dur": float(length) if length else -1.0,
                                    "text": note.decode("utf-8", "replace")})
    return out


META_SCHEMA = ("subject string, meta map<string,string>, channels array<map<string,string>>, "
               "annotations array<struct<onset:double,dur:double,text:string>>")


def read_metadata(files: DataFrame) -> DataFrame:
    """File fields, channel fields and annotations per recording."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for subject, content in zip(frame["subject"], frame["content"]):
                head, channels = parse_header(content)
                yield pd.DataFrame({"subject": [subject], "meta": [head], "channels": [channels],
                                    "annotations": [_annotation_rows(subject, content)]})
    return files.select("subject", "content").mapInPandas(rows, META_SCHEMA)


def annotations_json(metadata: DataFrame) -> DataFrame:
    return metadata.select("subject", F.to_json("annotations").alias("annotations"))


def find_edf(spark: SparkSession, folder: str, pattern: str = "*.edf") -> DataFrame:
    from stillwave.sources.tables import subject_from_path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("subject", subject_from_path("path"))


def complete_recordings(samples: DataFrame) -> DataFrame:
    """Subjects that have all five channels."""
    have = samples.select("subject", "channel").distinct().filter(F.col("channel").isin(*REQUIRED_CHANNELS))
    return have.groupBy("subject").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") == len(REQUIRED_CHANNELS)).select("subject")


def device_tables(samples: DataFrame) -> dict[str, DataFrame]:
    """Acceleration in g (y, x, z), heart rate and ECG of complete recordings.

    ``samples`` come from ``read_samples``, or from ``decode_samples`` if they
    are stored: then arrays are shuffled and spread where they have arrived.
    """
    usable = samples.join(complete_recordings(samples), "subject", "left_semi")
    packed = "values" in samples.columns
    spread = spread_samples if packed else lambda df: df
    group = ["subject", "first_idx"] if packed else ["subject"]
    axis = lambda c: F.max(F.when(F.col("channel") == c, F.col("value"))) * MS2_TO_G
    moved = usable.filter(F.col("channel").isin("X", "Y", "Z"))
    acc = spread(moved.repartition(*group) if packed else moved).groupBy(*group, "idx").agg(
        *[axis(c).alias(c.lower()) for c in ("Y", "X", "Z")]).select("subject", "idx", "y", "x", "z")
    one = lambda c, n: spread(usable.filter(F.col("channel") == c)).select("subject", "idx", F.col("value").alias(n))
    return {"acc": acc, "hr": one("Estimated HR", "hr"), "ecg": one("ECG0", "ecg")}
