"""Raw recordings: a zip with ``log.bin`` (packed samples) and ``info.txt`` per device file.

One file is one task: the format is a sequential record stream inside a zip.
Spark spreads the files; records leave the decoder in batches, so a task holds
one compressed file and a bounded number of decoded seconds.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stillwave.operators.chunked import as_col

# Record layout. Separator byte, type byte, Unix second, payload size; checksum byte after the payload.
RECORD_HEADER = "<cbLH"
ACTIVITY_TYPE = 0
BITS_PER_VALUE = 12

RAW_SCHEMA = "subject string, sec bigint, y array<smallint>, x array<smallint>, z array<smallint>"
BATCH_SECONDS = 3600


def unpack_triples(payload: bytes) -> np.ndarray:
    """12-bit two's-complement values in y, x, z order -> ``(samples, 3)``."""
    raw = np.frombuffer(payload, dtype=np.uint8).astype(np.int16)
    whole = raw[: len(raw) // 3 * 3].reshape(-1, 3)
    values = np.empty((len(whole), 2), dtype=np.int16)
    values[:, 0] = (whole[:, 0] << 4) | (whole[:, 1] >> 4)
    values[:, 1] = ((whole[:, 1] & 0x0F) << 8) | whole[:, 2]
    flat = values.reshape(-1)
    if len(raw) % 3 == 2:
        flat = np.append(flat, np.int16((raw[-2] << 4) | (raw[-1] >> 4)))
    flat = np.where(flat >= 2048, flat - 4096, flat).astype(np.int16)
    return flat[: len(flat) // 3 * 3].reshape(-1, 3)


def records(log: io.BufferedIOBase, wanted: int = ACTIVITY_TYPE) -> Iterator[tuple[int, bytes]]:
    """``(second, payload)`` of the records of one type; a cut-off last record ends the stream."""
    size_of_header = struct.calcsize(RECORD_HEADER)
    while len(head := log.read(size_of_header)) == size_of_header:
        _, kind, second, size = struct.unpack(RECORD_HEADER, head)
        payload = log.read(size)
        if len(payload) < size:
            return
        log.read(1)
        if kind == wanted:
            yield second, payload


def _decode(keep_last: bool):
    def rows(subject: str, content: bytes) -> Iterator[pd.DataFrame]:
        batch, pending = [], None
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("log.bin") as log:
            for record in records(log):
                if pending is not None:
                    batch.append(pending)
                pending = record
                if len(batch) >= BATCH_SECONDS:
                    yield table(subject, batch)
                    batch = []
        if pending is not None and keep_last:
            batch.append(pending)
        if batch:
            yield table(subject, batch)

    def table(subject: str, batch: list) -> pd.DataFrame:
        size = len(batch[0][1])
        if size and size % 9 == 0 and all(len(p) == size for _, p in batch):
            # Nine bytes hold two whole samples, so equal payloads are unpacked together.
            samples = unpack_triples(b"".join(p for _, p in batch)).reshape(len(batch), -1, 3)
        else:
            samples = [unpack_triples(p) for _, p in batch]
        return pd.DataFrame({
            "subject": subject, "sec": [s for s, _ in batch],
            **{a: [v[:, i] for v in samples] for i, a in enumerate(("y", "x", "z"))}})

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for subject, content in zip(frame["subject"], frame["content"]):
                yield from rows(subject, content)

    return decode


def find_recordings(spark: SparkSession, folder: str | list[str], pattern: str = "*.gt3x") -> DataFrame:
    """Recordings below a folder with the subject from the 8 digits of the file name."""
    from stillwave.sources.tables import subject_from_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("subject", subject_from_path("path"))


def decode_recordings(files: DataFrame, keep_last: bool = False) -> DataFrame:
    """``(subject, content)`` -> one row per second with sample arrays.

    The last record of a file is dropped unless ``keep_last``.
    """
    return files.select("subject", "content").mapInPandas(_decode(keep_last), RAW_SCHEMA)


def read_recordings(spark: SparkSession, folder: str, done: DataFrame | None = None, keep_last: bool = False) -> DataFrame:
    """Decode the recordings of all subjects that are not in ``done``.

    Names are compared first; only the files that are left are read.
    """
    files = find_recordings(spark, folder)
    if done is not None:
        names = files.select("path", "subject").join(done.select("subject").distinct(), "subject", "left_anti")
        paths = [row["path"] for row in names.select("path").collect()]
        files = find_recordings(spark, paths) if paths else files.filter("false")
    return decode_recordings(files, keep_last)


def record_counts(raw_seconds: DataFrame) -> DataFrame:
    return raw_seconds.groupBy("subject").agg(F.count(F.lit(1)).alias("records"))


def info_map(text: str | Column) -> Column:
    """``Key: value`` lines as a map; blanks in keys become underscores."""
    lines = F.filter(F.split(as_col(text), r"\r?\n"), lambda l: F.contains(l, F.lit(": ")))
    return F.map_from_entries(F.transform(lines, lambda l: F.struct(
        F.regexp_replace(F.trim(F.substring_index(l, ": ", 1)), " ", "_").alias("key"),
        F.trim(F.regexp_replace(l, "^.*?: ", "")).alias("value"))))


def read_info(files: DataFrame) -> DataFrame:
    """Header map of each recording from its ``info.txt``."""
    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    out.append(archive.read("info.txt").decode("utf-8-sig"))
            yield pd.DataFrame({"subject": frame["subject"], "info": out})

    raw = files.select("subject", "content").mapInPandas(texts, "subject string, info string")
    return raw.select("subject", info_map("info").alias("meta"))
