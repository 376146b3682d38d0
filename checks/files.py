"""File decoders on device files that Spark packs from the tables, and signal processing."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.registry import query, r6
from checks.tables import EPOCHS_SQL, MONTH_START_SEC, SIGNAL_SQL
from stillwave.operators.filtering import butterworth_bandpass, resample
from stillwave.session import stash
from stillwave.sources import edf, epoch_csv, raw_archive

RATE = 4  # samples per packed second; the calendar bounds a packed file to 2,500 samples


def pack_triples(values: np.ndarray) -> bytes:
    flat = (values.reshape(-1).astype(np.int32) & 0xFFF).reshape(-1, 2)
    out = np.empty((len(flat), 3), dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = flat[:, 0] >> 4, ((flat[:, 0] & 0xF) << 4) | (flat[:, 1] >> 8), flat[:, 1] & 0xFF
    return out.tobytes()


def pack_archive(values: np.ndarray, start: int, rate: int) -> bytes:
    log = io.BytesIO()
    log.write(struct.pack("<cbLH", b"\x1e", 6, start, 3) + b"abc" + b"\x00")
    seconds = len(values) // rate
    even = rate * 3 % 2 == 0  # a payload of whole bytes: all seconds are packed together
    packed = pack_triples(values[:seconds * rate]) if even else b""
    size = len(packed) // max(seconds, 1)
    for k in range(seconds):
        payload = packed[k * size:(k + 1) * size] if even else pack_triples(values[k * rate:(k + 1) * rate])
        log.write(struct.pack("<cbLH", b"\x1e", 0, start + k, len(payload)) + payload + b"\x00")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("log.bin", log.getvalue())
        archive.writestr("info.txt", "Serial Number: X1\r\nSample Rate: 4\r\nAcceleration Scale: 64.0\r\n")
    return out.getvalue()


def archives(t):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v = np.stack([pdf["y"] * 64 - 100, pdf["x"] * 16, pdf["z"] * 16 - 20], axis=1).round().astype(int)
        return pd.DataFrame({"subject": [str(pdf["subject"].iloc[0])], "content": [pack_archive(v, MONTH_START_SEC, RATE)]})
    return t.signal.groupBy("subject").applyInPandas(build, "subject string, content binary")


@query("s1_decode_packed_recordings", f"""WITH {SIGNAL_SQL} SELECT CAST(subject AS VARCHAR) AS subject, idx, CAST(y * 64 - 100 AS SMALLINT) AS y, CAST(x * 16 AS SMALLINT) AS x,
  CAST(z * 16 - 20 AS SMALLINT) AS z FROM signal WHERE idx < 2496""")
def _(t):
    raw = raw_archive.decode_recordings(archives(t))
    rows = raw.select("subject", "sec", F.posexplode(F.arrays_zip("y", "x", "z")).alias("p", "v"))
    return rows.select("subject", ((F.col("sec") - MONTH_START_SEC) * RATE + F.col("p")).alias("idx"), "v.y", "v.x", "v.z")


@query("s1b_record_counts", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS subject, CAST(625 AS BIGINT) AS records FROM lineitem")
def _(t):
    return raw_archive.record_counts(raw_archive.decode_recordings(archives(t), keep_last=True))


@query("s1c_recording_info", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS subject, 'X1' AS serial, '4' AS rate, '64.0' AS scale FROM lineitem")
def _(t):
    meta = raw_archive.read_info(archives(t))
    return meta.select("subject", *[F.col("meta")[k].alias(n) for k, n in (
        ("Serial_Number", "serial"), ("Sample_Rate", "rate"), ("Acceleration_Scale", "scale"))])


HEADER = "\n".join([
    "------------ Data File Created By Device ActiLife v6.13.3 Firmware v1.6.1 date format dd.MM.yyyy Filter Normal -----------",
    "Serial Number: S{0}", "Start Time 00:00:00", "Start Date 01.01.2024", "Epoch Period (hh:mm:ss) 01:00:00", "Download Time 13:00:18",
    "Download Date 07.08.2024", "Current Memory Address: 0", "Current Battery Voltage: 3,71     Mode = 13",
    "--------------------------------------------------", ""])


def epoch_texts(t):
    """One text per subject; three layouts by subject. The calendar bounds a text to 720 lines."""
    which = F.col("subject") % 3
    line = F.when(which == 0, F.concat_ws(",", "axis1", "axis2", "axis3", "steps")).when(
        which == 1, F.concat_ws(",", "axis1", "axis2", "axis3", "steps", F.lit("name"))).otherwise(F.concat(
            F.lit("t,f,3600,s,"), F.concat_ws(",", "axis1", "axis2", "axis3", "steps"), F.lit(",0,0,0,0,0,0,0,m,n")))
    names = F.when(which == 0, "").when(which == 1, "axis1,axis2,axis3,steps,subjectname\n").otherwise(
        "timestamp,filename,epochlengthinseconds,serialnumber,axis1,axis2,axis3,steps,lux,vectormagnitude,capsense,"
        "inclineoff,inclinestanding,inclinesitting,inclinelying,gender,subjectname\n")
    rows = t.epochs.select("subject", "epoch_idx", line.alias("line"), names.alias("names"))
    return rows.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct("epoch_idx", "line"))).alias("w"), F.first("names").alias("names")).select(
        F.col("subject").cast("string").alias("subject"),
        F.concat(F.replace(F.lit(HEADER), F.lit("{0}"), F.col("subject").cast("string")), "names",
                 F.array_join(F.col("w.line"), "\n"), F.lit("\n")).alias("text"))


@query("s2_epoch_file_rows", f"WITH {EPOCHS_SQL} SELECT CAST(subject AS VARCHAR) AS subject, epoch_idx, CAST(axis1 AS INTEGER) AS axis1, CAST(axis2 AS INTEGER) AS axis2, CAST(axis3 AS INTEGER) AS axis3, CAST(steps AS INTEGER) AS steps FROM epochs")
def _(t):
    return epoch_csv.epoch_rows(epoch_csv.parse_epoch_texts(epoch_texts(t)))


@query("s2b_s2c_epoch_file_header", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject, '6.13.3' AS version, '1.6.1' AS firmware, 'Normal' AS filter, 'dd.MM.yyyy' AS fmt,
  concat('S', user_id) AS serial, '01:00:00' AS period, '3,71     Mode = 13' AS voltage FROM events""")
def _(t):
    parsed = epoch_csv.parse_epoch_texts(epoch_texts(t))
    keys = {"ActiLife Version": "version", "Actigraph Firmware": "firmware", "Filter": "filter", "Date Format": "fmt",
            "Serial Number": "serial", "Epoch Period (hh:mm:ss)": "period", "Current Battery Voltage": "voltage"}
    return parsed.select("subject", *[F.col("meta")[k].alias(n) for k, n in keys.items()])


def pack_edf(channels: dict, seconds: int, notes: list) -> bytes:
    """EDF+ with one record per second; ``channels`` maps a label to whole numbers."""
    labels = [*channels, edf.ANNOTATIONS]
    per = [len(v) // seconds for v in channels.values()] + [32]
    field = lambda text, width: str(text).ljust(width)[:width]
    head = {"version": 0, "patient": "X X X X", "recording": "Startdate 01-JAN-2024 X X X", "start_date": "01.01.24", "start_time": "00.00.00",
            "header_bytes": 256 * (1 + len(labels)), "reserved": "EDF+C", "records": seconds, "record_seconds": 1, "signals": len(labels)}
    out = "".join(field(head[k], w) for k, w in edf.FILE_FIELDS.items())
    value = {"label": labels, "transducer": [""] * len(labels), "dimension": ["u"] * len(labels), "physical_min": [-3276.8] * len(labels),
             "physical_max": [3276.7] * len(labels), "digital_min": [-32768] * len(labels), "digital_max": [32767] * len(labels),
             "prefilter": [""] * len(labels), "samples": per, "reserved": [""] * len(labels)}
    out += "".join(field(v, w) for k, w in edf.CHANNEL_FIELDS.items() for v in value[k])
    body = np.zeros((seconds, 2 * sum(per)), np.uint8)
    at = 0
    for v, n in zip(channels.values(), per):
        part = np.asarray(v[:seconds * n]).astype("<i2").reshape(seconds, n)
        body[:, at:at + 2 * n] = np.ascontiguousarray(part).view(np.uint8).reshape(seconds, 2 * n)
        at += 2 * n
    texts = [f"+{s}\x14\x14\x00" + (f"+{s}\x15{notes[s][0]}\x14{notes[s][1]}\x14\x00" if s < len(notes) else "")
             for s in range(seconds)]
    body[:, at:] = np.frombuffer(b"".join(x.encode().ljust(64, b"\x00") for x in texts), np.uint8).reshape(seconds, 64)
    return out.encode("ascii") + body.tobytes()


def edf_files(t):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch_idx")
        col = lambda c: (pdf[c].clip(0, 3000) * 10).astype(int).to_numpy()
        ch = {"ECG0": np.repeat(col("steps"), 2), "X": col("axis1"), "Y": col("axis2"), "Z": col("axis3"), "Estimated HR": col("h_counts")}
        return pd.DataFrame({"subject": [str(pdf["subject"].iloc[0])], "content": [pack_edf(ch, len(pdf), [(5, "Vertical"), (7, "Slouched")])]})
    return t.epochs.groupBy("subject").applyInPandas(build, "subject string, content binary")


@query("s3_s3b_edf_channels", f"""WITH {EPOCHS_SQL} SELECT CAST(subject AS VARCHAR) AS subject, epoch_idx AS idx, round(axis2 * 0.101972, 3) + 0.0 AS y, round(axis1 * 0.101972, 3) + 0.0 AS x,
  round(axis3 * 0.101972, 3) + 0.0 AS z, round(CAST(h_counts AS DOUBLE), 3) + 0.0 AS hr FROM epochs""")
def _(t):
    d = edf.device_tables(stash(edf.decode_samples(edf_files(t))))  # decoded once for all tables
    r3 = lambda c: (F.round(F.col(c).cast("double"), 3) + F.lit(0.0)).alias(c)
    return d["acc"].join(d["hr"], ["subject", "idx"]).select("subject", "idx", r3("y"), r3("x"), r3("z"), r3("hr"))


@query("s3_edf_metadata", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject, '720' AS records, '6' AS signals, '[{"onset":0.0,"dur":5.0,"text":"Vertical"},{"onset":1.0,"dur":7.0,"text":"Slouched"}]' AS annotations FROM events""")
def _(t):
    meta = stash(edf.read_metadata(edf_files(t)))
    return meta.select("subject", F.col("meta")["records"].alias("records"), F.col("meta")["signals"].alias("signals")).join(
        edf.annotations_json(meta), "subject")


@query("r6_resampled_signal")
def _(t):
    out = resample(t.signal, 5, 2, chunk_secs=200)
    return out.select("subject", "idx", r6("y"), r6("x"), r6("z"))


@query("r7_bandpass_filtered_signal")
def _(t):
    out = butterworth_bandpass(t.signal, 0.05, 1.0, 5, chunk_rows=1000)
    return out.select("subject", "idx", r6("y"), r6("x"), r6("z"))
