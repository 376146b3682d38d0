import io
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.files import HEADER, pack_archive, pack_edf
from stillwave.operators import axes
from stillwave.sources import covariates, edf, epoch_csv, lookups, raw_archive, tables
from stillwave.streaming import ingest


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    rng = np.random.default_rng(0)
    folder = tmp_path_factory.mktemp("rec")
    data = {}
    for s in ("90000001", "90000002"):
        data[s] = rng.integers(-2048, 2048, (40, 3))
        (folder / s).mkdir()
        (folder / s / f"{s} (2016-01-01).gt3x").write_bytes(pack_archive(data[s], 1000, 4))
    return folder, data


def test_recordings_round_trip(spark, recordings):
    folder, data = recordings
    raw = raw_archive.read_recordings(spark, str(folder), keep_last=True)
    out = axes.explode_seconds(raw, 4).toPandas()
    for s, part in out.groupby("subject"):
        assert (part.sort_values("idx")[["y", "x", "z"]].to_numpy() == data[s]).all()
    assert {r.records for r in raw_archive.record_counts(raw_archive.read_recordings(spark, str(folder))).collect()} == {9}
    done = spark.createDataFrame([("90000001",)], "subject string")
    assert raw_archive.read_recordings(spark, str(folder), done).select("subject").distinct().count() == 1
    meta = raw_archive.read_info(raw_archive.find_recordings(spark, str(folder))).first()["meta"]
    assert meta == {"Serial_Number": "X1", "Sample_Rate": "4", "Acceleration_Scale": "64.0"}


def test_ingest_takes_only_new_files(spark, recordings, tmp_path):
    folder, _ = recordings
    store, mark = str(tmp_path / "store"), str(tmp_path / "mark")
    for expected in (18, 18):
        ingest.append_available(ingest.new_recordings(spark, str(folder)), store, mark).awaitTermination()
        assert spark.read.parquet(store).count() == expected


def test_odd_payload_and_cut_off_record():
    assert raw_archive.unpack_triples(bytes([0x00, 0x1F, 0xFF, 0x80, 0x00])).tolist() == [[1, -1, -2048]]
    import io
    whole = struct.pack("<cbLH", b"\x1e", 0, 7, 2) + b"ab\x00"
    assert list(raw_archive.records(io.BytesIO(whole + whole[:-2]))) == [(7, b"ab")]


def test_epoch_files(spark, tmp_path):
    long = ("timestamp,filename,epochlengthinseconds,serialnumber,axis1,axis2,axis3,steps,lux,vectormagnitude,capsense,"
            "inclineoff,inclinestanding,inclinesitting,inclinelying,gender,subjectname\n")
    bodies = {"1": "50,127,279,0\n1,2,3,4\n", "2": "axis1,axis2,axis3,steps\n50,127,279,0\n1,2,3,4\n",
              "3": "axis1,axis2,axis3,steps,subjectname\n50,127,279,0,me\n1,2,3,4,me\n",
              "4": long + "t,f,10,s,50,127,279,0,0,0,0,0,0,0,0,m,n\nt,f,10,s,1,2,3,4,0,0,0,0,0,0,0,m,n\n"}
    for s, body in bodies.items():
        (tmp_path / f"{s} (epoch).csv").write_text(HEADER.replace("{0}", s) + body)
    epochs, meta = epoch_csv.read_epoch_files(spark, str(tmp_path))
    rows = epochs.orderBy("subject", "epoch_idx").collect()
    assert [tuple(r) for r in rows] == [x for s in "1234" for x in ((s, 0, 50, 127, 279, 0), (s, 1, 1, 2, 3, 4))]
    m = {r.subject: r.meta for r in meta.collect()}["2"]
    assert (m["ActiLife Version"], m["Actigraph Firmware"], m["Date Format"], m["Filter"]) == ("6.13.3", "1.6.1", "dd.MM.yyyy", "Normal")
    assert m["Start Date"] == "01.01.2024" and m["Serial Number"] == "S2"


def test_edf(spark):
    rng = np.random.default_rng(3)
    ch = {"ECG0": rng.integers(-999, 999, 16), **{c: rng.integers(-999, 999, 8) for c in "XYZ"}, "Estimated HR": rng.integers(0, 99, 8)}
    good = pack_edf(ch, 8, [(5, "Vertical")])
    bad = pack_edf({k: v for k, v in ch.items() if k != "Z"}, 8, [])
    files = spark.createDataFrame([("a", good), ("b", bad)], "subject string, content binary")
    d = edf.device_tables(edf.read_samples(files))
    acc = d["acc"].orderBy("idx").toPandas()
    assert set(acc.subject) == {"a"}
    assert np.allclose(acc[["y", "x", "z"]].to_numpy(), np.stack([ch["Y"], ch["X"], ch["Z"]], axis=1) / 10 * 0.101972, atol=1e-4)
    assert d["ecg"].count() == 16 and d["hr"].count() == 8
    meta = {r.subject: r for r in edf.read_metadata(files).collect()}
    assert [tuple(x) for x in meta["a"].annotations] == [(0.0, 5.0, "Vertical")]
    assert meta["a"].channels[1]["label"] == "X" and meta["a"].meta["records"] == "8"


def test_write_keep_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "subject string, idx long, v int")
    tables.write_table(make([("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]), path, buckets=2)
    tables.write_table(make([("a", 0, 9), ("c", 0, 2)]), path, buckets=2)
    read = lambda: sorted((r.subject, r.idx, r.v) for r in tables.read_table(spark, path).collect())
    assert read() == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("c", 0, 2)]
    tables.write_table(make([("a", 0, 9)]), path, overwrite=True, buckets=2)
    assert read() == [("a", 0, 9), ("b", 0, 1), ("c", 0, 2)]
    assert tables.read_table(spark, path, "a", 0, 5).count() == 1


def test_episode_csv_round_trip(spark, tmp_path):
    (tmp_path / "90000001.csv").write_text("counter,start,stop,start_index,stop_index,label\n0,2024-01-01 00:00:00,2024-01-01 00:01:00,0,6000,0\n")
    r = tables.read_episodes(spark, str(tmp_path)).first()
    assert (r.subject, r.counter, r.stop_index, r.label) == ("90000001", 0, 6000, 0)


def test_metadata_and_settings(spark):
    old = spark.createDataFrame([("a", "d", {"x": "1", "y": "2"}), ("b", "d", {"x": "3"})], "subject string, dataset string, meta map<string,string>")
    new = spark.createDataFrame([("a", "d", {"y": "9", "z": "5"}), ("c", "d", {"q": "1"})], old.schema)
    assert {r.subject: r.meta for r in tables.merge_metadata(old, new).collect()} == {
        "a": {"x": "1", "y": "9", "z": "5"}, "b": {"x": "3"}, "c": {"q": "1"}}
    settings = spark.createDataFrame([(s, k, "old") for s in "abc" for k in ("age", "sex", "other")], "subject string, settingName string, settingValue string")
    cov = spark.createDataFrame([("a", "50", "1"), ("b", " ", "2")], "subject string, age string, sex string")
    got = {(r.subject, r.settingName): r.settingValue for r in covariates.upsert_settings(settings, cov, ["age", "sex"]).collect()}
    assert got == {("a", "age"): "50", ("a", "sex"): "1", ("a", "other"): "old"}
    assert {(r.subject, r.reason) for r in covariates.rejected_subjects(settings, cov, ["age", "sex"]).collect()} == {
        ("b", "blank covariate"), ("c", "no covariates")}


def test_bad_rates():
    with pytest.raises(ValueError):
        axes.subsecond_time("sec", "pos", 30)
    with pytest.raises(ValueError):
        axes.sample_time("start", "idx", 7)


def test_loaders_lookups_and_pairs(spark, tmp_path):
    path = str(tmp_path / "sig")
    signal = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("b", 0, 1.0, 2.0, 3.0)], "subject string, idx long, y double, x double, z double")
    tables.write_table(signal, path, buckets=4)
    weights = spark.createDataFrame([("a", 2.0, 1.0, 1.0, 0.5, 0.0, 0.0)], "subject string, t_y double, t_x double, t_z double, b_y double, b_x double, b_z double")
    assert {(r.subject, r.y) for r in tables.load_signal(spark, path, weights).collect()} == {("a", 2.5), ("b", 1.0)}
    assert {r.subject for r in tables.subjects(tables.load_signal(spark, path)).collect()} == {"a", "b"}
    counts = spark.createDataFrame([("a", 0, 5), ("a", 6, 7)], "subject string, epoch_idx long, axis1 int")
    epoch_path = str(tmp_path / "epochs")
    tables.write_table(counts, epoch_path, idx="epoch_idx", buckets=4)
    meta = spark.createDataFrame([("a", {"Start Date": "1/2/2024", "Start Time": "00:01:00", "Date Format": "M/d/yyyy"})], "subject string, meta map<string,string>")
    times = tables.load_epochs(spark, epoch_path, meta, 10).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r.t for r in times} == {"2024-01-02 00:01:00", "2024-01-02 00:02:00"}
    assert lookups.excluded_subjects(spark).count() == 22
    assert lookups.merge_lookup(spark).filter("first_counter >= last_counter").count() == 0
    assert lookups.label_corrections(spark).distinct().count() == lookups.label_corrections(spark).count()
    tables.write_pairs_csv(spark.createDataFrame([(1, 0.5)], "tp int, f1 double"), str(tmp_path / "pairs"), ["tp", "f1"])
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "pairs")).collect()} == {("tp", "1"), ("f1", "0.5")}
    tables.write_rows_csv(signal, str(tmp_path / "rows"))
    assert tables.read_rows_csv(spark, str(tmp_path / "rows"), "subject string, idx long, y double, x double, z double").count() == 2


def test_edf_tables_from_stored_arrays(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ch = {"ECG0": rng.integers(-999, 999, 40), **{c: rng.integers(-999, 999, 20) for c in "XYZ"}, "Estimated HR": rng.integers(0, 99, 20)}
    files = spark.createDataFrame([
        ("a", pack_edf(ch, 20, [(5, "Vertical")])), ("b", pack_edf({k: v for k, v in ch.items() if k != "Z"}, 20, []))],
        "subject string, content binary")
    monkeypatch.setattr(edf, "BATCH_VALUES", 8)
    whole, packed = edf.device_tables(edf.read_samples(files)), edf.device_tables(edf.decode_samples(files))
    for name, df in packed.items():
        rows = lambda d: sorted(map(tuple, d.select(*whole[name].columns).collect()))
        assert rows(df) == rows(whole[name]) and rows(df)


def test_edf_notes_that_fill_their_record():
    body = pack_edf({"X": np.arange(3)}, 3, [(1, "n" * (64 - 12)), (2, "second")])
    assert len(body) == 256 * 3 + 3 * (2 + 64)
    assert [n["text"] for n in edf._annotation_rows("a", body)] == ["n" * 52, "second"]


def test_equal_payloads_unpack_as_single_ones():
    content = pack_archive(np.random.default_rng(5).integers(-2000, 2000, (24, 3)), 100, 4)
    out = pd.concat(raw_archive._decode(True)(iter([pd.DataFrame({"subject": ["a"], "content": [content]})])))
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        each = [raw_archive.unpack_triples(p) for _, p in raw_archive.records(archive.open("log.bin"))]
    assert [list(v) for v in out.y] == [v[:, 0].tolist() for v in each] and len(out) == 6
