"""A few registered queries end to end beside their SQL, and the contract of all of them."""

from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks.compare import TABLES, rows_of
from checks.tables import Tables
from stillwave.functions.fixed_values import CHOI_SPACE, TROIANO_SPACE
from stillwave.operators import detectors


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "t3_choi_nonwear", "t4_hees_nonwear_blocks", "e1_vector_to_episodes", "a3_many_epoch_lengths", "j1_align_two_devices",
    "v3_v4_method_totals", "m11_roc_auc", "s2_epoch_file_rows", "g2_hecht_whole_space"])
def test_query_equals_sql(spark, sf_dir, db, name):
    df = contract.queries()[name](spark, sf_dir)
    cur = db.execute(contract.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name, space, find, names", [
    ("g2_troiano_whole_space", TROIANO_SPACE, detectors.troiano,
     {"at": "activity_threshold", "mpl": "min_period_len", "st": "spike_tolerance", "ss": "spike_stoplevel"}),
    ("g2_choi_whole_space", CHOI_SPACE, detectors.choi,
     {"at": "activity_threshold", "mpl": "min_period_len", "st": "spike_tolerance", "mwl": "min_window_len",
      "wst": "window_spike_tolerance"})])
def test_whole_space_equals_single_detector(spark, sf_dir, name, space, find, names):
    rows = {tuple(r[c] for c in space): (r.tn, r.fp, r.fn, r.tp) for r in contract.queries()[name](spark, sf_dir).collect()}
    assert set(rows) == set(product(*space.values()))
    epochs = Tables(spark, sf_dir).epochs
    for place in (0, 1):
        combination = {c: v[place] for c, v in space.items()}
        value = F.col("vmu" if combination["vm"] else "axis1")
        found = find(epochs, value, **{names[c]: v for c, v in combination.items() if c in names})
        counts = {(r.truth, r.wear): r["count"] for r in found.groupBy("truth", "wear").count().collect()}
        # Wear 0 is a predicted non-wear row.
        expected = tuple(counts.get(k, 0) for k in ((0, 1), (0, 0), (1, 1), (1, 0)))
        assert rows[tuple(combination.values())] == expected
