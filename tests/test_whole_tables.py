"""Queries over whole tables against their SQL, on tables large enough for long keys."""

import os

import duckdb
import pytest

from test_oracles import SF, ordered, plain
from tidemark import catalog

NAMES = ["severity", "action_rules", "spill_compare", "component_targets", "cloud_interp", "upsert_latest"]
LATEST = """SELECT user_id, max(event_id) AS event_id, arg_max(['QUEUED', 'RUNNING', 'COMPLETED', 'PARTIAL', 'FAILED'][event_id % 5 + 1], event_id) AS status,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id"""


def results(spark, name, sql, sf=SF):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in sorted(got.columns)]
    return ordered([tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]), ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", NAMES)
def test_all_rows_are_taken(spark, name):
    got, want = results(spark, name, catalog.ORACLES[name], "/root/testdata/sf0.01")
    assert got == want


@pytest.mark.parametrize(("name", "table"), [("severity", "orders"), ("component_targets", "part")])
def test_a_row_for_each_of_the_table(spark, name, table):
    assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_event_is_stored_or_a_change(spark):
    got, want = results(spark, "upsert_latest", LATEST)
    assert got == want
