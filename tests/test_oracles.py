"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
#: Cheap ones, one or two of each module; the driver runs all of them on larger tables.
NAMES = ["bbox_time_scan", "vessel_semi_select", "cleaning_report", "static_first_nonnull", "vessel_type", "spike_fixpoint", "gaps", "interp_at", "corridor_candidates", "continuity", "triage", "robustness", "hdr", "advect", "severity", "next_port", "spill_compare", "manifest_root", "manifest_chain", "manifest_verify", "provenance_mix", "cfar", "sized_components", "ring_contrast", "morphology", "upsert_latest", "cloud_interp", "fill_stranded", "coverage", "site_threat", "tile_merge", "polygon_points"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered([tuple(plain(r[c]) for c in columns) for r in got.collect()]) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())
