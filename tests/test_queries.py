"""Registered queries against their check SQL on the smallest data, and a few invariants."""

import importlib.util
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from curbline.functions import columns as C
from curbline.operators import aggregates as A

FOLDER = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
NAMES = [
    "prj01_project", "prj01_inverse", "prj05_base_form", "prj06_display_name", "prj08_event_date", "flt05_interstate_names", "jn01_points_in_polygon", "jn02_nearest_segment", "jn03_nearest_within",
    "jn09_line_crossings", "jn16_nearest_two_roads", "rl01_tag_segments", "rl04_classify_incidents", "rl06_intersection_status", "ag02_corridor_ranking", "ag06_owner_split_range", "ag12_concentration",
    "ag16_join_quality", "ag23_covered_corridors", "gr03_junction_nodes", "gr05_network_distance", "gr06_network_count", "lr06_safe_crossings", "lr07_distance_stats", "lc01_location_facts", "se06_locate",
    "ing02_snapshot_diff", "ing06_stream_fold", "src02_geojson_lines", "src05_tagged_points", "wn06_status_runs",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check(spark, name):
    got = E.queries()[name](spark, FOLDER)
    left = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(E.oracle_sql()[name])
    right = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert sorted(left.columns) == sorted(right.columns)
    assert check.canonical(left) == check.canonical(right)


def test_entry_has_25_rows_at_most(spark):
    rows = E.entry(spark).collect()
    assert 0 < len(rows) <= 25 and rows == sorted(rows, key=lambda r: (-r["total"], -r["fatal"], r["street"]))


def test_names_by_hand(spark):
    df = spark.createDataFrame([("N MAIN ST", "n main st."), ("4TH AVE", "South"), ("ELM", "East Elm Blvd")], "a string, b string")
    rows = df.select(C.display_name("a"), C.base_form("b")).collect()
    assert [tuple(r) for r in rows] == [("N Main Street", "main"), ("4th Avenue", "south"), ("Elm", "elm")]


def test_split_handles_unknown_and_empty(spark):
    df = spark.createDataFrame([("Fatal", "City", True)], "severity string, owner string, is_corner boolean")
    out = {r["scope"]: r for r in A.owner_split_range(df).collect()}
    assert out["all"]["city_pct"] == 100.0 and out["fatal"]["state_high_pct"] == 100.0
    assert A.owner_split_range(df.where(F.lit(False))).count() == 0
