"""Inputs that the fixtures never hold: repeated features, a first load, keywords of two words, pairs exactly at the limit."""

import json
import math

import pytest
from pyspark.sql import functions as F

from curbline.operators import aggregates as A
from curbline.operators import graph as G
from curbline.operators import refresh as I
from curbline.operators import spatial as S
from curbline.plans.registry import forget_scenes
from curbline.sources import readers
from curbline.session import cut, drop_written, scratch_dir


def test_a_repeated_feature_does_not_cancel_itself(spark, tmp_path):
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    for page in (1, 2):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"features": [{"attributes": {}, "geometry": {"rings": [ring]}}]}))
    edges = readers.scan_polygon(spark, str(tmp_path))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0)], "p long, x double, y double")
    assert [r["p"] for r in S.points_in_polygon(points, edges, point_id="p").collect()] == [1]


def test_a_first_load_is_a_change(spark):
    new = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-01")], "incident_id long, d string").select("incident_id", F.to_date("d").alias("incident_date"))
    row = I.change_probe(new.limit(0), new).first()
    assert row["changed"] and row["new_ids"] == 2 and row["old_rows"] == 0
    assert not I.change_probe(new, new).first()["changed"]


def test_gates_of_one_row_each(spark):
    rows = spark.createDataFrame([(1, "2024-01-05", True, "a"), (2, "2024-02-01", False, "b")], "incident_id long, d string, is_limited boolean, street string").withColumn("incident_date", F.to_date("d"))
    limits = {"least_share": 0.9, "may_lose": 5, "may_gain": 75}
    got = {r["gate"]: r["passed"] for r in I.quality_gates(rows, rows, **limits).collect()}
    assert len(got) == 6 and all(got.values())
    with pytest.raises(RuntimeError, match="enough_rows"):
        I.require(I.quality_gates(rows, rows.limit(1), **limits))


def test_keywords_of_two_words(spark):
    rows = spark.createDataFrame([("E Parkway N", "x"), ("Parkway E", "x"), ("EE PARKWAY", "y"), (None, "y")], "street string, label string")
    got = {(r["keyword"], r["label"], r["n"]) for r in A.mix_by_keyword(rows, "street", ["label"], ("E PARKWAY", "PARKWAY")).collect()}
    assert got == {("E PARKWAY", "x", 1), ("PARKWAY", "x", 2), ("PARKWAY", "y", 1)}


@pytest.mark.parametrize("r", [8.0, 20.0, 35.0])
def test_limit_is_the_same_in_thin_and_dense_cells(spark, r):
    """The next double above r * r has the square root r: both paths test the square."""
    far = math.sqrt(math.nextafter(r * r, math.inf))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "p long, x double, y double")
    dy = math.sqrt(math.nextafter(r * r, math.inf) - 1.0)
    net = S.as_pieces(spark.createDataFrame([(10, 1.0, dy), (11, 1000.0 + r, 0.0)], "k long, x double, y double")).select("k", *S.GEOMETRY)
    thin = {tuple(x) for x in S.nearest(points, net, point_id="p", key=["k"], within=r).select("p", "k").collect()}
    dense = {tuple(x) for x in S.nearest(points, net, point_id="p", key=["k"], within=r, dense=0).select("p", "k").collect()}
    assert thin == dense and (2, 11) in thin and far >= r


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    got = dict(tuple(r) for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(40)} == {0} and {got[100 + i] for i in range(41)} == {100}
    assert G.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class _Unset:
    """A session as seen by scratch_dir where spark.checkpoint.dir is not set."""

    def __init__(self, master, app):
        self.conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        self.sparkContext = type("S", (), {"master": master, "applicationId": app})


def test_scratch_folder_without_the_setting():
    first = scratch_dir(_Unset("local[4]", "a"))
    assert first == scratch_dir(_Unset("local[4]", "a")) != scratch_dir(_Unset("local", "b"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(_Unset(master, "c"))


def test_written_tables_can_be_dropped(spark):
    forget_scenes()  # shared tables of other tests are computed anew
    held = cut(spark.range(3))
    assert held.count() == 3 and drop_written(spark) >= 1 and drop_written(spark) == 0
    with pytest.raises(Exception, match="(?i)not.?(found|exist)"):
        held.count()
