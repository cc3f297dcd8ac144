"""Person rows are folded to incidents once per query, however often the incidents are read."""

import pytest

from curbline.operators import aggregates as A
from curbline.operators import corridors as K
from curbline.operators import rules as R
from curbline.plans import scene as scenes
from curbline.plans.fixtures import Tables
from curbline.plans.scene import CITY_BOX, Scene

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["first_pass", "net_incidents"])
def test_person_rows_are_read_once(spark, name):
    scene, seen = Scene(spark, FOLDER), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = scene.person_rows
    scene.person_rows = rows.mapInArrow(counted, rows.schema)
    if name == "first_pass":
        out = R.first_pass_classify(scene.stored, scene.boundary, scene.routes, box=CITY_BOX)
    else:
        out = scene.net_incidents
    assert out.count() == scene.stored.count() > 0
    assert seen.value == rows.count()


def test_streets_are_written_once(spark):
    scene = Scene(spark, FOLDER)
    assert all("/curbline-" in f for df in (scene.streets, scene.routes, scene.through) for f in df.inputFiles())
    lazy = Tables(spark, FOLDER).streets
    assert lazy.exceptAll(scene.streets).isEmpty() and scene.streets.count() == lazy.count() > 0


def _counted(df, seen):
    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passed, df.schema)


def test_distances_along_roads_read_incidents_once(spark):
    ref = spark.createDataFrame([("A", 1, 0.0, 0.0, 100.0, 0.0, 100.0, 0.0, 1.0, 1)], "street string, seg_id long, x1 double, y1 double, x2 double, y2 double, len double, m_start double, m_dir double, chain_id long")
    safe = spark.createDataFrame([("s", "A", 40.0)], "safe_id string, street string, m double")
    rows = [(1, 50.0, 5.0, "Intersection-In Crosswalk", "Fatal"), (2, 100.0, 9.0, "Not Intersection-On Roadway", "Possible Injury"), (3, 10.0, 0.0, "Not on Roadway", "Fatal"), (4, 10.0, 99.0, "In Crosswalk", "Fatal")]
    incidents, seen = spark.createDataFrame(rows, "incident_id long, x double, y double, location string, severity string"), spark.sparkContext.accumulator(0)
    out = K.distance_stats(K.crossing_distances(_counted(incidents, seen), safe, ref)).collect()
    assert [(r["incidents"], r["fatal"], r["mean_m"], r["max_m"], r["median_m"]) for r in out] == [(2, 1, 35.0, 60.0, 35.0)]
    assert seen.value == 4


def test_junction_totals_need_no_signals(spark):
    scene = Scene(spark, FOLDER)
    got = {tuple(r) for r in scene.full_nodes.select("node_id", "crashes", "deaths").collect()}
    assert "signal_status" not in vars(scene)
    assert got == {tuple(r) for r in A.junction_totals(scene.marked_nodes, scene.signal_status).select("node_id", "crashes", "deaths").collect()}
    assert sum(crashes for _, crashes, _ in got) > 0


def test_nearest_streets_of_incidents_are_searched_once(spark, monkeypatch):
    searched, search = [], R.nearest

    def counted(points, pieces, **options):
        searched.append((options["point_id"], *options["key"]))
        return search(points, pieces, **options)

    monkeypatch.setattr(R, "nearest", counted)
    monkeypatch.setattr(scenes, "nearest", counted)
    scene = Scene(spark, FOLDER)
    got = {tuple(r) for r in scene.classified.select("incident_id", "seg_id", "seg_m", "owner").collect()}
    assert scene.named.count() == scene.classified.count() == len(got) > 0
    assert searched.count(("incident_id", "seg_id")) == 1
    whole = R.classify_incidents(scene.stored, scene.rulebook, scene.routes)
    assert got == {tuple(r) for r in whole.select("incident_id", "seg_id", "seg_m", "owner").collect()}
