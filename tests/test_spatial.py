"""Grid joins against brute force on random and awkward inputs."""

import numpy as np
import pandas as pd
import pytest

from curbline.operators import graph as G
from curbline.operators.overlap import buffer_overlap, name_present
from curbline.operators.spatial import nearest, nearest_point, nearest_two_roads, points_in_polygon, within_distance


def _d(px, py, s):
    dx, dy = s.x2 - s.x1, s.y2 - s.y1
    l2 = dx * dx + dy * dy
    t = np.where(l2 == 0, 0, np.clip(((px - s.x1) * dx + (py - s.y1) * dy) / np.where(l2 == 0, 1, l2), 0, 1))
    return np.hypot(px - (s.x1 + t * dx), py - (s.y1 + t * dy))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    # clustered points with a third of them in one spot, and a few very far ones
    x = np.concatenate([rng.uniform(0, 4000, 200), np.full(100, 777.0), [90000.0, -55000.0]])
    y = np.concatenate([rng.uniform(0, 4000, 200), np.full(100, 333.0), [-70000.0, 120000.0]])
    pts = pd.DataFrame({"pid": np.arange(len(x)), "x": x, "y": y})
    n = 150
    a = rng.uniform(0, 4000, (n, 2))
    b = a + rng.uniform(-600, 600, (n, 2))
    b[:5] = a[:5]  # zero-length pieces
    b[5] = a[5] + [9000, 7000]  # one very long piece
    segs = pd.DataFrame({"seg_id": np.arange(n), "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1], "road": [f"R{i % 9}" for i in range(n)]})
    return pts, segs, spark.createDataFrame(pts), spark.createDataFrame(segs)


@pytest.mark.parametrize("dense", [20_000, 3])
def test_nearest_is_exact(world, dense):
    pts, segs, p, s = world
    got = nearest(p, s, point_id="pid", key=["seg_id"], dense=dense).toPandas().set_index("pid")
    assert len(got) == len(pts)
    for r in pts.itertuples():
        d = _d(r.x, r.y, segs)
        assert got.loc[r.pid, "dist"] == pytest.approx(d.min(), abs=1e-6)
        assert got.loc[r.pid, "seg_id"] in set(segs.seg_id[d <= d.min() + 1e-6])


@pytest.mark.parametrize("dense", [20_000, 3])
def test_nearest_within_keeps_only_close(world, dense):
    pts, segs, p, s = world
    got = nearest(p, s, point_id="pid", key=["seg_id"], within=40.0, dense=dense).toPandas().set_index("pid")
    want = {r.pid: _d(r.x, r.y, segs).min() for r in pts.itertuples()}
    assert set(got.index) == {k for k, v in want.items() if v <= 40.0}


def test_nearest_by_group_and_other_road(world):
    pts, segs, p, s = world
    two = nearest_two_roads(p, s, point_id="pid", road="road", key=["seg_id"]).toPandas().set_index("pid")
    for r in pts.itertuples():
        best = segs.assign(d=_d(r.x, r.y, segs)).groupby("road").d.min().sort_values()
        assert two.loc[r.pid, "dist"] == pytest.approx(best.iloc[0], abs=1e-6)
        assert two.loc[r.pid, "next_dist"] == pytest.approx(best.iloc[1], abs=1e-6)


def test_within_distance_pairs_once(world):
    pts, segs, p, s = world
    got = within_distance(p, s.drop("road"), 150.0).toPandas()
    want = {(r.pid, i) for r in pts.itertuples() for i in segs.seg_id[_d(r.x, r.y, segs) <= 150.0]}
    assert len(got) == len(want) and set(zip(got.pid, got.seg_id)) == want


def test_nearest_of_empty_network(world, spark):
    _, _, p, s = world
    assert nearest(p, s.where("seg_id < 0"), point_id="pid", key=["seg_id"]).count() == 0


def test_polygon_with_hole(spark):
    ring = lambda c: [(c[i], c[(i + 1) % 4]) for i in range(4)]
    outer, hole = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)], [(400, 400), (600, 400), (600, 600), (400, 600)]
    rows = [(1, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in ring(outer) + ring(hole)]
    edges = spark.createDataFrame(rows, "polygon_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 10.0, 10.5), (2, 500.0, 500.5), (3, 1500.0, 10.5), (4, 399.0, 500.5)], "pid int, x double, y double")
    assert {r[0] for r in points_in_polygon(pts, edges, point_id="pid", band=300.0).collect()} == {1, 4}


def test_overlap_by_hand(spark):
    streets = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0, "K"), (2, 0.0, 50.0, 1000.0, 50.0, "L"), (3, 500.0, -100.0, 500.0, 100.0, "M")], "seg_id int, x1 double, y1 double, x2 double, y2 double, name_key string")
    routes = spark.createDataFrame([(100.0, 5.0, 400.0, 5.0, "K"), (300.0, 5.0, 600.0, 5.0, "Z")], "x1 double, y1 double, x2 double, y2 double, name_key string")
    got = {r["seg_id"]: r["overlap"] for r in buffer_overlap(streets, routes, 10.0).collect()}
    side = 75**0.5  # the round end reaches this far along a line 5 m away
    assert got[1] == pytest.approx((500 + 2 * side) / 1000)
    assert got[3] == pytest.approx(20 / 200)
    assert 2 not in got
    same = {r["seg_id"]: r["overlap"] for r in buffer_overlap(streets, routes, 10.0, by=["name_key"]).collect()}
    assert same == {1: pytest.approx((300 + 2 * side) / 1000)}
    assert {r[0] for r in name_present(streets, routes, 10.0, key="name_key").collect()} == {1}


def _find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


@pytest.mark.parametrize("crowded", [1_000, 2])
def test_clusters_match_union_find(spark, monkeypatch, crowded):
    monkeypatch.setattr(G, "CROWDED", crowded)
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.uniform(0, 800, (150, 2)), rng.normal(300, 12, (120, 2)), np.full((60, 2), 5.0)])
    pdf = pd.DataFrame({"pid": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    parent = list(range(len(xy)))
    for i in range(len(xy)):
        for j in np.flatnonzero(np.hypot(*(xy - xy[i]).T) <= 30.0):
            a, b = _find(parent, i), _find(parent, int(j))
            parent[max(a, b)] = min(a, b)
    got = G.cluster_points(spark.createDataFrame(pdf), 30.0, point_id="pid").toPandas().set_index("pid").cluster
    assert [got[i] for i in range(len(xy))] == [_find(parent, i) for i in range(len(xy))]


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)]
    got = {r["vertex"]: r["component"] for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[i] == 1000 for i in range(1000, 1101))


def test_nearest_point_ties_take_smallest_key(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double")
    b = spark.createDataFrame([(9, 3.0, 4.0), (4, -3.0, 4.0), (7, 0.0, 5.0)], "qid int, x double, y double")
    row = nearest_point(a, b, point_id="pid", key=["qid"]).first()
    assert (row["qid"], row["dist"]) == (4, 5.0)
