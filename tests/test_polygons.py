"""Points in polygons against ray crossing over all edges."""

import numpy as np
import pandas as pd
import pytest

from curbline.operators.spatial import points_in_polygon, polygon_cover


def _star(rng, n, cx, cy, most):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(0.3, 1, n) * most
    return np.stack([cx + r * np.cos(angle), cy + r * np.sin(angle)], 1)


def _edges(rings):
    rows = []
    for polygon, ring in rings:
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            rows.append((polygon, *map(float, a), *map(float, b)))
    return pd.DataFrame(rows, columns=["polygon_id", "x1", "y1", "x2", "y2"])


def _inside(x, y, edges):
    odd = {}
    for e in edges.itertuples():
        if (e.y1 > y) != (e.y2 > y) and x < e.x1 + (y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1):
            odd[e.polygon_id] = not odd.get(e.polygon_id, False)
    return any(odd.values())


@pytest.mark.parametrize("side", [37.0, 250.0, 20_000.0])
def test_stars_with_holes_and_overlaps(spark, side):
    rng = np.random.default_rng(17)
    rings = [(1, _star(rng, 60, 0, 0, 2000)), (1, _star(rng, 20, 50, 20, 300)), (2, _star(rng, 40, 1500, 300, 900)), (3, np.array([[-3000, -3000], [-2500, -3000], [-2500, -2000], [-3000, -2000]]))]
    rings.append((3, rings[-1][1] + [600.0, 0.0]))
    edges = _edges(rings)
    xy = np.concatenate([rng.uniform(-3500, 3000, (600, 2)), rng.normal(0, 300, (100, 2)), [[-2750.0, -2500.0], [-2450.0, -2500.0], [9e6, 9e6]]])
    points = pd.DataFrame({"pid": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    got = {r[0] for r in points_in_polygon(spark.createDataFrame(points), spark.createDataFrame(edges), point_id="pid", band=side).collect()}
    assert got == {i for i, (x, y) in enumerate(xy) if _inside(x, y, edges)}


def test_cells_inside_need_no_edges(spark):
    """A large square: most cells are settled without an edge, and no cell is both touched and inside."""
    square = _edges([(1, np.array([[0, 0], [10_000, 0], [10_000, 10_000], [0, 10_000]]))])
    touched, inside = polygon_cover(spark.createDataFrame(square), cell=500.0)
    border, whole = {(r["_cx"], r["_cy"]) for r in touched.collect()}, {(r["_cx"], r["_cy"]) for r in inside.collect()}
    assert not border & whole and len(whole) == 361 and len(border) == 80


def test_empty_tables(spark):
    square = spark.createDataFrame(_edges([(1, np.array([[0, 0], [10, 0], [10, 10], [0, 10]]))]))
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, None, 5.0), (3, 5.0, None)], "pid long, x double, y double")
    assert [r[0] for r in points_in_polygon(points, square, point_id="pid").collect()] == [1]
    assert points_in_polygon(points.limit(0), square, point_id="pid").collect() == []
    assert points_in_polygon(points, square.limit(0), point_id="pid").collect() == []


def test_clipped_lines(spark):
    """Stretches inside a ring with a hole, by hand and by sampling."""
    from curbline.operators.clip import clip_lines

    outer, hole = np.array([[0, 0], [1000, 0], [1000, 1000], [0, 1000]]), np.array([[400, 400], [600, 400], [600, 600], [400, 600]])
    edges = _edges([(1, outer), (1, hole)])
    rng = np.random.default_rng(6)
    lines = np.concatenate([[[-500, 500, 1500, 500], [100, 100, 200, 300], [-10, -10, -20, 900], [-50, 250, 300, 250]], rng.uniform(-300, 1300, (40, 4))])
    segs = pd.DataFrame(lines, columns=["x1", "y1", "x2", "y2"]).assign(seg_id=np.arange(len(lines)), street="A")
    got = clip_lines(spark.createDataFrame(segs), spark.createDataFrame(edges), by=["street"], cell=300.0).toPandas()
    assert got[got.seg_id == 0].sort_values("t0")[["x1", "x2"]].to_numpy().round(6).tolist() == [[0, 400], [600, 1000]]
    assert got[got.seg_id == 1][["t0", "t1"]].to_numpy().tolist() == [[0, 1]] and not (got.seg_id == 2).any()
    share = np.linspace(0, 1, 401)[1:-1] + 1e-5
    for i, (a, b, c, d) in enumerate(lines):
        own = got[got.seg_id == i]
        inside = np.array([_inside(a + t * (c - a), b + t * (d - b), edges) for t in share])
        held = np.array([((own.t0 <= t) & (t <= own.t1)).any() for t in share])
        assert (inside == held).mean() > 0.99


def test_points_on_slanted_edges_fall_as_in_the_ray_test(spark):
    import duckdb

    from curbline.plans.fixtures import Tables, view_sql

    tables = Tables(spark, "/nowhere")
    tables.__dict__["n"] = 775
    edges = tables.boundary.toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE grid AS SELECT 775::BIGINT AS n")
    assert sorted(edges.itertuples(index=False, name=None)) == sorted(con.execute(view_sql()["boundary"]).fetchall())
    rng = np.random.default_rng(3)
    ends = edges[["x1", "y1", "x2", "y2"]].to_numpy()
    xy = []
    for x1, y1, x2, y2 in ends:
        t = rng.integers(1, 31000, 150) / 31000
        xy.extend(np.stack([np.round((x1 + t * (x2 - x1)) * 4) / 4, np.round((y1 + t * (y2 - y1)) * 4) / 4], 1))
    points = pd.DataFrame({"pid": np.arange(len(xy)), "x": [p[0] for p in xy], "y": [p[1] for p in xy]})
    got = {r[0] for r in points_in_polygon(spark.createDataFrame(points), tables.boundary, point_id="pid").collect()}
    assert got == {i for i, (x, y) in enumerate(xy) if _inside(x, y, edges)}
