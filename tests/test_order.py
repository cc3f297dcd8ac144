"""Lookups by order (sums in intervals, nearest on a line, percentiles of groups) against brute force, and the dense grid."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbline.operators import chains as CH
from curbline.operators import network as N
from curbline.operators import scan
from curbline.operators.spatial import nearest


def _lines(rng, n):
    """Nine of ten rows on one line."""
    return ["long" if rng.random() < 0.9 else f"s{rng.randrange(5)}" for _ in range(n)]


def test_interval_sums(spark):
    rng = random.Random(4)
    spots = pd.DataFrame({"line": _lines(rng, 900), "m": [float(rng.randrange(300)) for _ in range(900)]}).groupby(["line", "m"]).size().reset_index(name="n").assign(k=lambda d: d.n * 2)
    parts = pd.DataFrame({"line": _lines(rng, 300) + ["none"] * 3, "id": [i // 2 for i in range(303)], "lo": [float(rng.randrange(300)) for _ in range(303)]})
    parts["hi"] = parts.lo + [float(rng.randrange(60)) for _ in range(303)]
    parts = parts.drop_duplicates(["line", "id", "lo", "hi"])
    got = {r["id"]: (r["n"], r["k"]) for r in scan.interval_sums(spark.createDataFrame(parts), spark.createDataFrame(spots), interval_id="id", by=["line"], measures=["n", "k"]).collect()}
    want = {}
    for p in parts.itertuples():
        inside = spots[(spots.line == p.line) & (spots.m >= p.lo) & (spots.m <= p.hi)]
        a, b = want.get(p.id, (0, 0))
        want[p.id] = (a + inside.n.sum(), b + inside.k.sum())
    assert got == want


def test_along_nearest_on_one_crowded_line(spark):
    rng = random.Random(5)
    points = [(i, line, rng.randrange(400) / 2) for i, line in enumerate(_lines(rng, 600))] + [(900, None, 1.0), (901, "long", None), (902, "no target", 3.0)]
    targets = [(i, line, float(rng.randrange(200))) for i, line in enumerate(_lines(rng, 120))] + [(500, None, 1.0), (501, "long", None), (502, "unused", 3.0)]
    got = CH.along_nearest(spark.createDataFrame(points, "p long, street string, m double"), spark.createDataFrame(targets, "t long, street string, m double"), point_id="p", target_id="t", by=["street"])
    want = {}
    for p, street, m in points:
        near = [(abs(m - x), t) for t, s, x in targets if s == street and s is not None and x is not None and m is not None]
        if near:
            want[p] = min(near)
    assert {r["p"]: (r["along_m"], r["t"]) for r in got.collect()} == want


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"g": rng.choice(["a", "b", "c", "d"], 2000, p=[0.9, 0.06, 0.03, 0.01]), "v": rng.integers(0, 500, 2000) / 4})
    df = spark.createDataFrame(rows).union(spark.createDataFrame([("e", 7.0), (None, 1.0), (None, 2.0), ("a", None)], "g string, v double"))
    got = {(r["g"], r["share"]): r["value"] for r in scan.group_percentiles(df, ["g"], "v", [0.0, 0.5, 0.9]).collect()}
    for g, v in rows.groupby("g").v:
        for share in (0.0, 0.5, 0.9):
            assert got[g, share] == pytest.approx(np.quantile(v, share))
    assert got["e", 0.5] == 7.0 and got[None, 0.5] == 1.5
    assert {r["g"]: r["m"] for r in scan.group_median(df, ["g"], "v", "m").collect()}["e"] == 7.0
    assert scan.group_percentiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


def _roads():
    """Chains (id, length, node, node): branches, a loop, a double edge and a separate pair."""
    return [(1, 100.0, 1, 2), (2, 60.0, 2, 3), (3, 170.0, 2, 4), (4, 40.0, 3, 4), (5, 90.0, 4, 4), (6, 30.0, 3, 4), (7, 500.0, 4, 5), (8, 80.0, 8, 9), (9, 10.0, 9, 10), (10, 1.0, 3, 6), (11, 1.0, 6, 7), (12, 1.0, 7, 3)]


def _shortest(chain, m, window):
    edges, far = {}, {}
    for _, size, a, b in _roads():
        edges.setdefault(a, []).append((b, size))
        edges.setdefault(b, []).append((a, size))
    _, size, a, b = next(r for r in _roads() if r[0] == chain)
    heap = [(m, a), (size - m, b)]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if u in far or d > window:
            continue
        far[u] = d
        for v, size in edges[u]:
            heapq.heappush(heap, (d + size, v))
    return far


@pytest.mark.parametrize("bands", [1, 4, 9])
def test_network_distance_and_frontier(spark, bands):
    graph = spark.createDataFrame(_roads(), "chain_id long, chain_len double, node_a long, node_b long")
    starts = [(i, c, m) for i, (c, m) in enumerate([(1, 10.0), (1, 95.0), (2, 30.0), (3, 100.0), (5, 20.0), (7, 250.0), (8, 79.0), (10, 0.5)])]
    asked = spark.createDataFrame(starts, "s long, chain_id long, m double")
    got = {(r["s"], r["node"]): r["d"] for r in N.network_distance(asked, graph, start_id="s", window=200.0, bands=bands).collect()}
    assert got == {(s, node): pytest.approx(d) for s, c, m in starts for node, d in _shortest(c, m, 200.0).items()}
    want = set()
    for s, c, m in starts:
        far = _shortest(c, m, 200.0)
        for chain, size, a, b in _roads():
            for x in {200 - far[a] if a in far else -1, size - 200 + far[b] if b in far else -1, *((m - 200, m + 200) if chain == c else ())}:
                ways = [far[n] + d for n, d in ((a, x), (b, size - x)) if n in far] + ([abs(x - m)] if chain == c else [])
                if 0 < x < size and min(ways) > 200 - 1e-6:
                    want.add((s, chain, round(x, 3)))
    ends = N.window_frontier(asked, graph, start_id="s", window=200.0)
    assert {(r["s"], r["chain_id"], round(r["m"], 3)) for r in ends.collect()} == want


def test_places_on_chains_and_openings(spark):
    loop = [(1, 0.0, 0.0, 100.0, 0.0), (2, 100.0, 0.0, 100.0, 100.0), (3, 100.0, 100.0, 0.0, 0.0)]
    line = [(11, 300.0, 0.0, 400.0, 0.0), (12, 400.0, 0.0, 400.0, 50.0)]
    pieces = spark.createDataFrame(loop + line, "seg_id long, x1 double, y1 double, x2 double, y2 double").withColumn("road", F.lit("A"))
    chains = CH.merge_lines(pieces, by=["road"]).cache()
    graph = N.road_graph(chains, by=["road"])
    nodes = N.graph_nodes(chains, graph, by=["road"]).collect()
    assert sorted((r["ends"], r["opening"]) for r in nodes) == [(1, False), (1, False), (2, True)]
    asked = chains.select((F.col("seg_id") * 10).alias("p"), "chain_id", (F.col("m_start") + F.col("m_dir") * 0.25 * F.col("len")).alias("m"))
    at = {r["p"]: (r["x"], r["y"]) for r in CH.place(asked, chains, point_id="p").collect()}
    assert at == {s * 10: (pytest.approx(a + (c - a) / 4), pytest.approx(b + (d - b) / 4)) for s, a, b, c, d in loop + line}


def test_nearest_follows_the_density(spark):
    """Thousands of pieces in one cell beside empty ones, points among them, beside them and far away."""
    rng = np.random.default_rng(21)
    a = np.concatenate([rng.normal(60, 6, (4000, 2)), rng.uniform(0, 5000, (40, 2)), np.full((300, 2), 110.0)])
    b = a + np.concatenate([rng.normal(0, 3, (4000, 2)), rng.uniform(-900, 900, (40, 2)), np.zeros((300, 2))])
    segs = pd.DataFrame({"seg_id": np.arange(len(a)), "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1]})
    xy = np.concatenate([rng.normal(60, 8, (300, 2)), rng.uniform(0, 125, (200, 2)), rng.uniform(-3000, 8000, (60, 2)), [[1e6, 1e6], [110.0, 110.0]]])
    pts = pd.DataFrame({"pid": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    d = b - a
    size = (d * d).sum(axis=1)
    got = nearest(spark.createDataFrame(pts), spark.createDataFrame(segs), point_id="pid", key=["seg_id"]).toPandas().set_index("pid")
    close = nearest(spark.createDataFrame(pts), spark.createDataFrame(segs), point_id="pid", key=["seg_id"], within=9.0).toPandas().set_index("pid")
    near = set()
    for i, p in enumerate(xy):
        t = np.clip(((p - a) * d).sum(axis=1) / np.where(size == 0, 1, size), 0, 1)
        gap = np.hypot(*(p - (a + t[:, None] * d)).T)
        assert got.loc[i, "dist"] == pytest.approx(gap.min(), abs=1e-6) and gap[got.loc[i, "seg_id"]] <= gap.min() + 1e-6
        if gap.min() <= 9.0:
            near.add(i)
    assert len(got) == len(xy) and set(close.index) == near
