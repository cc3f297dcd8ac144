"""Chains, loops, network distances and crossings on small hand-made and random roads."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.operators import chains as CH
from curbline.operators import network as N
from curbline.operators.crossings import line_crossings
from curbline.operators.scan import global_rank, percentiles

SEG = "street string, seg_id long, x1 double, y1 double, x2 double, y2 double"


def test_merge_lines_orders_and_measures(spark):
    # a run of four pieces, some drawn backwards, and a side piece at its middle joint
    rows = [("A", 5, 0, 0, 10, 0), ("A", 3, 30, 0, 10, 0), ("A", 8, 30, 0, 30, 40), ("A", 9, 30, 40, 35, 40), ("A", 1, 30, 0, 60, 0), ("B", 2, 0, 5, 0, 9)]
    df = spark.createDataFrame([(a, b, *map(float, r)) for a, b, *r in rows], SEG)
    got = {r["seg_id"]: r for r in CH.merge_lines(df, by=["street"]).collect()}
    assert got[5]["chain_id"] == got[3]["chain_id"] == 3 and got[5]["chain_len"] == pytest.approx(30)
    assert got[8]["chain_id"] == got[9]["chain_id"] == 8 and got[8]["chain_len"] == pytest.approx(45)
    assert got[1]["chain_id"] == 1 and got[2]["chain_len"] == pytest.approx(4)
    for r in got.values():  # both ends measure inside the chain
        ends = [r["m_start"], r["m_start"] + r["m_dir"] * r["len"]]
        assert min(ends) >= -1e-9 and max(ends) <= r["chain_len"] + 1e-9
    shared = lambda s, end: got[s]["m_start"] + got[s]["m_dir"] * end * got[s]["len"]
    assert shared(5, 1) == pytest.approx(shared(3, 1))


def test_merge_lines_opens_closed_loops(spark):
    square = [(0, 0), (100, 0), (100, 100), (0, 100)]
    rows = [("L", 4 + i, *map(float, square[i]), *map(float, square[(i + 1) % 4])) for i in range(4)] + [("L", 90, 500.0, 0.0, 600.0, 0.0)]
    got = {r["seg_id"]: r for r in CH.merge_lines(spark.createDataFrame(rows, SEG), by=["street"]).collect()}
    loop = [got[i] for i in range(4, 8)]
    assert {r["chain_id"] for r in loop} == {loop[0]["chain_id"]} and all(r["chain_len"] == pytest.approx(400) for r in loop)
    assert sorted(min(r["m_start"], r["m_start"] + r["m_dir"] * r["len"]) for r in loop) == pytest.approx([0, 100, 200, 300])


def test_network_count_matches_dijkstra(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for i in range(6):  # a jittered grid with missing pieces
        for j in range(6):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < 6 and j + dj < 6 and rng.random() < 0.75:
                    rows.append(("G", k, i * 100.0, j * 90.0, (i + di) * 100.0, (j + dj) * 90.0))
                    k += 1
    df = spark.createDataFrame(rows, SEG)
    chains = CH.merge_lines(df, by=["street"])
    graph = N.road_graph(chains, by=["street"])
    spots = [(n, int(rng.integers(k)), float(rng.random())) for n in range(40)]
    at = spark.createDataFrame(spots, "pid long, seg_id long, t double").join(chains, "seg_id").withColumn("m", CH.measured()).select("pid", "chain_id", "m")
    got = {r["pid"]: r["n"] for r in N.network_count(at, at.withColumnRenamed("pid", "iid"), graph, start_id="pid", measures={"n": F.count(F.lit(1))}, window=250.0).collect()}
    edges = {r[1]: ((r[2], r[3]), (r[4], r[5]), math.dist(r[2:4], r[4:6])) for r in rows}
    for pid, seg, t in spots:
        a, b, length = edges[seg]
        dist, heap = {}, [(t * length, a), ((1 - t) * length, b)]
        while heap:
            d, u = heapq.heappop(heap)
            if d < dist.get(u, 1e18):
                dist[u] = d
                for p, q, w in edges.values():
                    for x, y in ((p, q), (q, p)):
                        if x == u:
                            heapq.heappush(heap, (d + w, y))
        count = 0
        for _, seg2, t2 in spots:
            c, e, w = edges[seg2]
            d = min(dist.get(c, 1e18) + t2 * w, dist.get(e, 1e18) + (1 - t2) * w)
            if seg2 == seg:
                d = min(d, abs(t - t2) * w)
            count += d <= 250.0 + 1e-9
        assert got[pid] == count


def test_crossings_touching_and_shared_runs(spark):
    rows = [("A", 1, 0, 0, 100, 0), ("A", 2, 100, 0, 200, 0), ("B", 3, 50, -10, 50, 10), ("C", 4, 200, 0, 200, 50), ("D", 5, 20, 0, 140, 0), ("A", 6, 0, 80, 10, 80), ("E", 7, 0, 90, 10, 95)]
    df = spark.createDataFrame([(a, b, *map(float, r)) for a, b, *r in rows], SEG)
    got = {(r["name_a"], r["name_b"]): (r["x"], r["y"]) for r in line_crossings(df).collect()}
    # the run A-D spans two pieces of A and counts once, in its middle
    assert got == {("A", "B"): (50, 0), ("A", "C"): (200, 0), ("A", "D"): (80, 0), ("B", "D"): (50, 0)}


def test_gaps_do_not_depend_on_stretch_width(spark):
    pts = spark.createDataFrame([("S", float(m)) for m in (10, 10, 45, 900, 905)], "street string, m double")
    lines = spark.createDataFrame([("S", 1000.0), ("T", 70.0)], "street string, chain_len double")
    for width in (7.0, 100.0, 5000.0):
        gaps = CH.spacing_and_gaps(pts, lines, by=["street"], width=width)
        assert sorted(r["gap"] for r in gaps.where("street = 'S'").collect()) == [0, 5, 10, 35, 95, 855]
        best = {r["street"]: r for r in CH.longest_gap(gaps, by=["street"]).collect()}
        assert (best["S"]["gap_from"], best["S"]["gap_to"], best["T"]["longest_gap"]) == (45, 900, 70)


def test_global_rank_and_percentiles(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=500), np.zeros(300)])
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "id long, v double")
    ranked = global_rank(df, [F.col("v").desc(), F.col("id")]).toPandas().sort_values("rank")
    assert list(ranked["rank"]) == list(range(1, len(v) + 1)) and list(ranked.id) == sorted(range(len(v)), key=lambda i: (-v[i], i))
    got = {r["share"]: r["value"] for r in percentiles(df, "v", [0, 0.1, 0.5, 0.99, 1]).collect()}
    for q, x in got.items():
        assert x == pytest.approx(np.quantile(v, q), abs=1e-12)


def test_least_gaps_of_large_clusters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for line, far in (("a", 3.0), ("b", 700.0), ("c", 9000.0)):  # two clusters of 3000 places side by side
        for cluster, shift in ((1, 0.0), (2, 2000.0 + far)):
            rows += [(line, cluster, float(x + shift), float(y)) for x, y in zip(rng.uniform(0, 2000, 3000), rng.uniform(0, 2000, 3000))]
    rows += [("d", c, float(x), float(y)) for c, (x, y) in enumerate(rng.uniform(0, 5000, (300, 2)))]  # every place its own
    rows += [("e", 1, 0.0, 0.0), ("e", 1, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "street string, cluster long, x double, y double")
    got = {r.street: r.nearest_gap for r in N.least_gaps(points, by=["street"]).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for line, gap in got.items():
        own = [(c, x, y) for s, c, x, y in rows if s == line]
        c, x, y = (np.array(v) for v in zip(*own))
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        assert gap == pytest.approx(d[c[:, None] != c].min(), abs=1e-9)
