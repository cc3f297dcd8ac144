"""Roads as connected clusters and distances along them (GR4-GR9)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.operators.graph import cluster_points, connected_components
from curbline.operators.scan import interval_sums
from curbline.session import cut

TOUCH = 1.0
REAL_GAP = 15.0
WINDOW = 300.0


def chain_ends(chains: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Both end points of every chain: ``*by, chain_id, chain_len, end (0/1), x, y, end_id``."""
    at = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ahead = F.col("m_dir") > 0
    low_m = F.when(ahead, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    marked = chains.select(*by, "chain_id", "chain_len", low_m.alias("_m"), F.when(ahead, at(1)).otherwise(at(2)).alias("_a"), F.when(ahead, at(2)).otherwise(at(1)).alias("_b"))
    first, last = F.min(F.struct("_m", "_a")), F.max(F.struct("_m", "_b"))
    ends = marked.groupBy(*by, "chain_id").agg(F.max("chain_len").alias("chain_len"), first.getField("_a").alias("_a"), last.getField("_b").alias("_b"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("_a").alias("p")), F.struct(F.lit(1).alias("end"), F.col("_b").alias("p"))))
    return ends.select(*by, "chain_id", "chain_len", both.alias("_e")).select(
        *by, "chain_id", "chain_len", F.col("_e.end").alias("end"), F.col("_e.p.x").alias("x"), F.col("_e.p.y").alias("y"),
        (F.col("chain_id") * 2 + F.col("_e.end")).alias("end_id"),
    )


def road_graph(chains: DataFrame, *, by: Sequence[str], touch: float = TOUCH) -> DataFrame:
    """One row per chain: ``*by, chain_id, chain_len, node_a, node_b, cluster`` (GR4).

    Ends at most ``touch`` apart are one node; chains that share nodes are one cluster.
    """
    ends = cut(chain_ends(chains, by=by))
    nodes = cluster_points(ends, touch, point_id="end_id", by=by, out="node")
    placed = ends.join(nodes, "end_id")
    graph = placed.groupBy(*by, "chain_id").agg(
        F.max("chain_len").alias("chain_len"), F.min(F.when(F.col("end") == 0, F.col("node"))).alias("node_a"), F.min(F.when(F.col("end") == 1, F.col("node"))).alias("node_b")
    )
    graph = cut(graph)
    comps = connected_components(graph.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    named = graph.join(comps, graph["node_a"] == comps["vertex"], "left")
    # node labels are end ids (2 * chain + end), so a cluster label is its smallest chain
    return cut(named.select(*graph.columns, F.floor(F.coalesce("component", "node_a") / 2).alias("cluster")))


def real_gaps(chains: DataFrame, graph: DataFrame, *, by: Sequence[str], gap: float = REAL_GAP) -> DataFrame:
    """Per line: number of chains and clusters, and whether even the nearest two clusters lie
    more than ``gap`` apart."""
    ends = chain_ends(chains, by=by).join(graph.select("chain_id", "cluster"), "chain_id").select(*by, "cluster", "x", "y")
    many = graph.groupBy(*by).agg(F.count(F.lit(1)).alias("chains"), F.count_distinct("cluster").alias("clusters"))
    least = least_gaps(ends, by=by, first=4 * TOUCH)
    return many.join(least, list(by), "left").withColumn("real_gap", F.coalesce(F.col("nearest_gap") > gap, F.lit(False)))


def least_gaps(points: DataFrame, *, by: Sequence[str], tag: str = "cluster", first: float = 4.0) -> DataFrame:
    """Per line with several ``tag`` values the least distance of two points of different ones: ``*by, nearest_gap``.

    Cells of a width that starts at ``first`` and grows fourfold: places whose neighbouring cells hold two tags are compared
    there, until a pair at most one width apart is found, as no pair outside neighbouring cells is nearer. They are compared
    as cells first, which are divided as long as they may hold the nearest pair, so neither the inside of a large cluster nor
    a wide gap between two large ones costs pairs of points.
    """
    by = list(by)
    left = cut(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*by, tag, "x", "y").distinct())
    lines = left.groupBy(*by).agg(F.min(tag).alias("_lo"), F.max(tag).alias("_hi"), *[f(c).alias(f"_{name}_{c}") for c in "xy" for name, f in (("min", F.min), ("max", F.max))]).where("_lo <> _hi")
    span = lines.agg(F.max(F.greatest(F.col("_max_x") - F.col("_min_x"), F.col("_max_y") - F.col("_min_y")))).first()[0]
    left = cut(left.join(lines.select(*by), by, "left_semi"))
    cell, ends = [*by, "_cx", "_cy"], [("a", tag), ("b", "_tag")]

    def beside(df: DataFrame) -> DataFrame:
        shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        return df.withColumn("_o", shifts).withColumns({"_cx": F.col("_cx") + F.col("_o.i"), "_cy": F.col("_cy") + F.col("_o.j")}).drop("_o")

    def placed(df: DataFrame, side: float, mark: str) -> DataFrame:
        return df.withColumns({f"_{mark}{c}": F.floor(F.col(c) / side) for c in "xy"})

    def possible(pairs: DataFrame, side: float, width: float) -> DataFrame:
        """Pairs of cells that may hold the nearest two points of their line."""
        apart = [F.abs(F.col(f"_a{c}") - F.col(f"_b{c}")) for c in "xy"]
        low, high = [sum((g * g for g in gaps), F.lit(0)) * (side * side) for gaps in ([F.greatest(g - 1, F.lit(0)) for g in apart], [g + 1 for g in apart])]
        pairs = cut(pairs.withColumns({"_low": low, "_high": high}).where(F.col("_low") <= width * width))
        least = pairs.groupBy(*by).agg(F.min("_high").alias("_least"))
        return pairs.join(least, by).where(F.col("_low") <= F.col("_least")).select(*by, tag, "_tag", "_ax", "_ay", "_bx", "_by")

    found, width = [], first
    while span is not None:
        spots = placed(left, width, "c")
        tags = spots.groupBy(*cell).agg(F.min(tag).alias("_lo"), F.max(tag).alias("_hi"))
        mixed = beside(tags).groupBy(*cell).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo <> _hi").select(*cell)
        near, side = cut(spots.join(mixed, cell, "left_semi")), width / 4
        if near.isEmpty() and width <= 2 * span:
            width *= 4
            continue
        one = placed(near, side, "a").select(*cell, tag, "_ax", "_ay").distinct()
        other = one.withColumnsRenamed({tag: "_tag", "_ax": "_bx", "_ay": "_by"})
        pairs = possible(beside(one).join(other, cell).where(F.col(tag) < F.col("_tag")), side, width)
        while side > first:
            for mark, own in ends:
                parts = placed(placed(near, side, mark), side / 4, "n").select(*by, F.col(tag).alias(own), f"_{mark}x", f"_{mark}y", "_nx", "_ny").distinct()
                pairs = pairs.join(parts, [*by, own, f"_{mark}x", f"_{mark}y"]).drop(f"_{mark}x", f"_{mark}y").withColumnsRenamed({"_nx": f"_n{mark}x", "_ny": f"_n{mark}y"})
            side /= 4
            pairs = possible(pairs.withColumnsRenamed({f"_n{m}{c}": f"_{m}{c}" for m in "ab" for c in "xy"}), side, width)
        for mark, own in ends:
            whole = placed(near, side, mark).select(*by, F.col(tag).alias(own), f"_{mark}x", f"_{mark}y", F.struct("x", "y").alias(f"_{mark}"))
            pairs = pairs.join(whole, [*by, own, f"_{mark}x", f"_{mark}y"])
        gx, gy = F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y")
        best = pairs.groupBy(*by).agg(F.sqrt(F.min(gx * gx + gy * gy)).alias("nearest_gap"))
        found.append(cut(best.where(F.col("nearest_gap") <= width)))
        left = left.join(found[-1], by, "left_anti")
        if width > 2 * span or left.isEmpty():
            break
        width *= 4
    empty = lines.select(*by, F.lit(None).cast("double").alias("nearest_gap")).where("false")
    return reduce(DataFrame.unionByName, found, empty)


def graph_nodes(chains: DataFrame, graph: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """One row per node: ``node, x, y`` (least corner of its ends), ``ends``, ``opening``.

    ``opening`` marks the place where a closed line was cut open: both ends of one chain at one point, and no other end.
    Such a place is no junction of the road.
    """
    named = graph.select("chain_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("node_a").alias("node")), F.struct(F.lit(1).alias("end"), F.col("node_b").alias("node")))).alias("_n"))
    ends = chain_ends(chains, by=by).join(named.select("chain_id", "_n.end", "_n.node"), ["chain_id", "end"])
    spot = F.struct(F.round(F.col("x") * 1000).alias("x"), F.round(F.col("y") * 1000).alias("y"))
    closed = (F.count(F.lit(1)) == 2) & (F.min("chain_id") == F.max("chain_id")) & (F.min(spot) == F.max(spot))
    return ends.groupBy("node").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count(F.lit(1)).alias("ends"), closed.alias("opening"))


def network_distance(starts: DataFrame, graph: DataFrame, *, start_id: str, window: float = WINDOW, bands: int = 4) -> DataFrame:
    """Shortest distance along the road from each start to every node within ``window`` (GR5).

    ``starts``: ``start_id, chain_id, m``. Relaxation by distance bands: the labels of a band are settled among
    themselves, then put aside; nothing that comes later can improve them, so they are neither joined nor grouped again
    until the end. A round extends only labels that just improved, never back to where they came from. A node that is
    met again in a later band is one more label there, which the last grouping drops.
    """
    own = starts.join(graph.select("chain_id", "chain_len", "node_a", "node_b"), "chain_id")
    first = F.array(
        F.struct(F.col("node_a").alias("node"), F.col("m").alias("d")),
        F.struct(F.col("node_b").alias("node"), (F.col("chain_len") - F.col("m")).alias("d")),
    )
    seeds = own.select(start_id, F.explode(first).alias("_s")).select(start_id, "_s.node", "_s.d", F.lit(None).cast("bigint").alias("via")).where(F.col("d") <= window)
    edges = graph.select(F.col("node_a").alias("node"), F.col("node_b").alias("_to"), "chain_len")
    edges = edges.unionByName(graph.select(F.col("node_b").alias("node"), F.col("node_a").alias("_to"), "chain_len"))
    edges = cut(edges.where("node <> _to").groupBy("node", "_to").agg(F.min("chain_len").alias("chain_len")))

    def least(labels: DataFrame) -> DataFrame:
        best = labels.groupBy(start_id, "node").agg(F.min(F.struct("d", "via")).alias("_l"))
        return best.select(start_id, "node", "_l.d", "_l.via")

    waiting, settled = [seeds], []
    for k in range(1, bands + 1):
        high = window * k / bands
        below = (F.col("d") <= high) if k == bands else (F.col("d") < high)
        waiting = [cut(least(reduce(DataFrame.unionByName, waiting)))]
        band = front = waiting[0].where(below)
        waiting = [waiting[0].where(~below)]
        while True:
            reach = front.join(edges, "node").where(~F.col("_to").eqNullSafe(F.col("via")))
            reach = reach.select(start_id, F.col("_to").alias("node"), (F.col("d") + F.col("chain_len")).alias("d"), F.col("node").alias("via"))
            reach = cut(least(reach.where(F.col("d") <= window)))
            waiting.append(reach.where(~below))
            known = band.select(start_id, "node", F.col("d").alias("_old"))
            better = reach.where(below).join(known, [start_id, "node"], "left").where(F.col("_old").isNull() | (F.col("d") < F.col("_old"))).drop("_old")
            front = cut(better)
            if front.isEmpty():
                break
            band = cut(least(band.unionByName(front)))
        settled.append(band.select(start_id, "node", "d"))
    return cut(reduce(DataFrame.unionByName, settled).groupBy(start_id, "node").agg(F.min("d").alias("d")))


def reach_intervals(starts: DataFrame, graph: DataFrame, *, start_id: str, window: float = WINDOW) -> DataFrame:
    """Disjoint measure intervals of chains within ``window`` along the road from each start."""
    dist = network_distance(starts, graph, start_id=start_id, window=window)
    slim = graph.select("chain_id", "chain_len", "node_a", "node_b")
    around = starts.join(slim.select("chain_id", "chain_len"), "chain_id").select(
        start_id, "chain_id", F.greatest(F.col("m") - window, F.lit(0.0)).alias("lo"), F.least(F.col("m") + window, F.col("chain_len")).alias("hi")
    )
    rest = F.lit(window) - F.col("d")
    from_a = dist.join(slim, dist["node"] == slim["node_a"]).select(start_id, "chain_id", F.lit(0.0).alias("lo"), F.least(rest, F.col("chain_len")).alias("hi"))
    from_b = dist.join(slim, dist["node"] == slim["node_b"]).select(start_id, "chain_id", F.greatest(F.col("chain_len") - rest, F.lit(0.0)).alias("lo"), F.col("chain_len").alias("hi"))
    parts = around.unionByName(from_a).unionByName(from_b).distinct()
    # at most a few intervals per start and chain
    line = Window.partitionBy(start_id, "chain_id").orderBy("lo", "hi")
    seen = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", F.when(F.col("lo") <= seen, F.lit(0)).otherwise(F.lit(1)))
    parts = parts.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(start_id, "chain_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def network_count(starts: DataFrame, incidents: DataFrame, graph: DataFrame, *, start_id: str, measures: dict[str, Column], window: float = WINDOW) -> DataFrame:
    """Sums of incident ``measures`` within ``window`` along the road of each start (GR6).

    ``incidents``: ``chain_id, m`` plus the columns the (integer) measures need. Incidents at one
    position are folded first; every interval then takes two lookups in a running total, so
    that no pair of a start and a position is ever built.
    """
    spots = incidents.groupBy("chain_id", "m").agg(*[v.alias(k) for k, v in measures.items()])
    pieces = reach_intervals(starts, graph, start_id=start_id, window=window)
    sums = interval_sums(pieces, spots, interval_id=start_id, by=["chain_id"], measures=list(measures))
    return starts.select(start_id).join(sums, start_id, "left").fillna(0, list(measures))


def window_frontier(starts: DataFrame, graph: DataFrame, *, start_id: str, window: float = WINDOW) -> DataFrame:
    """Places exactly ``window`` along the road from each start (GR7): ``start_id, chain_id, m``.

    A place counts only if no shorter way leads to it, so chains that are reached from both ends have one or none.
    """
    dist = network_distance(starts, graph, start_id=start_id, window=window)
    slim = graph.select("chain_id", "chain_len", "node_a", "node_b")
    none = F.lit(None).cast("double")
    ways = starts.select(start_id, "chain_id", "m", none.alias("da"), none.alias("db"))
    ways = ways.unionByName(dist.join(slim, dist["node"] == slim["node_a"]).select(start_id, "chain_id", none.alias("m"), F.col("d").alias("da"), none.alias("db")))
    ways = ways.unionByName(dist.join(slim, dist["node"] == slim["node_b"]).select(start_id, "chain_id", none.alias("m"), none.alias("da"), F.col("d").alias("db")))
    ways = ways.groupBy(start_id, "chain_id").agg(*[F.min(c).alias(c) for c in ("m", "da", "db")]).join(slim.select("chain_id", "chain_len"), "chain_id")
    size = F.col("chain_len")
    spots = [(F.col("m") - window, True), (F.col("m") + window, True), (F.lit(window) - F.col("da"), False), (size - (F.lit(window) - F.col("db")), False)]
    spots = F.explode(F.array(*[F.struct(at.alias("at"), F.lit(own).alias("own")) for at, own in spots]))
    placed = ways.withColumn("_p", spots).withColumn("_at", F.col("_p.at"))
    inside = F.when(F.col("_p.own"), (F.col("_at") >= 0) & (F.col("_at") <= size)).otherwise((F.col("_at") > 0) & (F.col("_at") < size))
    shortest = F.least(F.col("da") + F.col("_at"), F.col("db") + size - F.col("_at"), F.abs(F.col("_at") - F.col("m")))  # nulls are left out
    kept = placed.where(inside & (shortest >= window - 1e-6))
    return kept.groupBy(start_id, "chain_id", F.round(F.col("_at") * 1000).alias("_mm")).agg(F.min("_at").alias("m")).drop("_mm")


def frontier_summary(starts: DataFrame, frontier: DataFrame, *, start_id: str) -> DataFrame:
    """Number of window ends per start; fewer than two means the window is clamped."""
    ends = frontier.groupBy(start_id).agg(F.count(F.lit(1)).alias("window_ends"))
    return starts.select(start_id).join(ends, start_id, "left").fillna(0, ["window_ends"]).withColumn("clamped", F.col("window_ends") < 2)


def sample_points(chains: DataFrame, *, first: float = 60.0, step: float = 120.0) -> DataFrame:
    """Points every ``step`` metres of each chain, from ``first``: ``sample_id, chain_id, m, x, y``."""
    low = F.when(F.col("m_dir") > 0, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    high = low + F.col("len")
    spans = chains.withColumns({"_k0": F.greatest(F.lit(0), F.ceil((low - first) / step)), "_k1": F.ceil((high - first) / step) - 1, "_lo": low})
    # half-open spans, so that a point on a joint belongs to one piece
    spans = spans.where("_k0 <= _k1").withColumn("_k", F.explode(F.sequence("_k0", "_k1")))
    m = F.lit(first) + F.col("_k") * step
    share = F.when(F.col("m_dir") > 0, (m - F.col("_lo")) / F.col("len")).otherwise(1.0 - (m - F.col("_lo")) / F.col("len"))
    spans = spans.withColumns({"m": m, "_s": share})
    return spans.select(
        F.concat_ws("-", "chain_id", "_k").alias("sample_id"), "chain_id", "m",
        (F.col("x1") + F.col("_s") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("_s") * (F.col("y2") - F.col("y1"))).alias("y"),
    )


def branch_stubs(graph: DataFrame, incidents: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Lines whose clusters join several chains, with incidents off the primary chain (GR9): the longest, to the
    millimetre, and of equals that of the smallest id."""
    counts = incidents.groupBy("chain_id").agg(F.count(F.lit(1)).alias("_n"))
    full = graph.join(counts, "chain_id", "left").fillna(0, ["_n"])
    primary = F.min(F.struct((-F.round("chain_len", 3)).alias("l"), F.col("chain_id").alias("c"), F.col("_n").alias("n")))
    per = full.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("_chains"), F.sum("_n").alias("_all"), primary.getField("n").alias("_main"))
    folded = F.sum(F.when(F.col("_chains") >= 2, F.col("_all") - F.col("_main")).otherwise(F.lit(0)))
    out = per.groupBy(*by).agg(F.sum("_chains").alias("chains"), F.count(F.lit(1)).alias("clusters"), F.max("_chains").alias("_most"), folded.alias("folded_incidents"))
    return out.where("_most >= 2").drop("_most")
