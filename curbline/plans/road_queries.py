"""Registered queries, part 2: rules, graph, linear referencing, search, refresh, sources, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbline.functions import columns as C
from curbline.functions.geometry import METRES_PER_FOOT
from curbline.functions.geometry import decimetres as dm
from curbline.operators import aggregates as A
from curbline.operators import chains as CH
from curbline.operators import corridors as K
from curbline.operators import network as N
from curbline.operators import refresh as I
from curbline.operators import rules as R
from curbline.operators import search as S
from curbline.operators.graph import cluster_points, connected_components
from curbline.operators.spatial import nearest
from curbline.plans import checks as Q
from curbline.plans.queries import _FIRST, _MONTHS, _TWO_ROADS, FATAL, GOOD, query
from curbline.plans.scene import CITY_BOX, Scene
from curbline.session import cut, scratch_dir
from curbline.sources import readers, writers
from curbline.streaming import generations, ingest

# --- 2.8 rules ---------------------------------------------------------------------------------


@query("rl01_tag_segments", "SELECT seg_id, owner, rule FROM rulebook")
def _(s: Scene):
    return s.rulebook.select("seg_id", "owner", "rule")


# The sentences of rules.py, typed anew as the check's own statement of them.
@query("rl02_basis", "SELECT seg_id, CASE rule WHEN 'interstate_mainline' THEN 'interstate: MTFCC S1100' WHEN 'interstate_ramp' THEN 'interstate ramp: MTFCC S1630' WHEN 'limited_access_override' THEN concat('limited-access override: ', predir, ' ', upper(substr(name, 1, 1)), lower(substr(name, 2)), ' ', upper(substr(type, 1, 1)), lower(substr(type, 2))) "
       "WHEN 'state_route_overlap' THEN concat('state route: ', CAST(CAST(round_even(100 * ov10, 0) AS BIGINT) AS VARCHAR), '% overlap, name=', name_key) WHEN 'force_state_route_manual' THEN 'force-state-route: manual override' "
       "WHEN 'force_state_route_completeness' THEN concat('force-state-route: ', CAST(CAST(round_even(100 * ov_same, 0) AS BIGINT) AS VARCHAR), '% collinear w/ same-named SR (', name_key, ')') ELSE 'city: no state-route overlap' END AS basis FROM rulebook")
def _(s: Scene):
    return s.rulebook.select("seg_id", "basis")


@query("rl03_doubtful_segments", "SELECT seg_id, is_doubtful FROM rulebook")
def _(s: Scene):
    return s.rulebook.select("seg_id", "is_doubtful")


@query("rl04_classify_incidents", f"SELECT incident_id, seg_id, owner, rule, street, {Q.dm('seg_m')} AS seg_dm, {Q.dm('route_m')} AS route_dm, is_limited, is_override, is_corner FROM classified")
def _(s: Scene):
    return s.classified.select("incident_id", "seg_id", "owner", "rule", "street", dm("seg_m").alias("seg_dm"), dm("route_m").alias("route_dm"), "is_limited", "is_override", "is_corner")


@query("rl05_first_pass", f"SELECT incident_id, owner, in_city, CASE WHEN owner = 'State route' THEN route_id END AS route_id FROM {_FIRST} f")
def _(s: Scene):
    return R.first_pass_classify(s.stored, s.boundary, s.routes, box=CITY_BOX).select("incident_id", "owner", "in_city", "route_id")


@query("rl06_intersection_status", f"SELECT incident_id, at_intersection, intersection_node_id, {Q.dm('nearest_ped_signal_m')} AS signal_dm, is_ambiguous, intersection_signalized FROM signal_status")
def _(s: Scene):
    return s.signal_status.select("incident_id", "at_intersection", "intersection_node_id", dm("nearest_ped_signal_m").alias("signal_dm"), "is_ambiguous", "intersection_signalized")


@query("rl07_audit_verdict", f"SELECT c.incident_id, c.street, r.name AS route_name, {Q.dm('m.dist')} AS route_dm, CASE WHEN contains(c.street, r.name) AND m.dist < 12 THEN 'under-tagged' ELSE 'city correct' END AS verdict FROM classified c JOIN incident_route m USING (incident_id) JOIN routes r ON r.route_id = m.route_id")
def _(s: Scene):
    out = R.audit_verdict(s.classified, s.routes)
    return out.select("incident_id", "street", "route_name", dm("route_m").alias("route_dm"), "verdict")


@query("rl08_interstate_reclass", "SELECT n.incident_id, mtfcc = 'S1100' AND seg_m <= 30 AS on_interstate, k.dist <= 30 AND mtfcc <> 'S1630' AS naive_interstate, k.dist <= 30 AND mtfcc <> 'S1630' AND NOT (mtfcc = 'S1100' AND seg_m <= 30) AS over_captured FROM named n JOIN ("
       + Q.nearest_piece("incidents", "incident_id", "(SELECT * FROM streets WHERE mtfcc = 'S1100')", "seg_id") + ") k USING (incident_id)")
def _(s: Scene):
    out = R.interstate_reclass(s.named, s.streets.where("mtfcc = 'S1100'"))
    return out.select("incident_id", "on_interstate", "naive_interstate", "over_captured")


# --- graph -------------------------------------------------------------------------------------


@query("gr01_cluster_points", "SELECT v AS signal_id, c AS cluster FROM signal_cluster")
def _(s: Scene):
    return cluster_points(s.signals, 30.0, point_id="signal_id")


@query("gr02_connected_components", "SELECT a AS piece, min(b) AS component FROM net_piece_reach GROUP BY a")
def _(s: Scene):
    at = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ends = s.streets.select("predir", F.col("seg_id").alias("piece"), F.explode(F.array(at(1), at(2))).alias("p"))
    # pieces that share an end point: each is linked to the smallest of them
    least = ends.groupBy("predir", "p").agg(F.min("piece").alias("low"))
    links = ends.join(least, ["predir", "p"]).where("piece <> low").select(F.col("piece").alias("a"), F.col("low").alias("b"))
    comps = connected_components(links)
    every = s.streets.select(F.col("seg_id").alias("piece"))
    return every.join(comps, every["piece"] == comps["vertex"], "left").select("piece", F.coalesce("component", "piece").alias("component"))


@query("gr03_junction_nodes", f"SELECT node_id, {Q.dm('x')} AS x_dm, {Q.dm('y')} AS y_dm, streets, n_streets FROM nodes")
def _(s: Scene):
    return s.nodes.select("node_id", dm("x").alias("x_dm"), dm("y").alias("y_dm"), F.array_join("streets", "; ").alias("streets"), "n_streets")


@query("gr03_signalized_nodes", f"SELECT node_id, {Q.dm('nearest_crossing_m')} AS crossing_dm, signalized, on_covered FROM marked_nodes")
def _(s: Scene):
    return s.marked_nodes.select("node_id", dm("nearest_crossing_m").alias("crossing_dm"), "signalized", "on_covered")


@query("gr04_road_clusters", "SELECT p.predir, count(DISTINCT c) AS clusters, count(*) AS pieces FROM (SELECT seg_id, predir, min(o) AS c FROM (SELECT p.seg_id, p.predir, r.b AS o FROM pieces p JOIN net_touch_reach r ON r.a = p.seg_id) q GROUP BY ALL) p GROUP BY p.predir")
def _(s: Scene):
    whole = s.net_chains.join(s.net.select("chain_id", "cluster"), "chain_id")
    return whole.groupBy("predir").agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("pieces"))


@query("gr04_real_gaps", f"SELECT predir, chains, clusters, {Q.dm('gap')} AS gap_dm, gap > 15 AS real_gap FROM (SELECT predir, count(DISTINCT c) AS clusters FROM net_piece_cluster GROUP BY predir) k JOIN (SELECT predir, CAST(count(*) // 2 AS BIGINT) AS chains FROM net_chain_end GROUP BY predir) n USING (predir) "
       f"JOIN (SELECT a.predir, min(sqrt({Q.gap2()})) AS gap FROM net_chain_end a JOIN net_chain_end b ON a.predir = b.predir AND a.c <> b.c GROUP BY a.predir) g USING (predir)")
def _(s: Scene):
    out = N.real_gaps(s.net_chains, s.net, by=["predir"])
    return out.select("predir", "chains", "clusters", dm("nearest_gap").alias("gap_dm"), "real_gap")


_REAL_NODES = "(SELECT c, min(x) AS x, min(y) AS y FROM net_node n JOIN net_ends e ON e.e = n.v GROUP BY c HAVING count(*) <> 2 OR count(DISTINCT (round(x * 1000), round(y * 1000))) > 1)"


@query("gr05_network_distance", f"SELECT signal_id, {Q.dm('n.x')} AS node_x_dm, {Q.dm('n.y')} AS node_y_dm, {Q.dm('d')} AS d_dm FROM net_dist w JOIN {_REAL_NODES} n ON n.c = w.node")
def _(s: Scene):
    far = N.network_distance(s.places(s.net_chains).select("signal_id", "chain_id", "m"), s.net, start_id="signal_id")
    far = far.join(N.graph_nodes(s.net_chains, s.net, by=["predir"]).where("NOT opening"), "node")
    return far.select("signal_id", dm("x").alias("node_x_dm"), dm("y").alias("node_y_dm"), dm("d").alias("d_dm"))


@query("gr06_network_count", f"SELECT p.signal_id, count(h.incident_id) AS crashes, count(h.incident_id) FILTER (WHERE h.severity = 'Fatal') AS fatal FROM signals p LEFT JOIN net_hit h USING (signal_id) GROUP BY p.signal_id")
def _(s: Scene):
    starts = s.places(s.net_chains).select("signal_id", "chain_id", "m")
    return N.network_count(starts, s.net_incidents, s.net, start_id="signal_id", measures={"crashes": F.count(F.lit(1)), "fatal": A.n_fatal()})


@query("gr07_window_frontier", f"SELECT signal_id, CAST((m >= 300) AS BIGINT) + CAST((m + 300 <= chain_len) AS BIGINT) AS window_ends, CAST((m >= 300) AS BIGINT) + CAST((m + 300 <= chain_len) AS BIGINT) < 2 AS clamped FROM (SELECT g.signal_id, c.chain_len, c.m_start + g.t * c.len AS m FROM signal_segment g JOIN chains c USING (seg_id)) q")
def _(s: Scene):
    starts = s.places(s.chains).select("signal_id", "chain_id", "m")
    return N.frontier_summary(starts, N.window_frontier(starts, s.graph, start_id="signal_id"), start_id="signal_id")


_EDGE_SPOTS = """(SELECT d.signal_id, e.seg_id, 300 - d.d AS pos FROM net_dist d JOIN net_edges e ON e.na = d.node
 UNION SELECT d.signal_id, e.seg_id, e.len - (300 - d.d) FROM net_dist d JOIN net_edges e ON e.nb = d.node UNION SELECT signal_id, seg_id, d0 - 300 FROM net_start UNION SELECT signal_id, seg_id, d0 + 300 FROM net_start)"""


@query("gr07_frontier_places", f"SELECT z.signal_id, {Q.dm('p.x1 + (p.x2 - p.x1) * pos / p.len')} AS x_dm, {Q.dm('p.y1 + (p.y2 - p.y1) * pos / p.len')} AS y_dm FROM {_EDGE_SPOTS} z JOIN net_edges e USING (seg_id) JOIN pieces p USING (seg_id) "
       "LEFT JOIN net_dist a ON a.signal_id = z.signal_id AND a.node = e.na LEFT JOIN net_dist b ON b.signal_id = z.signal_id AND b.node = e.nb LEFT JOIN net_start o ON o.signal_id = z.signal_id AND o.seg_id = z.seg_id "
       "WHERE pos > 0 AND pos < e.len AND least(coalesce(a.d + pos, 1e18), coalesce(b.d + e.len - pos, 1e18), coalesce(abs(pos - o.d0), 1e18)) >= 300 - 1e-6")
def _(s: Scene):
    ends = N.window_frontier(s.places(s.net_chains).select("signal_id", "chain_id", "m"), s.net, start_id="signal_id")
    return CH.place(ends, s.net_chains, point_id="signal_id").select("signal_id", dm("x").alias("x_dm"), dm("y").alias("y_dm"))


@query("gr08_network_vs_radius", "SELECT sample_id, by_network, by_radius FROM (SELECT s.sample_id, count(*) FILTER (WHERE abs(i.m - s.m) <= 300) AS by_network, count(*) FILTER (WHERE (i.x - s.x) * (i.x - s.x) + (i.y - s.y) * (i.y - s.y) <= 90000) AS by_radius FROM "
       "(SELECT concat(chain_id, '-', k) AS sample_id, chain_id, 60e0 + k * 120e0 AS m, x1 + (60e0 + k * 120e0 - m_start) / len * (x2 - x1) AS x, y1 + (60e0 + k * 120e0 - m_start) / len * (y2 - y1) AS y FROM chains CROSS JOIN (SELECT unnest(generate_series(0, (SELECT CAST(ceil(max(m_start + len) / 120e0) AS BIGINT) FROM chains))) AS k) z WHERE 60e0 + k * 120e0 >= m_start AND 60e0 + k * 120e0 < m_start + len) s "
       "LEFT JOIN on_chain i USING (chain_id) GROUP BY s.sample_id) q")
def _(s: Scene):
    return K.network_vs_radius(cut(N.sample_points(s.chains)), s.on_chain, s.graph)


@query("gr09_branch_stubs", "SELECT predir, CAST(sum(chains) AS BIGINT) AS chains, count(*) AS clusters, CAST(sum(CASE WHEN chains >= 2 THEN al - main ELSE 0 END) AS BIGINT) AS folded_incidents FROM (SELECT predir, cluster, count(*) AS chains, CAST(sum(n) AS BIGINT) AS al, "
       "arg_min(n, (-round(len, 3), chain_id)) AS main FROM net_chain GROUP BY predir, cluster) q GROUP BY predir HAVING max(chains) >= 2")
def _(s: Scene):
    return N.branch_stubs(s.net, s.net_incidents, by=["predir"])


# --- linear referencing --------------------------------------------------------------------------


@query("lr01_measure", f"SELECT signal_id, seg_id, {Q.dm('m')} AS m_dm FROM (SELECT g.signal_id, g.seg_id, c.m_start + g.t * c.len AS m FROM signal_segment g JOIN chains c USING (seg_id)) q")
def _(s: Scene):
    return CH.measure(s.signals, s.chains, point_id="signal_id").select("signal_id", "seg_id", dm("m").alias("m_dm"))


@query("lr02_reference_line", f"SELECT street, chain_id, {Q.dm('chain_len')} AS length_dm FROM lines")
def _(s: Scene):
    return s.lines.select("street", "chain_id", dm("chain_len").alias("length_dm"))


@query("lr02_merged_lines", f"SELECT seg_id, chain_id, {Q.dm('m_start')} AS from_dm, {Q.dm('chain_len')} AS length_dm FROM chains")
def _(s: Scene):
    low = F.when(F.col("m_dir") > 0, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    return s.chains.select("seg_id", "chain_id", dm(low).alias("from_dm"), dm("chain_len").alias("length_dm"))


@query("lr03_along_nearest", f"SELECT incident_id, street, {Q.dm('along_m')} AS along_dm FROM related_dist")
def _(s: Scene):
    return K.crossing_distances(s.incidents, s.safe, s.ref).select("incident_id", "street", dm("along_m").alias("along_dm"))


@query("lr04_relevant_crossings", "SELECT place_id, street FROM kept_marked")
def _(s: Scene):
    return s.kept_marked.select("place_id", "street")


@query("lr04_merged_places", "SELECT c AS place, arg_min(place_id, (NOT is_line, -round(len, 3), place_id)) AS place_id, bool_or(is_line) AS is_line, count(*) FILTER (WHERE is_line) AS n_lines, count(*) FILTER (WHERE NOT is_line) AS n_points FROM drawn JOIN drawn_place ON v = place_id GROUP BY c")
def _(s: Scene):
    grown = lambda c, d: (F.col(f"{c}1") + F.col(f"{c}2")) / 2 + d * (F.col(f"{c}2") - F.col(f"{c}1")) / 2 * (1 + (F.col("k") * 7 + F.col("signal_id")) % 5)
    lines = s.walk_lines.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    lines = lines.select((F.col("signal_id") * 4 + F.col("k")).alias("place_id"), *[(grown("x", d) + F.col("k") * 3).alias(f"x{i}") for i, d in ((1, -1), (2, 1))], *[grown("y", d).alias(f"y{i}") for i, d in ((1, -1), (2, 1))])
    points = s.walk_points.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    points = points.select((F.col("signal_id") * 4 + F.col("k")).alias("place_id"), (F.col("x") + F.col("k") * (F.col("signal_id") % 13)).alias("x"), "y")
    return K.merged_places(lines, points, place_id="place_id").select("place", "place_id", "is_line", "n_lines", "n_points")


@query("lr05_junction_signals", "SELECT place_id, street FROM kept_signals")
def _(s: Scene):
    return s.kept_signals.select("place_id", "street")


@query("lr06_safe_crossings", f"SELECT safe_id, street, signalized, {Q.dm('m')} AS m_dm FROM safe")
def _(s: Scene):
    return s.safe.select("safe_id", "street", "signalized", dm("m").alias("m_dm"))


@query("lr07_distance_stats", f"SELECT street, count(*) AS incidents, {Q.n('is_fatal')} AS fatal, {Q.dm('avg(along_m)')} AS mean_dm, {Q.dm('max(along_m)')} AS max_dm, {Q.n('along_m / 0.3048e0 <= 100')} AS near, {Q.n('along_m / 0.3048e0 > 250')} AS in_gap, {Q.n('along_m / 0.3048e0 > 100 AND along_m / 0.3048e0 <= 250')} AS between_n, {Q.dm('median(along_m)')} AS median_dm FROM related_dist GROUP BY street")
def _(s: Scene):
    out = K.distance_stats(K.crossing_distances(s.stored, s.safe, s.ref))
    return out.select("street", "incidents", "fatal", dm("mean_m").alias("mean_dm"), dm("max_m").alias("max_dm"), "near", "in_gap", F.col("between").alias("between_n"), dm("median_m").alias("median_dm"))


@query("lr07_spacing_stats", f"SELECT street, {Q.dm('avg(gap) FILTER (WHERE is_inner)')} AS mean_dm, {Q.dm('median(gap) FILTER (WHERE is_inner)')} AS median_dm, {Q.dm('max(gap) FILTER (WHERE is_inner)')} AS max_dm, {Q.dm('max(gap)')} AS longest_dm, "
       f"{Q.dm('max(gap) / (300 * 0.3048e0)')} AS times_300_ft_tenths FROM gaps GROUP BY street")
def _(s: Scene):
    out = K.corridor_gaps(s.safe, s.lines)
    spacing = [dm(f"{c}_spacing").alias(f"{c}_dm") for c in ("mean", "median", "max")]
    return out.select("street", *spacing, dm("longest_gap").alias("longest_dm"), dm("gap_ratio").alias("times_300_ft_tenths"))


@query("lr08_nodes_to_safe", f"SELECT node_id, street, {Q.dm('min(abs(m - sm))')} AS along_dm FROM (SELECT p.node_id, p.street, c.m_start + {Q.foot('p', 'c')} * c.len AS m FROM node_street p JOIN chains c ON c.street = p.street QUALIFY row_number() OVER (PARTITION BY p.node_id, p.street ORDER BY {Q.d2('p', 'c')}, c.seg_id) = 1) q JOIN (SELECT street, m AS sm FROM safe) s USING (street) GROUP BY node_id, street")
def _(s: Scene):
    return K.nodes_to_safe(s.nodes, s.safe, s.ref).select("node_id", "street", dm("along_m").alias("along_dm"))


@query("lr09_incident_measures", f"SELECT incident_id, street, chain_id, {Q.dm('m')} AS m_dm FROM on_chain")
def _(s: Scene):
    own = s.named.select("incident_id", "street", "x", "y")
    hit = CH.measure(own, s.chains, point_id="incident_id", by=["street"], carry=["street"])
    return hit.select("incident_id", "street", "chain_id", dm("m").alias("m_dm"))


@query("wn03_spacing", f"SELECT street, count(*) AS gaps, {Q.dm('sum(gap)')} AS total_dm, {Q.dm('max(gap)')} AS max_dm FROM gaps WHERE is_inner GROUP BY street")
def _(s: Scene):
    gaps = CH.spacing_and_gaps(s.safe, s.lines, by=["street"]).where("inner")
    return gaps.groupBy("street").agg(F.count(F.lit(1)).alias("gaps"), dm(F.sum("gap")).alias("total_dm"), dm(F.max("gap")).alias("max_dm"))


@query("wn04_longest_gap", f"SELECT street, {Q.dm('gap')} AS gap_dm, {Q.dm('from_m')} AS from_dm, {Q.dm('to_m')} AS to_dm FROM gaps QUALIFY row_number() OVER (PARTITION BY street ORDER BY round(gap, 3) DESC, from_m) = 1")
def _(s: Scene):
    out = K.corridor_gaps(s.safe, s.lines)
    return out.select("street", dm("longest_gap").alias("gap_dm"), dm("gap_from").alias("from_dm"), dm("gap_to").alias("to_dm"))


_RUNS = "(SELECT street, st, m_start, len, sum(CASE WHEN st = prev THEN 0 ELSE 1 END) OVER (PARTITION BY street ORDER BY m_start) AS run FROM (SELECT c.street, c.m_start, c.len, b.owner AS st, lag(b.owner) OVER (PARTITION BY c.street ORDER BY c.m_start) AS prev FROM chains c JOIN rulebook b USING (seg_id)) a)"


@query("wn06_status_runs", f"SELECT street, st AS owner, {Q.dm('min(m_start)')} AS from_dm, {Q.dm('max(m_start + len)')} AS to_dm, count(*) AS pieces FROM {_RUNS} r GROUP BY street, run, st")
def _(s: Scene):
    low = F.when(F.col("m_dir") > 0, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    at = s.chains.join(s.rulebook.select("seg_id", "owner"), "seg_id").withColumns({"m_low": low, "m_high": low + F.col("len")})
    runs = CH.status_runs(at, by=["street"], status=["owner"], width=500.0)
    return runs.select("street", "owner", dm("run_from").alias("from_dm"), dm("run_to").alias("to_dm"), "pieces")


# --- fact tables -----------------------------------------------------------------------------------


_RECENT_COLUMNS = [f"{w}_{kind}" for w in ("all", "m12", "m6", "m3", "m1") for kind in ("n", "fatal")]
_RECENT = ", ".join(f"coalesce(t.{c}, 0) AS {c}" for c in _RECENT_COLUMNS)
_LIMITS = ", ".join(f"max(incident_date) - INTERVAL {m} MONTH AS lim{m}" for m in (12, 6, 3, 1))


@query("lc01_location_facts", f"SELECT g.signal_id, s.street, b.owner AS road_owner, {Q.dm('g.dist')} AS snap_dm, w.has_sidewalk, coalesce(k.n, 0) AS window_crashes, coalesce(k.f, 0) AS window_fatal, {Q.dm('l.chain_len')} AS connected_dm, CASE WHEN d.dist <= 35 THEN d.node_id END AS node_id, CASE WHEN d.dist <= 35 THEN {Q.dm('d.dist')} END AS node_dm, y.next_road, y.next_dm, y.is_ambiguous, y.is_far, v.owner_varies, {_RECENT} FROM signal_segment g JOIN streets s USING (seg_id) JOIN rulebook b ON b.seg_id = g.seg_id JOIN lines l ON l.street = s.street "
       "JOIN (SELECT p.seg_id, coalesce(h.dist <= 20, false) AS has_sidewalk FROM streets p LEFT JOIN (" + Q.nearest_piece("(SELECT seg_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM streets)", "seg_id", "sidewalks", "walk_id") + ") h USING (seg_id)) w ON w.seg_id = g.seg_id "
       f"LEFT JOIN (SELECT z.signal_id, count(*) AS n, count(*) FILTER (WHERE severity = 'Fatal') AS f FROM (SELECT g.signal_id, c.street, c.m_start + g.t * c.len AS m FROM signal_segment g JOIN chains c USING (seg_id)) z JOIN on_chain i ON i.street = z.street AND abs(i.m - z.m) <= 300 GROUP BY z.signal_id) k ON k.signal_id = g.signal_id "
       f"LEFT JOIN (SELECT street, count(*) AS all_n, {Q.n(FATAL)} AS all_fatal, {_MONTHS} FROM named CROSS JOIN (SELECT {_LIMITS} FROM incidents) e GROUP BY street) t ON t.street = s.street JOIN ({_TWO_ROADS}) y ON y.signal_id = g.signal_id "
       "JOIN (SELECT street, count(DISTINCT owner) > 1 AS owner_varies FROM rulebook GROUP BY street) v ON v.street = s.street "
       f"LEFT JOIN ({Q.nearest_place('signals', 'signal_id', 'nodes', 'node_id')}) d ON d.signal_id = g.signal_id")
def _(s: Scene):
    facts = K.location_facts(s.signals, s.chains, s.graph, s.on_chain, s.rulebook.select("seg_id", "owner"), s.sidewalks, s.nodes, place_id="signal_id")
    return facts.select("signal_id", "street", "road_owner", dm("snap_m").alias("snap_dm"), "has_sidewalk", "window_crashes", "window_fatal", dm("connected_m").alias("connected_dm"), "node_id", dm("node_m").alias("node_dm"), "next_road", dm("next_dist").alias("next_dm"), "is_ambiguous", "is_far", "owner_varies", *_RECENT_COLUMNS)


@query("lc02_corridor_facts", f"SELECT x.street, r.rank, coalesce(r.total, 0) AS total, coalesce(r.fatal, 0) AS fatal, coalesce(o.city, 0) AS city_crashes, coalesce(o.state, 0) AS state_crashes, coalesce(o.lim, 0) AS limited_crashes, CASE WHEN x.street IN (SELECT street FROM covered_streets) THEN coalesce(k.n, 0) END AS signalized, z.safe_n, z.signal_n, {Q.dm('x.length_m')} AS length_dm, CAST(x.owner_code AS BIGINT) AS owner_code, {Q.dm('h.longest')} AS longest_dm, {Q.dm('h.med')} AS spacing_dm FROM street_index x "
       "LEFT JOIN (SELECT street, total, fatal, row_number() OVER (ORDER BY total DESC, fatal DESC, street) AS rank FROM ranking) r USING (street) LEFT JOIN (SELECT street, count(*) FILTER (WHERE owner = 'City') AS city, count(*) FILTER (WHERE owner = 'State route') AS state, count(*) FILTER (WHERE owner NOT IN ('City', 'State route')) AS lim FROM classified GROUP BY street) o USING (street) "
       "LEFT JOIN (SELECT street, count(*) FILTER (WHERE signalized) AS n FROM node_street JOIN marked_nodes USING (node_id) GROUP BY street) k USING (street) LEFT JOIN (SELECT street, count(*) AS safe_n, count(*) FILTER (WHERE signalized) AS signal_n FROM safe GROUP BY street) z USING (street) LEFT JOIN (SELECT street, max(gap) AS longest, median(gap) FILTER (WHERE is_inner) AS med FROM gaps WHERE street IN (SELECT street FROM safe) GROUP BY street) h USING (street)")
def _(s: Scene):
    summary = K.safe_summary(s.safe, s.lines)
    out = K.corridor_facts(s.ranked, s.classified, s.street_index, A.exploded_signal_share(s.marked_nodes), s.covered, summary)
    return out.select("street", "rank", "total", "fatal", "city_crashes", "state_crashes", "limited_crashes", "signalized", "safe_n", "signal_n", dm("length_m").alias("length_dm"), F.col("owner_code").cast("bigint").alias("owner_code"), dm("longest_gap").alias("longest_dm"), dm("median_spacing").alias("spacing_dm"))


@query("lc03_junction_facts", f"SELECT node_id, d.display, {Q.dm('x')} AS x_dm, {Q.dm('y')} AS y_dm, crashes, deaths, CASE WHEN signalized THEN 'y' WHEN on_covered THEN 'n' ELSE 'u' END AS status, CAST(round_even(f.m / 0.3048e0, 0) AS BIGINT) AS safe_ft FROM full_nodes "
       "JOIN (SELECT node_id, string_agg(i.display, ' & ' ORDER BY i.street) AS display FROM node_street JOIN street_index i USING (street) GROUP BY node_id) d USING (node_id) "
       f"LEFT JOIN (SELECT node_id, min(abs(m - sm)) AS m FROM (SELECT p.node_id, p.street, c.m_start + {Q.foot('p', 'c')} * c.len AS m FROM node_street p JOIN chains c ON c.street = p.street QUALIFY row_number() OVER (PARTITION BY p.node_id, p.street ORDER BY {Q.d2('p', 'c')}, c.seg_id) = 1) q JOIN (SELECT street, m AS sm FROM safe) s USING (street) GROUP BY node_id) f USING (node_id)")
def _(s: Scene):
    out = K.junction_facts(s.full_nodes, K.nodes_to_safe(s.nodes, s.safe, s.ref))
    return out.select("node_id", "display", dm("x").alias("x_dm"), dm("y").alias("y_dm"), "crashes", "deaths", "status", "safe_ft")


# --- 2.9 search --------------------------------------------------------------------------------------


@query("se01_split_queries", "SELECT query_id, CAST(part_no AS BIGINT) AS part_no, raw, CAST(parts AS BIGINT) AS parts FROM query_parts")
def _(s: Scene):
    return S.split_queries(s.searches).select("query_id", F.col("part_no").cast("bigint").alias("part_no"), "raw", F.col("parts").cast("bigint").alias("parts"))


def _matches(s: Scene):
    parts = S.split_queries(s.searches)
    return parts, S.match_parts(parts, s.searched_words, s.aliases)


@query("se02_match_parts", "SELECT raw, base, CAST(quality AS BIGINT) AS quality FROM matches")
def _(s: Scene):
    return _matches(s)[1].withColumn("quality", F.col("quality").cast("bigint"))


@query("se03_street_candidates", "SELECT query_id, street, q, place FROM street_hits WHERE place <= 8")
def _(s: Scene):
    parts, matches = _matches(s)
    return S.street_candidates(parts, matches, s.street_index).select("query_id", "street", "q", F.col("place").cast("bigint").alias("place"))


@query("se04_junction_candidates", "SELECT query_id, node_id, q, place FROM node_hits WHERE place <= 8")
def _(s: Scene):
    parts, matches = _matches(s)
    out = S.junction_candidates(parts.where("parts >= 2"), matches, s.node_streets, s.node_crashes)
    return out.select("query_id", "node_id", "q", F.col("place").cast("bigint").alias("place"))


@query("se05_direction_boost", "SELECT query_id, street, q, place, coalesce(d IS NULL AND ((place = 1 AND q = lead(q) OVER w AND base = lead(base) OVER w) OR (place = 2 AND q = lag(q) OVER w AND base = lag(base) OVER w)), false) AS ambiguous FROM ("
       "SELECT query_id, street, base, q, d, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, crashes DESC, l DESC, street) AS place FROM (SELECT p.query_id, s.street, s.base, s.crashes, round(s.length_m, 3) AS l, CASE WHEN lower(p.raw) LIKE 'w %' THEN 'W' END AS d, m.quality + CASE WHEN lower(p.raw) LIKE 'w %' AND s.street LIKE 'W %' THEN 0.5e0 ELSE 0e0 END AS q FROM query_parts p JOIN matches m USING (raw) JOIN street_index s USING (base) WHERE parts = 1) a) b WHERE place <= 8 WINDOW w AS (PARTITION BY query_id ORDER BY place)")
def _(s: Scene):
    parts, matches = _matches(s)
    out = S.street_candidates(parts, matches, s.street_index, directions=True)
    return out.select("query_id", "street", "q", F.col("place").cast("bigint").alias("place"), "ambiguous")


@query("se06_locate", "SELECT query_id, 'street' AS kind, street, CAST(NULL AS BIGINT) AS node_id, q, place FROM street_hits WHERE place <= 8 UNION ALL SELECT query_id, 'intersection', NULL, node_id, q, place FROM node_hits WHERE place <= 8")
def _(s: Scene):
    out = S.locate(s.searches, s.street_index, s.node_streets, s.node_crashes, s.aliases)
    return out.withColumn("place", F.col("place").cast("bigint"))


_WANT = "concat('W HICKORY', CAST(query_id % n AS VARCHAR(20)), ' AVE')"


@query("se07_hit_rate", f"SELECT count(*) AS queries, count(h.street) AS hits, {Q.pct('count(h.street)', 'count(*)')} AS hit_pct FROM (SELECT query_id, {_WANT} AS street FROM searches CROSS JOIN grid WHERE query_id % 6 < 3) e LEFT JOIN (SELECT query_id, street FROM street_hits WHERE place <= 8) h USING (query_id, street)")
def _(s: Scene):
    expected = s.searches.withColumn("n", F.lit(s.n)).where("query_id % 6 < 3").select("query_id", F.expr(_WANT).alias("street"))
    return S.hit_rate(expected, S.locate(s.searches, s.street_index, s.node_streets, s.node_crashes, s.aliases))


# --- 2.10 refresh ----------------------------------------------------------------------------------------

_OLD, _NEW = "(SELECT * FROM person_rows WHERE incident_id % 97 <> 0)", "(SELECT * FROM person_rows WHERE incident_id % 89 <> 0)"


@query("ing01_change_probe", f"SELECT *, new_ids > 0 OR gone_ids > 0 OR old_rows <> new_rows AS changed FROM (SELECT count(*) FILTER (WHERE o IS NULL) AS new_ids, count(*) FILTER (WHERE w IS NULL) AS gone_ids, CAST(coalesce(sum(o), 0) AS BIGINT) AS old_rows, CAST(coalesce(sum(w), 0) AS BIGINT) AS new_rows FROM "
       f"(SELECT incident_id, count(*) AS o FROM {_OLD} a WHERE incident_date >= (SELECT max(incident_date) FROM {_OLD} m) - 30 GROUP BY 1) x FULL JOIN (SELECT incident_id, count(*) AS w FROM {_NEW} b WHERE incident_date >= (SELECT max(incident_date) FROM {_OLD} m) - 30 GROUP BY 1) y USING (incident_id)) q")
def _(s: Scene):
    return I.change_probe(s.person_rows.where("incident_id % 97 <> 0"), s.person_rows.where("incident_id % 89 <> 0"))


@query("ing02_snapshot_diff", "SELECT incident_id, CASE WHEN o.incident_date IS NULL THEN 'added' WHEN w.incident_date IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old_snap o FULL JOIN new_snap w USING (incident_id) WHERE o.incident_date IS NULL OR w.incident_date IS NULL OR o.victims <> w.victims")
def _(s: Scene):
    return I.snapshot_diff(I.signature(s.old_snapshot), I.signature(s.new_snapshot))


@query("ing03_merge_by_key", "SELECT incident_id, victims, severity FROM new_snap UNION ALL SELECT incident_id, victims, severity FROM old_snap WHERE incident_id NOT IN (SELECT incident_id FROM new_snap)")
def _(s: Scene):
    cols = ["incident_id", "victims", "severity"]
    return I.merge_by_key(s.old_snapshot.select(*cols), s.new_snapshot.select(*cols))


@query("ing04_quality_gates", "SELECT gate, passed, CAST(value AS BIGINT) AS value FROM (SELECT unnest(['enough_rows', 'parts_sum', 'streets_sum', 'not_shrunk', 'not_exploded', 'date_not_back']) AS gate, unnest([w >= 0.9e0 * o, true, true, w >= o - 5, w <= o + 75, wd >= od]) AS passed, unnest([w, w, w, w - o, w - o, wd - od]) AS value FROM ("
       "SELECT (SELECT count(*) FROM old_snap) AS o, (SELECT count(*) FROM new_snap) AS w, (SELECT max(incident_date) FROM old_snap) AS od, (SELECT max(incident_date) FROM new_snap) AS wd) q) z")
def _(s: Scene):
    return I.quality_gates(s.classified.where("incident_id % 97 <> 0"), s.classified.where("incident_id % 89 <> 0"), least_share=0.9, may_lose=5, may_gain=75)


_CAME = "(SELECT count(*) FROM person_rows WHERE incident_id % 89 <> 0)"


@query("ing04_source_and_index_gates", f"SELECT 'enough_declared' AS gate, {_CAME} >= 0.9e0 * (SELECT count(*) FROM person_rows WHERE incident_id % 97 <> 0) AS passed, {_CAME} AS value UNION ALL SELECT 'all_declared_came', true, 0 "
       "UNION ALL SELECT 'corridors_sum', (SELECT sum(total) FROM ranking) = (SELECT count(*) FROM named), (SELECT CAST(sum(total) AS BIGINT) FROM ranking) UNION ALL SELECT 'street_index_sum', d BETWEEN 0 AND 25, d FROM (SELECT CAST((SELECT count(*) FROM named) - (SELECT sum(crashes) FROM street_index) AS BIGINT) AS d) q")
def _(s: Scene):
    new = s.person_rows.where("incident_id % 89 <> 0")
    pull = I.source_gates(new.agg(F.count(F.lit(1)).alias("n")), s.person_rows.where("incident_id % 97 <> 0"), new)
    return pull.unionByName(I.index_gates(s.named, s.ranking, s.street_index))


@query("ing05_status_delta", "SELECT count(*) AS common, count(*) FILTER (WHERE n0 IS NULL AND n1 IS NOT NULL) AS gained_node, count(*) FILTER (WHERE n0 IS NOT NULL AND n1 IS NULL) AS lost_node, count(*) FILTER (WHERE s0 <> s1) AS status_changed FROM (SELECT CASE WHEN incident_id % 7 = 0 THEN NULL ELSE intersection_node_id END AS n0, intersection_node_id AS n1, CASE WHEN incident_id % 5 = 0 THEN 'no' ELSE intersection_signalized END AS s0, intersection_signalized AS s1 FROM signal_status) q")
def _(s: Scene):
    before = s.signal_status.withColumn("intersection_node_id", F.when(F.col("incident_id") % 7 != 0, F.col("intersection_node_id")))
    before = before.withColumn("intersection_signalized", F.when(F.col("incident_id") % 5 == 0, F.lit("no")).otherwise(F.col("intersection_signalized")))
    return I.status_delta(before, s.signal_status)


_LEVEL = "CASE event_type WHEN 'click' THEN 'Possible Injury' WHEN 'purchase' THEN 'Fatal' WHEN 'view' THEN 'No Injury' ELSE 'Suspected Minor Injury' END"


@query("ing06_stream_fold", f"SELECT user_id AS incident_id, {Q.LABEL.replace('CASE r', 'CASE min(r)')} AS severity, count(*) AS victims, min(event_id) AS first_event FROM (SELECT *, {Q.RANK.replace('CASE injury', f'CASE {_LEVEL}')} AS r FROM events) e GROUP BY user_id")
def _(s: Scene):
    rows = s.read("events").select(F.col("user_id").alias("incident_id"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_LEVEL).alias("injury"))
    base = f"{scratch_dir(s.spark)}/stream-{uuid.uuid4().hex}"
    # arrival order: five files, every eleventh row held back to the last one, and sent twice
    late = F.col("row_id") % 11 == 0
    source = f"{base}/in"
    for k in range(5):
        rows.where(~late & (F.col("row_id") % 5 == k)).write.mode("append").parquet(source)
    rows.where(late).unionByName(rows.where(late)).write.mode("append").parquet(source)
    stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    run = ingest.stream_incidents(
        stream, key="incident_id", row_id="row_id", time="ts", severity="injury", fields=["ts"], folder=f"{base}/deltas", checkpoint=f"{base}/state", watermark="60 days"
    )
    run.awaitTermination()
    now = ingest.current_incidents(s.spark, f"{base}/deltas", key="incident_id", fields=["row_id"])
    return now.select("incident_id", "severity", "victims", F.col("row_id").alias("first_event"))


_HELD = "person_seq % 11 = 0"
_STREAM_END = f"(SELECT max(incident_date) FROM person_rows WHERE NOT ({_HELD}))"
_TAKEN = (
    f"(SELECT incident_id, min(r) AS r, count(*) AS victims, arg_min(x, (person_seq, incident_date, light)) AS x, arg_min(y, (person_seq, incident_date, light)) AS y FROM (SELECT *, {Q.RANK} AS r FROM person_rows "
    f"WHERE NOT ({_HELD}) OR incident_date >= {_STREAM_END} - 30) p GROUP BY incident_id)"
)


@query("ing06_stream_upsert", f"SELECT incident_id, {Q.LABEL} AS severity, victims, m.seg_id, (SELECT 2 * count(*) FROM person_rows WHERE {_HELD} AND incident_date < {_STREAM_END} - 30) AS late_rows FROM {_TAKEN} t JOIN ({Q.nearest_piece(_TAKEN, 'incident_id', 'streets', 'seg_id')}) m USING (incident_id)")
def _(s: Scene):
    rows = s.person_rows.select("incident_id", "person_seq", "incident_date", "light", "injury", "x", "y")
    base = f"{scratch_dir(s.spark)}/stream-{uuid.uuid4().hex}"
    store = generations.Store(f"{base}/store", "incident_id", "person_seq", "incident_date", "injury", ("person_seq", "incident_date", "light"), ("x", "y"))

    def attribute(df):
        return df.join(nearest(df, s.streets, point_id="incident_id", key=["seg_id"]).select("incident_id", "seg_id"), "incident_id", "left")

    # every eleventh row comes twice, after all others: what is then behind the watermark is put aside
    for part in (rows.where(f"NOT ({_HELD})"), rows.where(_HELD).unionByName(rows.where(_HELD))):
        part.write.mode("append").parquet(f"{base}/in")
        generations.start(store, s.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/state", attribute).awaitTermination()
        generations.compact(s.spark, store)
    behind = generations.late(s.spark, store).agg(F.count(F.lit(1)).alias("late_rows"))
    return generations.current(s.spark, store, ["seg_id"]).crossJoin(F.broadcast(behind))  # one row


# --- 2.1 sources and sinks: derived tables are written in each layout, then scanned back -------------------


def _folder(s: Scene, name: str) -> str:
    return f"{scratch_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


def _write_pages(df, path: str, item: str = "features") -> None:
    """Pages of about 500 features, one JSON document per file, however many features there are."""
    page = F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(max(1, df.count() // 500)))
    pages = df.groupBy(page.alias("page")).agg(F.collect_list(F.struct(*df.columns)).alias(item)).select(item)
    # one folder for all files, moved there by the tasks: folders of one file and moves by the driver cost more than the pages
    moved = {"maxRecordsPerFile": "1", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
    pages.write.options(ignoreNullFields="true", **moved).json(path)


_PERSON = T.StructType([T.StructField("incident_id", T.LongType()), T.StructField("person_seq", T.LongType()), T.StructField("injury", T.StringType()), T.StructField("lat", T.DoubleType())])


@query("src01_feature_pages", "SELECT incident_id, person_seq, injury, lat FROM person_rows")
def _(s: Scene):
    path = _folder(s, "pages")
    _write_pages(s.person_rows.select(F.struct(*_PERSON.names).alias("attributes")), path)
    return readers.scan_feature_pages(s.spark, path, _PERSON)


_SEG = T.StructType([T.StructField("seg_id", T.LongType()), T.StructField("name", T.StringType())])


@query("src02_line_features", "SELECT seg_id, name, x1, y1, x2, y2 FROM streets WHERE seg_id % 10 <> 0")
def _(s: Scene):
    line = F.array(F.array(F.array("x1", "y1"), F.array("x2", "y2")))
    geometry = F.when(F.col("seg_id") % 10 != 0, F.struct(line.alias("paths")))
    path = _folder(s, "lines")
    _write_pages(s.streets.select(F.struct(*_SEG.names).alias("attributes"), geometry.alias("geometry")), path)
    return readers.scan_line_features(s.spark, path, _SEG).select("seg_id", "name", "x1", "y1", "x2", "y2")


@query("src02_geojson_lines", "SELECT seg_id, CAST(0 AS BIGINT) AS idx, x1, y1, x2, y2 FROM streets UNION ALL SELECT seg_id, 1, x2, y2, x2 + 1, y2 FROM streets")
def _(s: Scene):
    shape = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x1", "y1"), F.array("x2", "y2"), F.array(F.col("x2") + 1, F.col("y2"))).alias("coordinates"))
    path = _folder(s, "geojson")
    _write_pages(s.streets.select(F.struct(*_SEG.names).alias("properties"), shape.alias("geometry")), path)
    out = readers.scan_line_features(s.spark, path, _SEG, geojson=True)
    return out.select("seg_id", F.col("idx").cast("bigint").alias("idx"), "x1", "y1", "x2", "y2")


_BLOCKS = "SELECT DISTINCT least(x1, x2) - 5e0 AS a, least(y1, y2) - 5e0 AS b, greatest(x1, x2) + 5e0 AS c, greatest(y1, y2) + 5e0 AS d FROM streets"


@query("src03_polygon", f"SELECT unnest([a, c, c, a]) AS x1, unnest([b, b, d, d]) AS y1, unnest([c, c, a, a]) AS x2, unnest([b, d, d, b]) AS y2 FROM ({_BLOCKS}) f")
def _(s: Scene):
    path = _folder(s, "area")
    box = s.streets.select("seg_id", (F.least("x1", "x2") - 5).alias("a"), (F.least("y1", "y2") - 5).alias("b"), (F.greatest("x1", "x2") + 5).alias("c"), (F.greatest("y1", "y2") + 5).alias("d"))
    box = box.unionByName(box.where("seg_id % 3 = 0"))  # every third feature is on two pages
    ring = F.array(*[F.array(x, y) for x, y in (("a", "b"), ("c", "b"), ("c", "d"), ("a", "d"), ("a", "b"))])
    _write_pages(box.select(F.struct(F.array(ring).alias("rings")).alias("geometry")), path)
    return readers.scan_polygon(s.spark, path).select("x1", "y1", "x2", "y2")


_POINT = T.StructType([T.StructField("signal_id", T.LongType()), T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


@query("src04_points", "SELECT signal_id, x, y FROM signals WHERE signal_id % 4 <> 3")
def _(s: Scene):
    k = F.col("signal_id") % 4
    known = lambda c, ok: F.when(ok, F.col(c))
    attributes = F.struct("signal_id", known("x", k == 1).alias("lon"), known("y", k == 1).alias("lat"))
    path = _folder(s, "points")
    _write_pages(s.signals.select(attributes.alias("attributes"), F.when(k.isin(0, 2), F.struct("x", "y")).alias("geometry")), path)
    return readers.scan_points(s.spark, path, _POINT, lon="lon", lat="lat").select("signal_id", "x", "y")


def _tags():
    return F.create_map(F.lit("highway"), F.col("highway"), F.lit("crossing:markings"), F.coalesce("markings", F.lit("")))


@query("src05_tagged_points", "SELECT signal_id AS id, x, y, highway, coalesce(markings, '') AS markings, '' AS footway FROM tagged")
def _(s: Scene):
    node = F.col("signal_id") % 2 == 0
    kind = F.when(node, F.lit("node")).otherwise(F.lit("way"))
    centre = F.when(~node, F.struct(F.col("y").alias("lat"), F.col("x").alias("lon")))
    path = _folder(s, "tagged")
    element = s.tagged.select(kind.alias("type"), F.col("signal_id").alias("id"), F.when(node, F.col("y")).alias("lat"), F.when(node, F.col("x")).alias("lon"), centre.alias("center"), _tags().alias("tags"))
    _write_pages(element, path, "elements")
    return readers.scan_tagged(s.spark, path).select("id", "x", "y", "highway", "markings", "footway")


@query("src05_tagged_lines", "SELECT signal_id AS id, x - 6 AS x1, y AS y1, x + 6 AS x2, y AS y2 FROM tagged WHERE signal_id % 3 = 0")
def _(s: Scene):
    at = lambda d: F.struct(F.col("y").alias("lat"), (F.col("x") + d).alias("lon"))
    shape = F.when(F.col("signal_id") % 3 == 0, F.array(at(-6), at(6))).otherwise(F.array(at(0)))
    path = _folder(s, "ways")
    _write_pages(s.tagged.select(F.lit("way").alias("type"), F.col("signal_id").alias("id"), shape.alias("geometry"), _tags().alias("tags")), path, "elements")
    return readers.scan_tagged_lines(s.spark, path).select("id", "x1", "y1", "x2", "y2")


@query("src06_csv", "SELECT incident_id, person_seq, injury, lat FROM person_rows")
def _(s: Scene):
    path = _folder(s, "csv")
    s.person_rows.select(*_PERSON.names).write.csv(path, header=True)
    return readers.scan_csv(s.spark, path, _PERSON)


@query("src07_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(s: Scene):
    return readers.scan_table(s.spark, f"{s.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("snk01_table_write", "SELECT incident_id, severity, victims FROM incidents")
def _(s: Scene):
    path = _folder(s, "table")
    writers.write_table(s.incidents.select("incident_id", "severity", "victims"), path, by=["severity"])
    return s.spark.read.parquet(path).select("incident_id", "severity", "victims")


@query("snk02_search_tables", "SELECT 'street_index' AS table_name, count(*) AS rows FROM street_index UNION ALL SELECT 'junction_index', count(*) FROM nodes UNION ALL SELECT 'alias_index', count(*) FROM aliases")
def _(s: Scene):
    path = _folder(s, "search")
    writers.write_search_tables(s.street_index, S.junction_index(s.full_nodes), s.aliases, path)
    return A.inventory({n: s.spark.read.parquet(f"{path}/{n}") for n in ("street_index", "junction_index", "alias_index")})


@query("snk03_compact_feed", f"SELECT incident_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(CASE owner WHEN 'City' THEN 0 WHEN 'State route' THEN 1 ELSE 2 END AS BIGINT) AS owner_code, CAST({FATAL} AS BIGINT) AS fatal, CAST(incident_date AS VARCHAR) AS date, severity, coalesce(location, '') AS location FROM classified")
def _(s: Scene):
    feed = writers.compact_feed(s.classified)
    return feed.withColumns({"owner_code": F.col("owner_code").cast("bigint"), "fatal": F.col("fatal").cast("bigint")})


@query("jn19_name_match", "SELECT quality, CAST(count(*) AS BIGINT) AS pairs FROM (SELECT CAST(quality AS BIGINT) AS quality FROM query_parts JOIN matches USING (raw)) q GROUP BY quality")
def _(s: Scene):
    parts, matches = _matches(s)
    return parts.join(matches, "raw").groupBy(F.col("quality").cast("bigint").alias("quality")).agg(F.count(F.lit(1)).alias("pairs"))


@query("tk03_top8_per_query", "SELECT query_id, count(*) AS shown FROM street_hits WHERE place <= 8 GROUP BY query_id")
def _(s: Scene):
    parts, matches = _matches(s)
    return S.street_candidates(parts, matches, s.street_index).groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"))
