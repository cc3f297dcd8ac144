"""The same computations as brute-force SQL over the same tables, for result checks."""

from __future__ import annotations

from curbline.plans.fixtures import view_sql

_NAMES = {
    "Fatal": 0, "Suspected Serious Injury": 1, "Suspected Minor Injury": 2, "Possible Injury": 3, "No Injury": 4, "No Apparent Injury": 4,
}
RANK = "CASE injury " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _NAMES.items()) + " ELSE 5 END"
LABEL = (
    "CASE r WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Suspected Serious Injury' WHEN 2 THEN 'Suspected Minor Injury' "
    "WHEN 3 THEN 'Possible Injury' WHEN 4 THEN 'No Injury' ELSE 'Unknown' END"
)
THROUGH = "mtfcc IN ('S1200', 'S1400')"
LIMITED = "('Interstate', 'Interstate ramp', 'Limited access')"


def dm(v: str) -> str:
    return f"CAST(floor(({v}) * 10 + 0.500001) AS BIGINT)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) = 0 THEN 0e0 ELSE round_even(100e0 * ({part}) / ({whole}), 1) END"


def n(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


def foot(p: str = "p", s: str = "s") -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    return f"least(1e0, greatest(0e0, coalesce((({p}.x - {s}.x1) * {dx} + ({p}.y - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0e0), 0e0)))"


def d2(p: str = "p", s: str = "s") -> str:
    gx = f"({p}.x - ({s}.x1 + {foot(p, s)} * ({s}.x2 - {s}.x1)))"
    gy = f"({p}.y - ({s}.y1 + {foot(p, s)} * ({s}.y2 - {s}.y1)))"
    return f"({gx} * {gx} + {gy} * {gy})"


def gap2(a: str = "a", b: str = "b") -> str:
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def nearest_piece(points: str, pid: str, net: str, key: str, on: str = "true") -> str:
    """pid, key, t, dist of the nearest piece, smallest key first."""
    best = f"min({{'d': {d2()}, 'k': s.{key}, 't': {foot()}}})"
    return f"SELECT {pid}, b.k AS {key}, b.t AS t, sqrt(b.d) AS dist FROM (SELECT p.{pid}, {best} AS b FROM {points} p JOIN {net} s ON {on} GROUP BY p.{pid}) q"


def nearest_place(points: str, pid: str, places: str, key: str, on: str = "true") -> str:
    best = f"min({{'d': {gap2()}, 'k': b.{key}}})"
    return f"SELECT {pid}, m.k AS {key}, sqrt(m.d) AS dist FROM (SELECT a.{pid}, {best} AS m FROM {points} a JOIN {places} b ON {on} GROUP BY a.{pid}) q"


def capsule(streets: str, routes: str, r: float, on: str = "true") -> str:
    """seg_id, t0, t1 of every street piece and route piece within r of each other."""
    return f"""SELECT seg_id, greatest(0e0, least(b0, p0, q0)) AS t0, least(1e0, greatest(b1, p1, q1)) AS t1 FROM (
SELECT seg_id, CASE WHEN greatest(s0, w0) <= least(s1, w1) THEN greatest(s0, w0) END AS b0, CASE WHEN greatest(s0, w0) <= least(s1, w1) THEN least(s1, w1) END AS b1,
 CASE WHEN pr >= 0 THEN (-pb - sqrt(pr)) / dd END AS p0, CASE WHEN pr >= 0 THEN (-pb + sqrt(pr)) / dd END AS p1,
 CASE WHEN qr >= 0 THEN (-qb - sqrt(qr)) / dd END AS q0, CASE WHEN qr >= 0 THEN (-qb + sqrt(qr)) / dd END AS q1 FROM (
SELECT seg_id, dd, pb, qb, pb * pb - dd * (wx * wx + wy * wy - {r}e0 * {r}e0) AS pr, qb * qb - dd * (vx * vx + vy * vy - {r}e0 * {r}e0) AS qr,
 CASE WHEN ds = 0 THEN CASE WHEN bs BETWEEN 0 AND ee THEN -1e18 ELSE 1e18 END ELSE least(-bs / nullif(ds, 0), (ee - bs) / nullif(ds, 0)) END AS s0,
 CASE WHEN ds = 0 THEN CASE WHEN bs BETWEEN 0 AND ee THEN 1e18 ELSE -1e18 END ELSE greatest(-bs / nullif(ds, 0), (ee - bs) / nullif(ds, 0)) END AS s1,
 CASE WHEN dc = 0 THEN CASE WHEN bc BETWEEN -wd AND wd THEN -1e18 ELSE 1e18 END ELSE least((-wd - bc) / nullif(dc, 0), (wd - bc) / nullif(dc, 0)) END AS w0,
 CASE WHEN dc = 0 THEN CASE WHEN bc BETWEEN -wd AND wd THEN 1e18 ELSE -1e18 END ELSE greatest((-wd - bc) / nullif(dc, 0), (wd - bc) / nullif(dc, 0)) END AS w1 FROM (
SELECT seg_id, wx, wy, vx, vy, dx * dx + dy * dy AS dd, wx * dx + wy * dy AS pb, vx * dx + vy * dy AS qb, ex * ex + ey * ey AS ee,
 wx * ex + wy * ey AS bs, dx * ex + dy * ey AS ds, wx * ey - wy * ex AS bc, dx * ey - dy * ex AS dc, {r}e0 * sqrt(ex * ex + ey * ey) AS wd FROM (
SELECT s.seg_id, s.x1 - r.x1 AS wx, s.y1 - r.y1 AS wy, s.x1 - r.x2 AS vx, s.y1 - r.y2 AS vy, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy, r.x2 - r.x1 AS ex, r.y2 - r.y1 AS ey
FROM {streets} s JOIN {routes} r ON {on} AND least(s.x1, s.x2) - 20 <= greatest(r.x1, r.x2) AND least(r.x1, r.x2) - 20 <= greatest(s.x1, s.x2) AND least(s.y1, s.y2) - 20 <= greatest(r.y1, r.y2) AND least(r.y1, r.y2) - 20 <= greatest(s.y1, s.y2)) a) b) c) d
WHERE (b0 IS NOT NULL OR p0 IS NOT NULL OR q0 IS NOT NULL) AND greatest(0e0, least(b0, p0, q0)) <= least(1e0, greatest(b1, p1, q1))"""


def covered(intervals: str) -> str:
    return (
        f"SELECT seg_id, sum(greatest(0e0, t1 - greatest(t0, coalesce(seen, 0e0)))) AS share FROM (SELECT seg_id, t0, t1, "
        f"max(t1) OVER (PARTITION BY seg_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({intervals}) i) u GROUP BY seg_id"
    )


def crossing_points(a: str, b: str, on: str) -> str:
    """name_a, name_b, x, y of crossings and of touching collinear ends (1 mm grid)."""
    return f"""SELECT name_a, name_b, min(x) AS x, min(y) AS y, CAST(round(x * 1000) AS BIGINT) AS qx, CAST(round(y * 1000) AS BIGINT) AS qy,
 concat(name_a, '|', name_b, '|', CAST(round(x * 1000) AS BIGINT), '|', CAST(round(y * 1000) AS BIGINT)) AS crossing_key FROM (
SELECT name_a, name_b, ax + t * dx AS x, ay + t * dy AS y FROM (SELECT *, (wx * ey - wy * ex) / nullif(den, 0e0) AS t, (wx * dy - wy * dx) / nullif(den, 0e0) AS u FROM (
 SELECT name_a, name_b, ax, ay, dx, dy, ex, ey, wx, wy, dx * ey - dy * ex AS den FROM pairs_ab) q) z WHERE abs(den) > 1e-12 AND t BETWEEN -1e-9 AND 1.000000001e0 AND u BETWEEN -1e-9 AND 1.000000001e0
UNION ALL
SELECT name_a, name_b, ax + (lo + hi) / 2 * dx AS x, ay + (lo + hi) / 2 * dy AS y FROM (SELECT *, greatest(0e0, least(c0, c1)) AS lo, least(1e0, greatest(c0, c1)) AS hi FROM (
 SELECT *, (wx * dx + wy * dy) / (dx * dx + dy * dy) AS c0, ((wx + ex) * dx + (wy + ey) * dy) / (dx * dx + dy * dy) AS c1 FROM pairs_ab WHERE abs(dx * ey - dy * ex) <= 1e-12 AND abs(wx * dy - wy * dx) < 1e-6) q) z WHERE lo <= hi
) f GROUP BY name_a, name_b, round(x * 1000), round(y * 1000)""".replace(
        "pairs_ab",
        f"(SELECT s.street AS name_a, r.street AS name_b, s.x1 AS ax, s.y1 AS ay, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy, r.x2 - r.x1 AS ex, r.y2 - r.y1 AS ey, r.x1 - s.x1 AS wx, r.y1 - s.y1 AS wy "
        f"FROM {a} s JOIN {b} r ON {on} AND least(s.x1, s.x2) <= greatest(r.x1, r.x2) AND least(r.x1, r.x2) <= greatest(s.x1, s.x2) AND least(s.y1, s.y2) <= greatest(r.y1, r.y2) AND least(r.y1, r.y2) <= greatest(s.y1, s.y2))",
    )


def components(name: str, edges: str, vertices: str) -> dict[str, str]:
    """Two CTEs: all reachable pairs, then the smallest label per vertex (``v``, ``c``)."""
    return {
        f"{name}_reach": f"SELECT v AS a, v AS b FROM ({vertices}) x UNION SELECT r.a, e.b FROM {name}_reach r JOIN ({edges}) e ON r.b = e.a",
        name: f"SELECT a AS v, min(b) AS c FROM {name}_reach GROUP BY a",
    }


def _views() -> dict[str, str]:
    v = view_sql()
    v["incidents"] = (
        f"SELECT incident_id, {LABEL} AS severity, victims, location, light, incident_date, lat, lon, x, y FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY person_seq, incident_date, light) AS rn, "
        f"min({RANK}) OVER (PARTITION BY incident_id) AS r, count(*) OVER (PARTITION BY incident_id) AS victims FROM person_rows) q WHERE rn = 1"
    )
    v["through"] = f"SELECT * FROM streets WHERE {THROUGH}"
    v["incident_segment"] = nearest_piece("incidents", "incident_id", "streets", "seg_id")
    v["incident_route"] = nearest_piece("incidents", "incident_id", "routes", "route_id")
    v["named"] = (
        "SELECT i.*, s.seg_id, s.street, s.lanes, s.speed, s.mtfcc, s.name, m.dist AS seg_m FROM incidents i JOIN incident_segment m USING (incident_id) JOIN streets s ON s.seg_id = m.seg_id"
    )
    v["classed"] = "SELECT *, CASE mtfcc WHEN 'S1100' THEN 'Interstate' WHEN 'S1630' THEN 'Interstate ramp' WHEN 'S1200' THEN 'State route' ELSE 'City' END AS owner FROM named"
    v["street_owner"] = "SELECT street, owner, count(*) AS k FROM classed GROUP BY ALL"
    v["street_best"] = "SELECT street, owner, k, sum(k) OVER (PARTITION BY street) AS al FROM street_owner QUALIFY row_number() OVER (PARTITION BY street ORDER BY k DESC, owner) = 1"
    for c in ("speed", "lanes"):
        v[f"street_{c}"] = f"SELECT street, {c} FROM (SELECT street, {c}, count(*) AS k FROM classed WHERE {c} <> 0 GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY street ORDER BY k DESC, {c}) = 1"
    v["ranking"] = (
        f"SELECT t.street, total, fatal, serious, b.owner AS dominant_owner, b.k * 1e0 / b.al < 0.9e0 AS mixed_owner, p.speed, l.lanes FROM (SELECT street, count(*) AS total, {n("severity = 'Fatal'")} AS fatal, "
        f"{n("severity = 'Suspected Serious Injury'")} AS serious FROM classed GROUP BY street) t JOIN street_best b USING (street) LEFT JOIN street_speed p USING (street) LEFT JOIN street_lanes l USING (street)"
    )
    v["iv10"], v["iv8"] = capsule("streets", "routes", 10), capsule("streets", "routes", 8)
    v["iv_same"] = capsule("streets", "routes", 10, "s.name_key = r.name_key")
    v["ov10"], v["ov8"], v["ov_same"] = covered("SELECT * FROM iv10"), covered("SELECT * FROM iv8"), covered("SELECT * FROM iv_same")
    v["measured"] = (
        "SELECT s.*, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, coalesce(a.share, 0e0) AS ov10, coalesce(b.share, 0e0) AS ov8, coalesce(c.share, 0e0) AS ov_same, "
        "s.seg_id IN (SELECT seg_id FROM iv_same) AS name_hit FROM streets s LEFT JOIN ov10 a USING (seg_id) LEFT JOIN ov8 b USING (seg_id) LEFT JOIN ov_same c USING (seg_id)"
    )
    beside = "(ov10 >= 0.6e0 AND name_hit) OR ov8 >= 0.85e0"
    ladder = [
        ("mtfcc = 'S1100'", "Interstate", "interstate_mainline"), ("mtfcc = 'S1630'", "Interstate ramp", "interstate_ramp"), ("name LIKE '%VALLEY4%'", "Limited access", "limited_access_override"),
        (beside, "State route", "state_route_overlap"), ("seg_id IN (104, 330) OR name_key = 'E HICKORY5'", "State route", "force_state_route_manual"), ("ov_same >= 0.2e0", "State route", "force_state_route_completeness"),
    ]
    own = "CASE " + " ".join(f"WHEN {t} THEN '{o}'" for t, o, _ in ladder) + " ELSE 'City' END"
    rule = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, _, r in ladder) + " ELSE 'city_residual' END"
    v["rulebook"] = (
        f"SELECT *, {own} AS owner, {rule} AS rule, CASE WHEN mtfcc = 'S1100' THEN 'Interstate' WHEN mtfcc = 'S1630' THEN 'Interstate ramp' WHEN {beside} THEN 'State route' ELSE 'City' END AS first_owner, "
        "(ov10 >= 0.3e0 AND ov10 < 0.6e0) OR (ov10 >= 0.6e0 AND NOT name_hit AND ov8 < 0.85e0) AS is_doubtful FROM measured"
    )
    v["classified"] = (
        "SELECT i.*, b.seg_id, b.owner, b.rule, b.street, b.lanes, b.speed, b.mtfcc, m.dist AS seg_m, r.dist AS route_m, "
        f"b.owner IN {LIMITED} AS is_limited, b.rule IN ('limited_access_override', 'force_state_route_manual', 'force_state_route_completeness') AS is_override, "
        "coalesce(b.owner = 'City' AND i.location LIKE 'Intersection%' AND r.dist <= 10 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT name FROM routes) t WHERE length(t.name) > 3 AND contains(b.street, t.name)), false) AS is_corner "
        "FROM incidents i JOIN incident_segment m USING (incident_id) JOIN rulebook b ON b.seg_id = m.seg_id JOIN incident_route r USING (incident_id)"
    )
    # signals and crossings
    v.update(components("signal_cluster", f"SELECT a.signal_id AS a, b.signal_id AS b FROM signals a JOIN signals b ON {gap2()} <= 900e0", "SELECT signal_id AS v FROM signals"))
    v["signal_segment"] = nearest_piece("signals", "signal_id", "streets", "seg_id")
    v["signal_members"] = "SELECT g.*, c.c AS crossing_id, s.street FROM signals g JOIN signal_cluster c ON c.v = g.signal_id JOIN signal_segment m ON m.signal_id = g.signal_id JOIN streets s ON s.seg_id = m.seg_id"
    for out, col in (("dom_route", "route_number"), ("dom_street", "street")):
        v[f"x_{out}"] = f"SELECT crossing_id, {col} AS {out} FROM (SELECT crossing_id, {col}, count(*) AS k FROM signal_members GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY crossing_id ORDER BY k DESC, {col}) = 1"
    v["xings"] = (
        "SELECT crossing_id, count(*) AS n_signals, count(*) FILTER (WHERE kind = 'Pedestrian Signal') AS n_heads, count(*) FILTER (WHERE kind = 'Push Button') AS n_buttons, count(DISTINCT route_number) AS n_routes, "
        "avg(x) AS x, avg(y) AS y FROM signal_members GROUP BY crossing_id"
    )
    # junctions
    v["met"] = crossing_points("through", "through", "s.street < r.street")
    v.update(components(
        "node_of",
        f"SELECT a.crossing_key AS a, b.crossing_key AS b FROM met a JOIN met b ON {gap2()} <= 625e0 OR (a.name_a = b.name_a AND a.name_b = b.name_b AND {gap2()} <= 14400e0)", "SELECT crossing_key AS v FROM met",
    ))
    v["node_names"] = "SELECT DISTINCT c, nm FROM (SELECT c, name_a AS nm FROM met JOIN node_of ON v = crossing_key UNION ALL SELECT c, name_b FROM met JOIN node_of ON v = crossing_key) q"
    v["nodes"] = (
        "SELECT row_number() OVER (ORDER BY c) AS node_id, c, x, y, streets, n_streets FROM (SELECT c, avg(x) AS x, avg(y) AS y FROM met JOIN node_of ON v = crossing_key GROUP BY c) p "
        "JOIN (SELECT c, string_agg(nm, '; ' ORDER BY nm) AS streets, count(*) AS n_streets FROM node_names GROUP BY c) q USING (c)"
    )
    v["node_street"] = "SELECT node_id, nm AS street, row_number() OVER (PARTITION BY node_id ORDER BY nm) - 1 AS k, x, y FROM nodes JOIN node_names USING (c)"
    v["signal_through"] = nearest_piece("signals", "signal_id", "through", "seg_id")
    v["snapped"] = "SELECT g.signal_id, g.route_number, s.street FROM signals g JOIN signal_through m USING (signal_id) JOIN streets s ON s.seg_id = m.seg_id"
    v["route_street"] = "SELECT route_number, street, count(*) AS k, sum(count(*)) OVER (PARTITION BY route_number) AS al FROM snapped GROUP BY route_number, street"
    v["covered_streets"] = (
        "SELECT street, own_signals, by_route, own_signals >= 4 AS by_own FROM (SELECT street, sum(k) AS own_signals FROM route_street GROUP BY street) o "
        "JOIN (SELECT street, bool_or(al >= 4 AND (place = 1 OR k >= 0.25e0 * al)) AS by_route FROM (SELECT *, row_number() OVER (PARTITION BY route_number ORDER BY k DESC, street) AS place FROM route_street) q GROUP BY street) r USING (street) "
        "WHERE by_route OR own_signals >= 4"
    )
    v["node_xing"] = nearest_place("nodes", "node_id", "xings", "crossing_id")
    v["marked_nodes"] = (
        "SELECT n.*, x.dist AS nearest_crossing_m, x.dist <= 30 AS signalized, n.node_id IN (SELECT node_id FROM node_street WHERE street IN (SELECT street FROM covered_streets)) AS on_covered FROM nodes n JOIN node_xing x USING (node_id)"
    )
    v["incident_node"] = nearest_place("incidents", "incident_id", "marked_nodes", "node_id")
    v["incident_xing"] = nearest_place("incidents", "incident_id", "xings", "crossing_id")
    v["signal_status"] = (
        "SELECT i.*, coalesce(i.location LIKE 'Intersection%', false) AS at_intersection, CASE WHEN d.dist <= 30 THEN d.node_id END AS intersection_node_id, x.dist AS nearest_ped_signal_m, "
        "coalesce(i.location LIKE 'Intersection%', false) <> (d.dist <= 30) AS is_ambiguous, CASE WHEN NOT coalesce(i.location LIKE 'Intersection%', false) THEN '' WHEN d.dist <= 30 AND k.signalized THEN 'yes' "
        "WHEN d.dist <= 30 AND k.on_covered THEN 'no' ELSE 'no_signal_coverage' END AS intersection_signalized FROM incidents i JOIN incident_node d USING (incident_id) JOIN marked_nodes k ON k.node_id = d.node_id JOIN incident_xing x USING (incident_id)"
    )
    v["full_nodes"] = (
        "SELECT k.*, coalesce(crashes, 0) AS crashes, coalesce(deaths, 0) AS deaths FROM marked_nodes k LEFT JOIN (SELECT intersection_node_id AS node_id, count(*) AS crashes, count(*) FILTER (WHERE severity = 'Fatal') AS deaths "
        "FROM signal_status WHERE intersection_node_id IS NOT NULL GROUP BY 1) c USING (node_id)"
    )
    # chains: on the lattice each street is one run of pieces in id order
    v["pieces"] = "SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM streets"
    v["chains"] = (
        "SELECT *, min(seg_id) OVER (PARTITION BY street) AS chain_id, sum(len) OVER (PARTITION BY street) AS chain_len, coalesce(sum(len) OVER (PARTITION BY street ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS m_start FROM pieces"
    )
    v["lines"] = "SELECT DISTINCT street, chain_id, chain_len FROM (SELECT street, min(seg_id) AS chain_id, sum(len) AS chain_len FROM pieces GROUP BY street) q"
    v["on_chain"] = f"SELECT p.*, s.chain_id, s.m_start + {foot()} * s.len AS m FROM named p JOIN chains s ON s.seg_id = p.seg_id"
    # crosswalk study
    v["marked"] = "SELECT * FROM tagged WHERE lower(coalesce(markings, '')) NOT IN ('', 'no', 'nan', 'none')"
    v["walk_lines"] = (
        "SELECT signal_id, x, y, x - CASE WHEN signal_id % 2 = 0 THEN 6e0 ELSE 0e0 END AS x1, y - CASE WHEN signal_id % 2 = 1 THEN 6e0 ELSE 0e0 END AS y1, "
        "x + CASE WHEN signal_id % 2 = 0 THEN 6e0 ELSE 0e0 END AS x2, y + CASE WHEN signal_id % 2 = 1 THEN 6e0 ELSE 0e0 END AS y2 FROM marked WHERE signal_id % 3 = 0"
    )
    v["walk_points"] = "SELECT signal_id, x, y FROM marked WHERE signal_id % 3 <> 0"

    # each line of the first table also twice more, beside it and longer, and each point once more, far or near
    v["drawn"] = (
        "SELECT signal_id * 4 + k AS place_id, true AS is_line, (x1 + x2) / 2 + k * 3e0 AS x, (y1 + y2) / 2 AS y, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * (1e0 + (k * 7 + signal_id) % 5) AS len FROM walk_lines CROSS JOIN (VALUES (0), (1), (2)) t(k) "
        "UNION ALL SELECT signal_id * 4 + k, false, x + k * (signal_id % 13), y, 0e0 FROM walk_points CROSS JOIN (VALUES (0), (1)) t(k)"
    )
    v.update(components("drawn_place", f"SELECT a.place_id AS a, b.place_id AS b FROM drawn a JOIN drawn b ON {gap2()} <= 64e0", "SELECT place_id AS v FROM drawn"))

    def near_lines(points: str, pid: str, r: float) -> str:
        return (
            f"SELECT p.{pid}, s.street, s.seg_id, s.m_start + {foot()} * s.len AS m, sqrt({d2()}) AS dist FROM {points} p JOIN chains s ON {d2()} <= {r * r}e0 "
            f"QUALIFY row_number() OVER (PARTITION BY p.{pid}, s.street ORDER BY sqrt({d2()}), s.seg_id) = 1"
        )

    v["line_near"] = near_lines("walk_lines", "signal_id", 30)
    v["line_spots"] = (
        "SELECT l.signal_id, l.street, k.s, least(greatest(l.m + k.s * 8e0, 0e0), n.chain_len) AS m FROM line_near l JOIN lines n USING (street) CROSS JOIN (VALUES (-1), (1)) k(s)"
    )
    v["line_xy"] = (
        "SELECT signal_id, street, s, x1 + (x2 - x1) * t AS x, y1 + (y2 - y1) * t AS y FROM (SELECT p.signal_id, p.street, p.s, c.x1, c.x2, c.y1, c.y2, least(1e0, greatest(0e0, (p.m - c.m_start) / c.len)) AS t, "
        "row_number() OVER (PARTITION BY p.signal_id, p.street, p.s ORDER BY greatest(c.m_start - p.m, p.m - c.m_start - c.len, 0e0), c.m_start) AS rn FROM line_spots p JOIN chains c USING (street)) q WHERE rn = 1"
    )
    v["line_turn"] = (
        "SELECT b.signal_id, b.street, abs((degrees(atan2(w.y2 - w.y1, w.x2 - w.x1)) + 360) % 180 - (degrees(atan2(b.y - a.y, b.x - a.x)) + 360) % 180) AS turn FROM line_xy a JOIN line_xy b ON a.signal_id = b.signal_id AND a.street = b.street AND a.s = -1 AND b.s = 1 JOIN walk_lines w ON w.signal_id = b.signal_id"
    )
    v["line_touch"] = f"SELECT DISTINCT seg_id AS signal_id, street FROM (SELECT i.*, split_part(key, '|', 2) AS street FROM (SELECT seg_id AS key, t0, t1, CAST(split_part(seg_id, '|', 1) AS BIGINT) AS seg_id FROM ({capsule('line_keys', 'streets', 12, 's.street = r.street')}) c) i) j"
    v["line_keys"] = "SELECT concat(signal_id, '|', street) AS seg_id, street, w.x1, w.y1, w.x2, w.y2 FROM line_near JOIN walk_lines w USING (signal_id)"
    order = list(v)
    order.remove("line_keys")
    order.insert(order.index("line_touch"), "line_keys")
    v = {k: v[k] for k in order}
    v["kept_lines"] = "SELECT l.signal_id, l.street, l.m FROM line_near l JOIN line_turn t USING (signal_id, street) JOIN line_touch c USING (signal_id, street) WHERE least(turn, 180 - turn) > 45"
    v["point_near"] = near_lines("walk_points", "signal_id", 8)
    v["kept_points"] = (
        f"SELECT n.signal_id, n.street, n.m FROM point_near n JOIN walk_points p USING (signal_id) WHERE NOT EXISTS (SELECT 1 FROM through s WHERE s.street <> n.street AND sqrt({d2()}) < n.dist)"
    )
    v["kept_marked"] = "SELECT concat('m', signal_id) AS place_id, street, t.x, t.y FROM (SELECT signal_id, street FROM kept_lines UNION ALL SELECT signal_id, street FROM kept_points) k JOIN tagged t USING (signal_id)"
    v["corner_met"] = crossing_points("streets", "through", "s.street <> r.street")
    v["corners"] = "SELECT DISTINCT name_a AS street, x, y FROM corner_met"
    v["xing_near"] = near_lines("xings", "crossing_id", 30)
    v["kept_signals"] = (
        f"SELECT concat('s', crossing_id) AS place_id, a.street, a.x, a.y FROM (SELECT n.street, n.crossing_id, x.x, x.y FROM xing_near n JOIN xings x USING (crossing_id)) a WHERE EXISTS (SELECT 1 FROM corners b WHERE b.street = a.street AND {gap2()} <= 900e0)"
    )
    v["all_marks"] = "SELECT concat(street, '|', place_id) AS pid, *, false AS is_signal FROM kept_marked UNION ALL SELECT concat(street, '|', place_id), *, true FROM kept_signals"
    v.update(components("safe_of", f"SELECT a.pid AS a, b.pid AS b FROM all_marks a JOIN all_marks b ON a.street = b.street AND {gap2()} <= 900e0", "SELECT pid AS v FROM all_marks"))
    v["safe_raw"] = "SELECT c AS safe_id, street, avg(x) AS x, avg(y) AS y, bool_or(is_signal) AS signalized FROM all_marks JOIN safe_of ON v = pid GROUP BY c, street"
    v["safe"] = (
        f"SELECT p.*, s.m_start + {foot()} * s.len AS m FROM safe_raw p JOIN chains s ON s.street = p.street QUALIFY row_number() OVER (PARTITION BY p.safe_id ORDER BY {d2()}, s.seg_id) = 1"
    )
    v["related"] = "SELECT * FROM incidents WHERE location LIKE '%On Roadway%' OR location LIKE '%In Crosswalk%'"
    v["related_near"] = near_lines("related", "incident_id", 30)
    v["related_dist"] = (
        "SELECT r.incident_id, r.street, r.m, i.severity = 'Fatal' AS is_fatal, min(abs(r.m - s.m)) AS along_m FROM related_near r JOIN incidents i USING (incident_id) LEFT JOIN safe s ON s.street = r.street GROUP BY ALL"
    )
    v["marks_on"] = "SELECT street, m AS pos, 1 AS kind FROM safe UNION ALL SELECT street, 0e0, 0 FROM lines UNION ALL SELECT street, chain_len, 2 FROM lines"
    v["gaps"] = (
        "SELECT street, lag(pos) OVER w AS from_m, pos AS to_m, pos - lag(pos) OVER w AS gap, lag(kind) OVER w = 1 AND kind = 1 AS is_inner FROM marks_on WINDOW w AS (PARTITION BY street ORDER BY pos, kind) QUALIFY lag(pos) OVER w IS NOT NULL"
    )
    # branching network per direction half: nodes are piece ends merged within 1 m
    v["net_ends"] = "SELECT seg_id * 2 AS e, predir, x1 AS x, y1 AS y FROM pieces UNION ALL SELECT seg_id * 2 + 1, predir, x2, y2 FROM pieces"
    v.update(components("net_node", f"SELECT a.e AS a, b.e AS b FROM net_ends a JOIN net_ends b ON a.predir = b.predir AND {gap2()} <= 1e0", "SELECT e AS v FROM net_ends"))
    v["net_edges"] = "SELECT p.seg_id, p.len, a.c AS na, b.c AS nb FROM pieces p JOIN net_node a ON a.v = p.seg_id * 2 JOIN net_node b ON b.v = p.seg_id * 2 + 1"
    v["net_start"] = "SELECT m.signal_id, e.seg_id, e.na, e.nb, m.t * e.len AS d0, (1 - m.t) * e.len AS d1 FROM signal_segment m JOIN net_edges e USING (seg_id)"
    v["net_walk"] = (
        "SELECT signal_id, na AS node, d0 AS d FROM net_start WHERE d0 <= 300 UNION SELECT signal_id, nb, d1 FROM net_start WHERE d1 <= 300 "
        "UNION SELECT w.signal_id, CASE WHEN e.na = w.node THEN e.nb ELSE e.na END, w.d + e.len FROM net_walk w JOIN net_edges e ON (e.na = w.node OR e.nb = w.node) WHERE w.d + e.len <= 300"
    )
    v["net_dist"] = "SELECT signal_id, node, min(d) AS d FROM net_walk GROUP BY ALL"
    v["net_inc"] = "SELECT i.incident_id, i.severity, m.seg_id, m.t * e.len AS o0, (1 - m.t) * e.len AS o1, e.na, e.nb FROM incidents i JOIN incident_segment m USING (incident_id) JOIN net_edges e ON e.seg_id = m.seg_id"
    v["net_hit"] = (
        "SELECT DISTINCT signal_id, incident_id, severity FROM (SELECT d.signal_id, i.incident_id, i.severity FROM net_dist d JOIN net_inc i ON i.na = d.node WHERE d.d + i.o0 <= 300 "
        "UNION ALL SELECT d.signal_id, i.incident_id, i.severity FROM net_dist d JOIN net_inc i ON i.nb = d.node WHERE d.d + i.o1 <= 300 "
        "UNION ALL SELECT s.signal_id, i.incident_id, i.severity FROM net_start s JOIN net_inc i ON i.seg_id = s.seg_id WHERE abs(s.d0 - i.o0) <= 300) q"
    )
    # pieces that share an end point exactly, and pieces whose ends lie within 1 m
    v["net_piece_link"] = "SELECT DISTINCT a.e // 2 AS a, b.e // 2 AS b FROM net_ends a JOIN net_ends b ON a.predir = b.predir AND a.x = b.x AND a.y = b.y"
    v["net_piece_reach"] = "SELECT seg_id AS a, seg_id AS b FROM pieces UNION SELECT r.a, l.b FROM net_piece_reach r JOIN net_piece_link l ON l.a = r.b"
    v["net_touch_link"] = f"SELECT DISTINCT a.e // 2 AS a, b.e // 2 AS b FROM net_ends a JOIN net_ends b ON a.predir = b.predir AND {gap2()} <= 1e0"
    v["net_touch_reach"] = "SELECT seg_id AS a, seg_id AS b FROM pieces UNION SELECT r.a, l.b FROM net_touch_reach r JOIN net_touch_link l ON l.a = r.b"
    v["net_piece_cluster"] = "SELECT p.seg_id, p.predir, min(r.b) AS c FROM pieces p JOIN net_touch_reach r ON r.a = p.seg_id GROUP BY ALL"
    v["net_chain_end"] = "SELECT e.predir, e.x, e.y, c.c FROM net_ends e JOIN net_piece_cluster c ON c.seg_id = e.e // 2 QUALIFY count(*) OVER (PARTITION BY e.predir, e.x, e.y) <> 2"
    # chains of that network: pieces joined where exactly two ends meet; a chain is called after the smaller of its end pieces
    v["net_joint"] = "SELECT predir, x, y FROM net_ends GROUP BY predir, x, y HAVING count(*) = 2"
    at = "{0}.predir = j.predir AND {0}.x = j.x AND {0}.y = j.y"
    v.update(components("net_chain_of", f"SELECT a.e // 2 AS a, b.e // 2 AS b FROM net_joint j JOIN net_ends a ON {at.format('a')} JOIN net_ends b ON {at.format('b')}", "SELECT seg_id AS v FROM pieces"))
    v["net_open"] = f"SELECT DISTINCT e // 2 AS seg_id FROM net_ends e WHERE NOT EXISTS (SELECT 1 FROM net_joint j WHERE {at.format('e')})"
    v["net_chain"] = (
        "SELECT k.c, p.predir, any_value(q.c) AS cluster, sum(p.len) AS len, coalesce(min(o.seg_id), min(p.seg_id)) AS chain_id, CAST(coalesce(sum(i.n), 0) AS BIGINT) AS n FROM pieces p JOIN net_chain_of k ON k.v = p.seg_id "
        "JOIN net_piece_cluster q ON q.seg_id = p.seg_id LEFT JOIN net_open o ON o.seg_id = p.seg_id LEFT JOIN (SELECT seg_id, count(*) AS n FROM net_inc GROUP BY seg_id) i ON i.seg_id = p.seg_id GROUP BY k.c, p.predir"
    )
    # search
    v["base_words"] = "SELECT street, regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g') AS base FROM streets"
    v["street_index"] = (
        "SELECT b.street, lower(b.name) AS base, b.x_min, b.y_min, b.x_max, b.y_max, b.length_m, o.code AS owner_code, coalesce(c.crashes, 0) AS crashes, concat(b.predir, ' ', upper(substr(b.name, 1, 1)), lower(substr(b.name, 2)), ' ', CASE b.type WHEN 'AVE' THEN 'Avenue' ELSE 'Street' END) AS display FROM "
        "(SELECT street, any_value(name) AS name, any_value(predir) AS predir, any_value(type) AS type, min(least(x1, x2)) AS x_min, min(least(y1, y2)) AS y_min, max(greatest(x1, x2)) AS x_max, max(greatest(y1, y2)) AS y_max, sum(len) AS length_m FROM rulebook GROUP BY street) b "
        "JOIN (SELECT street, code FROM (SELECT street, code, sum(len) AS l FROM (SELECT street, len, CASE owner WHEN 'City' THEN 0 WHEN 'State route' THEN 1 ELSE 2 END AS code FROM rulebook) r GROUP BY ALL) q QUALIFY row_number() OVER (PARTITION BY street ORDER BY round(l, 6) DESC, code) = 1) o USING (street) "
        "LEFT JOIN (SELECT street, count(*) AS crashes FROM named GROUP BY street) c USING (street)"
    )
    forms = "(VALUES ('sr '), ('state route '), ('route '), ('tn '), ('highway '), ('hwy ')) f(p)"
    v["aliases"] = f"SELECT DISTINCT concat(p, altname) AS alias_key, concat(predir, ' ', CASE WHEN name LIKE 'SR%' THEN concat('Sr', substr(name, 3)) ELSE concat(upper(substr(name, 1, 1)), lower(substr(name, 2))) END, ' ', CASE type WHEN 'AVE' THEN 'Avenue' ELSE 'Street' END) AS member, lower(name) AS base FROM routes CROSS JOIN {forms}"
    v["query_parts"] = (
        "SELECT query_id, raw, row_number() OVER (PARTITION BY query_id ORDER BY ord) - 1 AS part_no, count(*) OVER (PARTITION BY query_id) AS parts, "
        "trim(regexp_replace(regexp_replace(lower(raw), '^(w|e) ', ''), ' (ave|st)$', '')) AS part FROM (SELECT query_id, trim(unnest(string_split_regex(q, '\\s*(?:\\band\\b|&|@)\\s*'))) AS raw, unnest(generate_series(1, len(string_split_regex(q, '\\s*(?:\\band\\b|&|@)\\s*')))) AS ord FROM searches) s"
    )
    v["vocab"] = "SELECT DISTINCT lower(name) AS base FROM streets"
    v["raw_parts"] = "SELECT DISTINCT raw, part, lower(raw) AS key FROM query_parts"
    v["fuzzy"] = "SELECT raw, base, levenshtein(part, base) AS d FROM raw_parts CROSS JOIN vocab WHERE length(part) >= 4 AND levenshtein(part, base) <= CASE WHEN length(part) < 6 THEN 1 ELSE 2 END"
    v["matches"] = (
        "SELECT raw, base, max(quality) AS quality FROM (SELECT raw, a.base, 4 AS quality FROM raw_parts r JOIN aliases a ON a.alias_key = r.key "
        "UNION ALL SELECT raw, a.base, 4 FROM raw_parts r JOIN aliases a ON a.alias_key = r.part WHERE r.key NOT IN (SELECT alias_key FROM aliases) UNION ALL SELECT raw, base, 4 FROM raw_parts JOIN vocab ON part = base "
        "UNION ALL SELECT raw, base, 3 FROM raw_parts JOIN vocab ON starts_with(base, part) AND base <> part UNION ALL SELECT raw, base, 1 FROM raw_parts JOIN vocab ON length(part) >= 5 AND contains(base, part) AND NOT starts_with(base, part) "
        "UNION ALL SELECT raw, base, 2 FROM fuzzy f JOIN (SELECT raw, min(d) AS d FROM fuzzy GROUP BY raw) b USING (raw, d)) u GROUP BY raw, base"
    )
    v["street_hits"] = (
        "SELECT query_id, street, base, quality * 1e0 AS q, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, crashes DESC, round(length_m, 3) DESC, street) AS place FROM query_parts p JOIN matches m USING (raw) JOIN street_index s USING (base) WHERE parts = 1"
    )
    v["node_base"] = "SELECT node_id, k, lower(split_part(street, ' ', 2)) AS base FROM node_street"
    v["node_q"] = "SELECT p.query_id, p.parts, p.part_no, b.node_id, b.k, m.quality FROM query_parts p JOIN matches m USING (raw) JOIN node_base b USING (base)"
    v["node_first"] = "SELECT query_id, parts, node_id, k, quality FROM node_q WHERE part_no = 0 QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY quality DESC, k) = 1"
    v["node_second"] = (
        "SELECT a.query_id, a.node_id, a.quality + b.quality AS q FROM node_first a JOIN node_q b ON a.query_id = b.query_id AND a.node_id = b.node_id AND b.part_no = 1 AND b.k <> a.k WHERE a.parts = 2 "
        "QUALIFY row_number() OVER (PARTITION BY a.query_id, a.node_id ORDER BY b.quality DESC, b.k) = 1"
    )
    v["node_hits"] = "SELECT query_id, node_id, q * 1e0 AS q, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, crashes DESC, node_id) AS place FROM node_second JOIN full_nodes USING (node_id)"
    # snapshots
    v["old_snap"] = "SELECT * FROM incidents WHERE incident_id % 97 <> 0"
    v["new_snap"] = "SELECT * REPLACE (victims + CASE WHEN incident_id % 83 = 0 THEN 1 ELSE 0 END AS victims) FROM incidents WHERE incident_id % 89 <> 0"
    return v


VIEWS = _views()
_RECURSIVE = {k for k in VIEWS if k.endswith("_reach") or k == "net_walk"}


def _words(sql: str) -> set[str]:
    import re

    return set(re.findall(r"[a-z_0-9]+", sql))


def sql(body: str) -> str:
    """``body`` with every view it needs in front of it."""
    need, todo = set(), [body]
    while todo:
        for w in _words(todo.pop()):
            if w in VIEWS and w not in need:
                need.add(w)
                todo.append(VIEWS[w])
    ordered = [k for k in VIEWS if k in need]
    head = ",\n".join(f"{k} AS {'' if k in _RECURSIVE else 'MATERIALIZED '}({VIEWS[k]})" for k in ordered)
    return f"WITH RECURSIVE {head}\n{body}" if head else body
