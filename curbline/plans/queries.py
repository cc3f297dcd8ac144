"""Every registered query with its check SQL: tables, columns, joins and aggregates (part 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.functions.geometry import decimetres as dm
from curbline.functions.projection import to_degrees, to_plane
from curbline.operators import aggregates as A
from curbline.operators import corridors as K
from curbline.operators import crossings as X
from curbline.operators import overlap as O
from curbline.operators import rules as R
from curbline.operators import scan
from curbline.operators import spatial as P
from curbline.operators.clip import density_inside
from curbline.operators.graph import cluster_points
from curbline.plans import checks as Q
from curbline.plans.scene import CITY_BOX, MERGE_RADIUS, Scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


_SCENES: dict[tuple[str, str], Scene] = {}


def scene(spark: SparkSession, folder: str) -> Scene:
    """One scene per session and folder: the tables it wrote are read again, not recomputed."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SCENES:
        _SCENES[key] = Scene(spark, folder)
    return _SCENES[key]


def forget_scenes() -> None:
    """Drop all shared tables, so that the next query computes everything itself."""
    _SCENES.clear()


def query(name: str, check: str | None = None):
    def keep(build: Callable[[Scene], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(scene(spark, folder))
        if check is not None:
            CHECKS[name] = Q.sql(check)
        return build

    return keep


ROUND6 = "round({0}, 6)"

# --- 2.2 projections, predicates -----------------------------------------------------------------


@query("prj01_project", "SELECT person_seq, incident_id, CAST(floor((600000e0 + rho * sin(th)) * 10 + 0.500001) AS BIGINT) AS x_dm, CAST(floor((rho0 - rho * cos(th)) * 10 + 0.500001) AS BIGINT) AS y_dm FROM ("
       "SELECT person_seq, incident_id, big_f * pow(tan(pi() / 4 - ph / 2) / pow((1 - ec * sin(ph)) / (1 + ec * sin(ph)), ec / 2), nn) AS rho, nn * (la - radians(-86e0)) AS th, rho0 FROM ("
       "SELECT *, 6378137e0 * m1 / (nn * pow(t1, nn)) AS big_f, 6378137e0 * m1 / (nn * pow(t1, nn)) * pow(t0, nn) AS rho0 FROM (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS nn FROM ("
       "SELECT *, cos(p1) / sqrt(1 - ec * ec * sin(p1) * sin(p1)) AS m1, cos(p2) / sqrt(1 - ec * ec * sin(p2) * sin(p2)) AS m2, tan(pi() / 4 - p1 / 2) / pow((1 - ec * sin(p1)) / (1 + ec * sin(p1)), ec / 2) AS t1, "
       "tan(pi() / 4 - p2 / 2) / pow((1 - ec * sin(p2)) / (1 + ec * sin(p2)), ec / 2) AS t2, tan(pi() / 4 - p0 / 2) / pow((1 - ec * sin(p0)) / (1 + ec * sin(p0)), ec / 2) AS t0 FROM ("
       "SELECT person_seq, incident_id, radians(lat) AS ph, radians(lon) AS la, sqrt(2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0)) AS ec, radians(36.4166666667e0) AS p1, radians(35.25e0) AS p2, radians(34.3333333333e0) AS p0 "
       "FROM person_rows) a) b) c) d) e")
def _(s: Scene):
    x, y = to_plane()
    return s.person_rows.select("person_seq", "incident_id", dm(x).alias("x_dm"), dm(y).alias("y_dm"))


@query("prj01_inverse", "SELECT incident_id, person_seq, round(lat, 6) + 0e0 AS lat, round(lon, 6) + 0e0 AS lon FROM person_rows")
def _(s: Scene):
    x, y = to_plane()
    lat, lon = to_degrees("px", "py")
    there = s.person_rows.select("incident_id", "person_seq", x.alias("px"), y.alias("py"))
    return there.select("incident_id", "person_seq", (F.round(lat, 6) + 0.0).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))  # + 0.0: no negative zero


@query("prj02_street_name", "SELECT seg_id, CASE WHEN seg_id % 7 = 0 THEN 'OLD MILL RD' ELSE concat(predir, ' ', name, ' ', type, ' N') END AS street FROM streets")
def _(s: Scene):
    odd = F.col("seg_id") % 7 == 0
    raw = s.streets.withColumns({"nm": F.when(odd, "nan").otherwise(F.concat(F.lit("  "), F.lower("name"))), "sufdir": F.lit(" n "), "label": F.lit("Old  Mill Rd")})
    return raw.select("seg_id", C.street_name("predir", "nm", "type", "sufdir", "label").alias("street"))


@query("prj03_route_name", "SELECT route_id, CASE WHEN route_id % 3 = 0 THEN concat('SR-', altname) WHEN route_id % 3 = 1 THEN '(unnamed segment)' ELSE concat(predir, ' ', name, ' ', type) END AS route_name FROM routes")
def _(s: Scene):
    named = s.routes.withColumns({"nm": F.when(F.col("route_id") % 3 == 2, F.col("name")), "alt": F.when(F.col("route_id") % 3 == 0, F.col("altname"))})
    return named.select("route_id", C.route_name("predir", "nm", "type", "alt").alias("route_name"))


@query("prj04_name_key", "SELECT seg_id, CASE WHEN seg_id % 2 = 0 THEN name ELSE name_key END AS name_key FROM streets")
def _(s: Scene):
    return s.streets.select("seg_id", C.name_key(F.when(F.col("seg_id") % 2 == 0, "nan").otherwise(F.col("predir")), F.lower("name")).alias("name_key"))


@query("prj05_base_form", "SELECT query_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(q), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), '^(w|e) ', ''), ' (ave|st)$', '')) AS base FROM searches")
def _(s: Scene):
    return s.searches.select("query_id", C.base_form("q").alias("base"))


@query("prj06_display_name", "SELECT DISTINCT street, concat(predir, ' ', upper(substr(name, 1, 1)), lower(substr(name, 2)), ' ', CASE type WHEN 'AVE' THEN 'Avenue' ELSE 'Street' END) AS display FROM streets")
def _(s: Scene):
    return s.streets.select("street").distinct().select("street", C.display_name("street").alias("display"))


@query("prj07_severity", f"SELECT injury, CAST({Q.RANK} AS BIGINT) AS severity_rank, {Q.LABEL.replace('CASE r', f'CASE {Q.RANK}')} AS label, count(*) AS people FROM person_rows GROUP BY injury")
def _(s: Scene):
    per = s.person_rows.groupBy("injury").agg(F.count(F.lit(1)).alias("people"))
    rank = C.severity_rank("injury")
    return per.select("injury", rank.cast("bigint").alias("severity_rank"), C.severity_label(rank).alias("label"), "people")


@query("prj08_event_date", "SELECT incident_id, person_seq, CAST(incident_date AS VARCHAR) AS from_millis, CAST(incident_date AS VARCHAR) AS from_text FROM person_rows")
def _(s: Scene):
    days = F.unix_date("incident_date")
    text = F.when(F.col("person_seq") % 2 == 0, F.date_format("incident_date", "M/d/yyyy")).otherwise(F.date_format("incident_date", "yyyy-MM-dd"))
    return s.person_rows.select("incident_id", "person_seq", F.date_format(C.epoch_date(days.cast("bigint") * 86400000 + 3600000), "yyyy-MM-dd").alias("from_millis"), C.iso_date(text).alias("from_text"))


@query("prj09_owner", "SELECT owner, CASE owner WHEN 'City' THEN 'City' WHEN 'State route' THEN 'State' ELSE 'Limited' END AS owner_group, CAST(CASE owner WHEN 'City' THEN 0 WHEN 'State route' THEN 1 ELSE 2 END AS BIGINT) AS code, count(*) AS segments FROM rulebook GROUP BY owner")
def _(s: Scene):
    per = s.rulebook.groupBy("owner").agg(F.count(F.lit(1)).alias("segments"))
    return per.select("owner", C.owner_group("owner").alias("owner_group"), C.owner_code("owner").cast("bigint").alias("code"), "segments")


GOOD = "lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0) AND lat BETWEEN 34.99e0 AND 35.42e0 AND lon BETWEEN -90.31e0 AND -89.61e0"


@query("flt01_good_location", f"SELECT coalesce({GOOD}, false) AS good, count(*) AS people FROM person_rows GROUP BY 1")
def _(s: Scene):
    return s.person_rows.groupBy(C.good_location(box=CITY_BOX).alias("good")).agg(F.count(F.lit(1)).alias("people"))


@query("flt02_severity_light_design", f"SELECT {Q.n('true')} AS crashes, {Q.n("severity = 'Fatal'")} AS fatal, {Q.n("light LIKE 'Dark%'")} AS dark, {Q.n("light = 'Dark-Not Lighted'")} AS unlit, "
       f"{Q.n('lanes >= 4')} AS wide, {Q.n('speed >= 40')} AS fast, {Q.n('lanes >= 4 AND speed >= 40')} AS wide_and_fast FROM named")
def _(s: Scene):
    return s.named.agg(F.count(F.lit(1)).alias("crashes"), A.n_fatal().alias("fatal"), F.count_if(C.is_dark()).alias("dark"), F.count_if(C.is_unlit()).alias("unlit"),
                       F.count_if(C.is_wide()).alias("wide"), F.count_if(C.is_fast()).alias("fast"), F.count_if(C.is_wide() & C.is_fast()).alias("wide_and_fast"))


@query("flt03_location", "SELECT coalesce(location LIKE 'Intersection%', false) AS at_corner, coalesce(location LIKE '%On Roadway%' OR location LIKE '%In Crosswalk%', false) AS related, count(*) AS people FROM person_rows GROUP BY 1, 2")
def _(s: Scene):
    return s.person_rows.groupBy(C.at_intersection().alias("at_corner"), C.crossing_related().alias("related")).agg(F.count(F.lit(1)).alias("people"))


TAG = {"ped": "(lower(coalesce(crossing, '')) = 'traffic_signals' OR lower(coalesce(signals, '')) = 'yes')"}
TAG["full"] = f"({TAG['ped']} OR lower(coalesce(highway, '')) = 'traffic_signals')"
TAG["bare"] = f"(lower(coalesce(highway, '')) = 'traffic_signals' AND NOT {TAG['ped']})"
MARKED = "lower(coalesce(markings, '')) NOT IN ('', 'no', 'nan', 'none')"


@query("flt04_tags", f"SELECT signal_id, {MARKED} AS is_marked, {TAG['ped']} AS ped_signal, {TAG['full']} AS full_signal, {TAG['bare']} AS bare_signal FROM tagged")
def _(s: Scene):
    return s.tagged.select("signal_id", C.is_marked("markings").alias("is_marked"), C.is_ped_signal("crossing", "signals").alias("ped_signal"),
                           C.is_full_signal("crossing", "signals", "highway").alias("full_signal"), C.is_bare_signal("crossing", "signals", "highway").alias("bare_signal"))


_ODD = "CASE seg_id % 5 WHEN 0 THEN concat('INTERSTATE ', CAST(ln AS VARCHAR(20))) WHEN 1 THEN concat('240 E TO ', name) WHEN 2 THEN concat('I-', CAST(ln AS VARCHAR(20)), ' TO ', name) WHEN 3 THEN concat(name, ' TOWER') ELSE street END"


@query("flt05_interstate_names", f"SELECT mainline, ramp, count(*) AS segments FROM (SELECT contains(nm, 'INTERSTATE') AS mainline, regexp_matches(nm, '\\bTO\\b') AND (regexp_matches(nm, '\\bI[- ]?[0-9]') OR list_has_any(string_split_regex(nm, '[^A-Z0-9]+'), ['240', '55'])) AND NOT contains(nm, 'INTERSTATE') AS ramp FROM (SELECT {_ODD} AS nm FROM streets) a) b GROUP BY ALL")
def _(s: Scene):
    nm = s.streets.select(F.expr(_ODD).alias("nm"))
    return nm.groupBy(C.is_mainline("nm").alias("mainline"), C.is_ramp_name("nm", ("240", "55")).alias("ramp")).agg(F.count(F.lit(1)).alias("segments"))


@query("flt06_road_class", f"SELECT {Q.THROUGH} AS through, mtfcc IN ('S1100', 'S1630') AS separated, count(*) AS segments FROM streets GROUP BY 1, 2")
def _(s: Scene):
    return s.streets.groupBy(C.is_through().alias("through"), C.is_grade_separated().alias("separated")).agg(F.count(F.lit(1)).alias("segments"))


@query("flt07_keywords", "SELECT seg_id, name FROM streets WHERE name LIKE '%VALLEY4%' OR name LIKE '%ORY1%'")
def _(s: Scene):
    return s.streets.where(C.has_keyword("name", ("valley4", "ORY1"))).select("seg_id", "name")


@query("flt08_person_rows_of_fatal", "SELECT location, count(*) AS people FROM person_rows WHERE incident_id IN (SELECT incident_id FROM incidents WHERE severity = 'Fatal') GROUP BY location")
def _(s: Scene):
    ids = s.person_rows.where(F.col("injury") == C.FATAL).select("incident_id")
    return s.person_rows.join(ids, "incident_id", "left_semi").groupBy("location").agg(F.count(F.lit(1)).alias("people"))


# --- 2.3 joins ---------------------------------------------------------------------------------


@query("jn01_points_in_polygon", "SELECT incident_id FROM incidents p JOIN boundary s ON (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < s.x1 + (p.y - s.y1) * (s.x2 - s.x1) / nullif(s.y2 - s.y1, 0e0) GROUP BY incident_id HAVING count(*) % 2 = 1")
def _(s: Scene):
    return P.points_in_polygon(s.incidents, s.boundary, point_id="incident_id")


@query("jn02_nearest_segment", f"SELECT incident_id, seg_id, {Q.dm('dist')} AS dist_dm, {Q.dm('100 * t')} AS permille FROM incident_segment")
def _(s: Scene):
    hit = P.nearest(s.incidents, s.streets, point_id="incident_id", key=["seg_id"])
    return hit.select("incident_id", "seg_id", dm("dist").alias("dist_dm"), dm(F.col("t") * 100).alias("permille"))


@query("jn03_nearest_within", f"SELECT i.incident_id, CASE WHEN r.dist <= 30 THEN r.route_id END AS route_id, CASE WHEN r.dist <= 30 THEN {Q.dm('r.dist')} END AS dist_dm FROM incidents i JOIN incident_route r USING (incident_id)")
def _(s: Scene):
    hit = P.nearest(s.incidents, s.routes, point_id="incident_id", key=["route_id"], within=30.0)
    return s.incidents.select("incident_id").join(hit, "incident_id", "left").select("incident_id", "route_id", dm("dist").alias("dist_dm"))


@query("jn04_nearest_point", f"SELECT incident_id, signal_id, {Q.dm('dist')} AS dist_dm FROM ({Q.nearest_place('incidents', 'incident_id', 'signals', 'signal_id')}) q")
def _(s: Scene):
    hit = P.nearest_point(s.incidents, s.signals, point_id="incident_id", key=["signal_id"], cell=250.0)
    return hit.select("incident_id", "signal_id", dm("dist").alias("dist_dm"))


@query("jn05_within_distance", f"SELECT signal_id, seg_id, {Q.dm('sqrt(' + Q.d2() + ')')} AS dist_dm FROM signals p JOIN streets s ON {Q.d2()} <= 900e0")
def _(s: Scene):
    pairs = P.within_distance(s.signals.select("signal_id", "x", "y"), s.streets.select("seg_id", *P.GEOMETRY), 30.0)
    return pairs.select("signal_id", "seg_id", dm("dist").alias("dist_dm"))


@query("jn06_buffer_overlap", "SELECT seg_id, round(ov10, 4) AS ov10, round(ov8, 4) AS ov8 FROM measured")
def _(s: Scene):
    wide, tight = O.buffer_overlap(s.streets, s.routes, 10.0, out="ov10"), O.buffer_overlap(s.streets, s.routes, 8.0, out="ov8")
    full = s.streets.select("seg_id").join(wide, "seg_id", "left").join(tight, "seg_id", "left").fillna(0.0)
    return full.select("seg_id", F.round("ov10", 4).alias("ov10"), F.round("ov8", 4).alias("ov8"))


@query("jn07_same_name_overlap", "SELECT seg_id, round(share, 4) AS ov_same FROM ov_same")
def _(s: Scene):
    return O.buffer_overlap(s.streets, s.routes, 10.0, by=["name_key"], out="ov").select("seg_id", F.round("ov", 4).alias("ov_same"))


@query("jn08_name_present", "SELECT DISTINCT seg_id FROM iv_same")
def _(s: Scene):
    return O.name_present(s.streets, s.routes, 10.0, key="name_key")


@query("jn09_line_crossings", f"SELECT name_a, name_b, {Q.dm('x')} AS x_dm, {Q.dm('y')} AS y_dm FROM met")
def _(s: Scene):
    return X.line_crossings(s.through).select("name_a", "name_b", dm("x").alias("x_dm"), dm("y").alias("y_dm"))


@query("jn10_grade_separated", "SELECT name_a AS street, count(*) AS crossings FROM (" + Q.crossing_points("through", "(SELECT * REPLACE ('*' AS street) FROM streets WHERE mtfcc IN ('S1100', 'S1630'))", "true") + ") q GROUP BY name_a")
def _(s: Scene):
    return K.grade_separated_count(s.through, s.streets.where(C.is_grade_separated()))


@query("jn11_endpoint_nodes", "SELECT gx, gy, string_agg(street, '; ' ORDER BY street) AS streets FROM (SELECT DISTINCT street, CAST(round(x) AS BIGINT) AS gx, CAST(round(y) AS BIGINT) AS gy FROM (SELECT street, x1 AS x, y1 AS y FROM through UNION ALL SELECT street, x2, y2 FROM through) e) q GROUP BY gx, gy HAVING count(*) >= 2")
def _(s: Scene):
    return X.endpoint_nodes(s.through).select("gx", "gy", F.array_join("streets", "; ").alias("streets"))


@query("jn12_attribute_lookup", "SELECT incident_id, lanes, speed, owner FROM classified")
def _(s: Scene):
    return s.classified.select("incident_id", "lanes", "speed", "owner")


@query("jn13_override", "SELECT incident_id, CASE WHEN mtfcc = 'S1100' AND seg_m <= 30 THEN 'Interstate' ELSE severity END AS label FROM named")
def _(s: Scene):
    new = s.named.where((F.col("mtfcc") == "S1100") & (F.col("seg_m") <= 30)).select("incident_id", F.lit(C.INTERSTATE).alias("new"))
    return s.incidents.join(new, "incident_id", "left").select("incident_id", F.coalesce("new", "severity").alias("label"))


@query("jn14_transfer", f"SELECT node_id, CAST(signal_id * 10 AS BIGINT) AS value FROM ({Q.nearest_place('nodes', 'node_id', 'signals', 'signal_id')}) q WHERE dist <= 25")
def _(s: Scene):
    old = s.signals.withColumn("value", F.col("signal_id") * 10)
    return P.transfer_by_location(old, s.nodes, old_id="signal_id", new_id="node_id", value="value")


@query("jn15_match_rate", "SELECT side, count(*) AS n, count(*) FILTER (WHERE dist <= 30) AS within_30, count(*) FILTER (WHERE dist <= 50) AS within_50, count(*) FILTER (WHERE dist > 50) AS only FROM ("
       + "SELECT 'a' AS side, dist FROM node_xing UNION ALL SELECT 'b', dist FROM (" + Q.nearest_place("xings", "crossing_id", "nodes", "node_id") + ") q) u GROUP BY side")
def _(s: Scene):
    return K.match_rate(s.nodes, s.signal_crossings, a_id="node_id", b_id="crossing_id")


_TWO_ROADS = (
    f"SELECT signal_id, street, {Q.dm('dist')} AS dist_dm, nxt AS next_road, {Q.dm('nd')} AS next_dm, nd - dist <= 15 AS is_ambiguous, nd - dist > 15 AND dist > 35 AS is_far FROM (SELECT signal_id, street, dist, lead(street) OVER w AS nxt, lead(dist) OVER w AS nd, row_number() OVER w AS place FROM ("
       f"SELECT p.signal_id, s.street, min(sqrt({Q.d2()})) AS dist, arg_min(s.seg_id, ({Q.d2()}, s.seg_id)) AS seg FROM signals p CROSS JOIN streets s GROUP BY p.signal_id, s.street) q WINDOW w AS (PARTITION BY signal_id ORDER BY dist, seg)) z WHERE place = 1"
)


@query("jn16_nearest_two_roads", _TWO_ROADS)
def _(s: Scene):
    two = P.nearest_two_roads(s.signals, s.streets, point_id="signal_id", road="street", key=["seg_id"])
    return two.select("signal_id", "street", dm("dist").alias("dist_dm"), "next_road", dm("next_dist").alias("next_dm"), "is_ambiguous", "is_far")


@query("jn17_line_presence", "SELECT p.seg_id, coalesce(h.dist <= 20, false) AS has_line, CAST(CASE WHEN h.dist <= 20 AND w.width > 0 THEN w.width ELSE 0 END AS BIGINT) AS width FROM streets p LEFT JOIN ("
       + Q.nearest_piece("(SELECT seg_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM streets)", "seg_id", "sidewalks", "walk_id") + ") h USING (seg_id) LEFT JOIN sidewalks w ON w.walk_id = h.walk_id")
def _(s: Scene):
    return K.line_presence(s.streets, s.sidewalks).withColumn("width", F.col("width").cast("bigint"))


@query("jn18_owner_along_line", f"SELECT c.street, b.owner, {Q.dm('c.m_start')} AS from_dm, {Q.dm('c.m_start + c.len')} AS to_dm FROM chains c JOIN rulebook b USING (seg_id)")
def _(s: Scene):
    at = s.chains.join(s.rulebook.select("seg_id", "owner"), "seg_id")
    low = F.when(F.col("m_dir") > 0, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    return at.select("street", "owner", dm(low).alias("from_dm"), dm(low + F.col("len")).alias("to_dm"))


@query("jn20_top_corridor_segments", "SELECT s.seg_id, r.street, r.total, r.fatal, r.dominant_owner FROM streets s JOIN (SELECT * FROM ranking ORDER BY total DESC, fatal DESC, street LIMIT 25) r USING (street) WHERE s.predir = 'W'")
def _(s: Scene):
    best = A.top(s.ranking, 25, "total", "fatal").select("street", "total", "fatal", "dominant_owner")
    # 25 rows
    return s.streets.where("predir = 'W'").join(F.broadcast(best), "street").select("seg_id", "street", "total", "fatal", "dominant_owner")


@query("jn21_non_city_segments", "SELECT seg_id, owner FROM rulebook WHERE owner <> 'City' AND predir = 'W'")
def _(s: Scene):
    return s.rulebook.where((F.col("owner") != C.CITY) & (F.col("predir") == "W")).select("seg_id", "owner")


# --- 2.4 aggregates -----------------------------------------------------------------------------

FATAL = "severity = 'Fatal'"


@query("ag01_dedup_incidents", "SELECT * FROM incidents")
def _(s: Scene):
    return s.incidents


@query("ag02_corridor_ranking", "SELECT * FROM ranking")
def _(s: Scene):
    return s.ranking


@query("ag03_dominant_owner", "SELECT street, owner, round_even(100e0 * k / al, 1) AS share_pct FROM street_best")
def _(s: Scene):
    return A.dominant(s.classed, ["street"], "owner", out="owner").select("street", "owner", F.bround(100.0 * F.col("share"), 1).alias("share_pct"))


@query("ag04_modal_speed", "SELECT * FROM street_speed")
def _(s: Scene):
    return A.modal_nonzero(s.classed, ["street"], "speed")


@query("ag05_owner_split", f"SELECT owner, crashes, fatal, people, {Q.pct('crashes', 'sum(crashes) OVER ()')} AS crashes_pct, {Q.pct('fatal', 'sum(fatal) OVER ()')} AS fatal_pct, {Q.pct('people', 'sum(people) OVER ()')} AS people_pct FROM (SELECT owner, count(*) AS crashes, {Q.n(FATAL)} AS fatal, CAST(sum(victims) AS BIGINT) AS people FROM classed GROUP BY owner) q")
def _(s: Scene):
    return A.owner_split(s.classed)


_RANGE = " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, {Q.n("owner IN ('City', 'State route')")} AS surface, {Q.n("owner = 'City'")} AS city, {Q.n("owner = 'State route'")} AS state, {Q.n('is_corner')} AS corner, {Q.n('is_limited')} AS limited FROM classified WHERE {ok}"
    for scope, ok in (("all", "true"), ("fatal", FATAL))
)


@query("ag06_owner_split_range", f"SELECT *, {Q.pct('city', 'surface')} AS city_pct, {Q.pct('state', 'surface')} AS state_pct, {Q.pct('city - corner', 'surface')} AS city_low_pct, {Q.pct('state + corner', 'surface')} AS state_high_pct FROM ({_RANGE}) q")
def _(s: Scene):
    return A.owner_split_range(s.classified)


@query("ag07_threshold_sensitivity", f"SELECT lim * 1e0 AS limit_m, {Q.n('dist <= lim')} AS within, {Q.pct(Q.n('dist <= lim'), 'count(*)')} AS within_pct FROM incident_route CROSS JOIN (VALUES (10), (20), (30), (40), (50)) v(lim) GROUP BY lim")
def _(s: Scene):
    hit = P.nearest(s.incidents, s.routes, point_id="incident_id", key=["route_id"], cell=500.0)
    return A.threshold_sensitivity(hit, "dist", (10, 20, 30, 40, 50))


_FIELDS = ("severity", "location", "light", "mtfcc", "owner")


@query("ag08_by_category", " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS crashes, {Q.n(FATAL)} AS fatal FROM classed GROUP BY {f}" for f in _FIELDS))
def _(s: Scene):
    return A.by_category(s.classed, _FIELDS)


@query("ag09_by_year_and_lanes", f"SELECT year(incident_date) AS yr, CAST(lanes AS BIGINT) AS lanes, count(*) AS crashes, {Q.n(FATAL)} AS fatal, CAST(sum(victims) AS BIGINT) AS people FROM classed GROUP BY 1, 2")
def _(s: Scene):
    return A.totals_by(s.classed.select(F.year("incident_date").cast("bigint").alias("yr"), F.col("lanes").cast("bigint").alias("lanes"), "severity", "victims"), ["yr", "lanes"])


@query("ag10_route_ranking", f"SELECT r.name AS route, count(*) AS crashes, {Q.n(FATAL)} AS fatal, CAST(sum(victims) AS BIGINT) AS people FROM incidents i JOIN incident_route m USING (incident_id) JOIN routes r ON r.route_id = m.route_id WHERE m.dist <= 30 GROUP BY r.name ORDER BY crashes DESC, fatal DESC, route LIMIT 10")
def _(s: Scene):
    hit = P.nearest(s.incidents, s.routes, point_id="incident_id", key=["route_id"], carry=["name"], within=30.0).select("incident_id", F.col("name").alias("route"))
    return A.top(A.totals_by(s.incidents.join(hit, "incident_id"), ["route"]), 10, "crashes", "fatal", tie="route")


@query("ag10_routes_by_deaths", f"SELECT r.name AS route, {Q.n(FATAL)} AS fatal, count(*) AS crashes FROM incidents i JOIN incident_route m USING (incident_id) JOIN routes r ON r.route_id = m.route_id WHERE m.dist <= 30 GROUP BY r.name ORDER BY fatal DESC, crashes DESC, route LIMIT 10")
def _(s: Scene):
    hit = P.nearest(s.incidents, s.routes, point_id="incident_id", key=["route_id"], carry=["name"], within=30.0).select("incident_id", F.col("name").alias("route"))
    return A.top(A.totals_by(s.incidents.join(hit, "incident_id"), ["route"]), 10, "fatal", "crashes", tie="route").select("route", "fatal", "crashes")


_TESTS = {"dark": "light LIKE 'Dark%'", "unlit": "light = 'Dark-Not Lighted'", "wide": "lanes >= 4", "fast": "speed >= 40", "wide_fast": "lanes >= 4 AND speed >= 40"}


def _scoped(tests, source):
    cols = ", ".join(f"{Q.n(t)} AS {k}, {Q.pct(Q.n(t), 'count(*)')} AS {k}_pct" for k, t in tests.items())
    return f"SELECT 'all' AS scope, count(*) AS n, {cols} FROM {source} UNION ALL SELECT 'fatal', count(*), {cols} FROM {source} WHERE {FATAL}"


@query("ag11_design_light_shares", _scoped(_TESTS, "classed"))
def _(s: Scene):
    return A.scoped_shares(s.classed, {"dark": C.is_dark(), "unlit": C.is_unlit(), "wide": C.is_wide(), "fast": C.is_fast(), "wide_fast": C.is_wide() & C.is_fast()})


@query("ag12_concentration", f"SELECT CAST({Q.n('cum < al / 2e0')} + 1 AS BIGINT) AS streets_for_half, count(*) AS streets, {Q.n('fatal = 0')} AS zero_fatal, {Q.n('total = 1')} AS one_crash, {Q.n('fatal > 0')} AS any_fatal FROM (SELECT *, sum(fatal) OVER (ORDER BY fatal DESC, total DESC, street) AS cum, sum(fatal) OVER () AS al FROM ranking) q")
def _(s: Scene):
    return A.concentration(s.ranking)


@query("ag13_lethality", "SELECT street, total, fatal, round(fatal * 1e0 / total, 6) AS fatal_share FROM ranking WHERE total >= 5 ORDER BY fatal * 1e0 / total DESC, fatal DESC, street LIMIT 6")
def _(s: Scene):
    best = A.top(A.lethality(s.ranking), 6, "fatal_share", "fatal")
    return best.select("street", "total", "fatal", F.round("fatal_share", 6).alias("fatal_share"))


@query("ag14_profile_by_owner", f"SELECT dominant_owner, streets, crashes, fatal, mean_lanes, mean_speed FROM (SELECT dominant_owner, count(*) AS streets FROM ranking GROUP BY 1) a JOIN (SELECT dominant_owner, count(*) AS crashes, {Q.n(FATAL)} AS fatal, round_even(avg(c.lanes), 1) AS mean_lanes, round_even(avg(c.speed) FILTER (WHERE c.speed > 0), 1) AS mean_speed FROM classed c JOIN ranking r USING (street) GROUP BY 1) b USING (dominant_owner)")
def _(s: Scene):
    return A.profile_by_owner(s.classed, A.corridor_ranking(s.classed))


@query("ag14_top25_profile", f"SELECT round_even(avg(lanes), 1) AS mean_lanes, round_even(avg(speed), 1) AS mean_speed, {Q.pct(Q.n('lanes >= 4'), 'count(*)')} AS wide_pct, {Q.pct(Q.n('speed >= 40'), 'count(*)')} AS fast_pct FROM (SELECT * FROM ranking ORDER BY total DESC, fatal DESC, street LIMIT 25) q")
def _(s: Scene):
    n = F.count(F.lit(1))
    return A.top(s.ranking, 25, "total", "fatal").agg(F.bround(F.avg("lanes"), 1).alias("mean_lanes"), F.bround(F.avg("speed"), 1).alias("mean_speed"), C.percent(F.count_if(C.is_wide()), n).alias("wide_pct"), C.percent(F.count_if(C.is_fast()), n).alias("fast_pct"))


# Location labels of the records.
_PLACES = {"mid_block": "location = 'Not Intersection-On Roadway Not In Crosswalk'", "no_crosswalk": "location IN ('Not Intersection-On Roadway Crosswalk not Available', 'Intersection-On Roadway Crosswalk Not Available')", "in_crosswalk": "location = 'Intersection-In Crosswalk'"}


@query("ag15_fatal_location_profile", _scoped(_PLACES, "incidents"))
def _(s: Scene):
    loc = F.col("location")
    return A.scoped_shares(s.incidents, {"mid_block": loc == "Not Intersection-On Roadway Not In Crosswalk", "no_crosswalk": loc.isin("Not Intersection-On Roadway Crosswalk not Available", "Intersection-On Roadway Crosswalk Not Available"), "in_crosswalk": loc == "Intersection-In Crosswalk"})


@query("ag16_join_quality", f"SELECT count(*) AS n, {Q.dm('quantile_cont(dist, 0.5)')} AS median_dm, {Q.dm('avg(dist)')} AS mean_dm, {Q.dm('max(dist)')} AS max_dm, {Q.n('dist > 40')} AS far, {Q.pct(Q.n('dist > 40'), 'count(*)')} AS far_pct FROM incident_segment")
def _(s: Scene):
    snap = s.named.select(F.col("seg_m").alias("dist"))
    half = scan.percentiles(snap, "dist", [0.5]).select(F.col("value").alias("median_m"), F.lit(1).alias("_one"))
    one = A.snap_quality(snap).withColumn("_one", F.lit(1)).join(half, "_one")
    return one.select("n", dm("median_m").alias("median_dm"), dm("mean_m").alias("mean_dm"), dm("max_m").alias("max_dm"), "far", "far_pct")


@query("ag17_ownership_mileage", "SELECT owner, rule, count(*) AS segments, round(sum(len) / 1609.344e0, 3) AS miles FROM rulebook GROUP BY owner, rule")
def _(s: Scene):
    return A.ownership_mileage(s.rulebook, ["owner", "rule"]).withColumn("miles", F.round("miles", 3))


@query("ag18_lane_mileage", "SELECT round_even(100 * sum(len) FILTER (WHERE sf AND lanes >= 4) / sum(len) FILTER (WHERE sf), 1) AS wide_surface_pct, round_even(100 * sum(len) FILTER (WHERE lanes >= 4) / sum(len) FILTER (WHERE lanes > 0), 1) AS wide_all_pct, round_even(100 * sum(len) FILTER (WHERE lanes > 0) / sum(len), 1) AS known_pct, CAST(round_even(sum(len) FILTER (WHERE sf) / 1609.344e0, 0) AS BIGINT) AS surface_miles FROM (SELECT *, lanes > 0 AND mtfcc NOT IN ('S1100', 'S1630') AS sf FROM pieces) q")
def _(s: Scene):
    from curbline.functions.geometry import piece_length

    return A.lane_mileage(s.streets.withColumn("len", piece_length()))


@query("ag19_overlap_histogram", "SELECT CASE WHEN v < 0.1e0 THEN '[0, 0.1)' WHEN v < 0.3e0 THEN '[0.1, 0.3)' WHEN v < 0.6e0 THEN '[0.3, 0.6)' WHEN v < 0.85e0 THEN '[0.6, 0.85)' ELSE '[0.85, 1.01)' END AS bin, count(*) AS n FROM (SELECT round(share, 6) AS v FROM ov10) q GROUP BY 1")
def _(s: Scene):
    return A.histogram(O.buffer_overlap(s.streets, s.routes, 10.0).withColumn("overlap", F.round("overlap", 6)), "overlap")


_FIRST = f"(SELECT i.incident_id, CASE WHEN NOT coalesce({GOOD}, false) THEN 'Excluded' WHEN k.incident_id IS NULL THEN 'Outside' WHEN r.dist <= 30 THEN 'State route' ELSE 'City' END AS owner, k.incident_id IS NOT NULL AND coalesce({GOOD}, false) AS in_city, r.route_id, r.dist FROM incidents i JOIN incident_route r USING (incident_id) LEFT JOIN (" + (
    "SELECT incident_id FROM incidents p JOIN boundary s ON (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < s.x1 + (p.y - s.y1) * (s.x2 - s.x1) / nullif(s.y2 - s.y1, 0e0) GROUP BY incident_id HAVING count(*) % 2 = 1) k USING (incident_id))"
)


def _both_methods(s: Scene) -> DataFrame:
    first = R.first_pass_classify(s.stored, s.boundary, s.routes, box=CITY_BOX).select("incident_id", F.col("owner").alias("owner_before"))
    return s.classified.join(first, "incident_id")


@query("ag20_label_transitions", f"SELECT a.owner AS before, b.owner AS after, count(*) AS n FROM {_FIRST} a JOIN classified b USING (incident_id) GROUP BY ALL")
def _(s: Scene):
    return A.transitions(_both_methods(s), "owner_before", "owner")


@query("ag21_label_mix_by_keyword", f"SELECT keyword, a.owner AS owner_before, b.owner, count(*) AS n FROM {_FIRST} a JOIN classified b USING (incident_id) JOIN (VALUES ('HICKORY2'), ('VALLEY4'), ('HICKORY1'), ('ST'), ('E HICKORY5')) k(keyword) ON regexp_matches(b.street, concat('\\b', keyword, '\\b')) GROUP BY ALL")
def _(s: Scene):
    return A.mix_by_keyword(_both_methods(s), "street", ["owner_before", "owner"], ("HICKORY2", "VALLEY4", "HICKORY1", "ST", "E HICKORY5"))


@query("ag22_signal_clusters", f"SELECT crossing_id, n_signals, n_heads, n_buttons, n_routes, {Q.dm('x')} AS x_dm, {Q.dm('y')} AS y_dm, dom_route, dom_street FROM xings JOIN x_dom_route USING (crossing_id) JOIN x_dom_street USING (crossing_id)")
def _(s: Scene):
    return s.signal_crossings.select("crossing_id", "n_signals", "n_heads", "n_buttons", "n_routes", dm("x").alias("x_dm"), dm("y").alias("y_dm"), "dom_route", "dom_street")


@query("ag23_covered_corridors", "SELECT street, CAST(own_signals AS BIGINT) AS own_signals, by_route, by_own FROM covered_streets")
def _(s: Scene):
    return s.covered


@query("ag24_junction_totals", "SELECT node_id, crashes, deaths FROM full_nodes")
def _(s: Scene):
    return s.full_nodes.select("node_id", "crashes", "deaths")


@query("ag24_most_dangerous", "SELECT node_id, streets, crashes, deaths FROM full_nodes ORDER BY crashes DESC, deaths DESC, node_id LIMIT 15")
def _(s: Scene):
    return A.top(s.full_nodes, 15, "crashes", "deaths", tie="node_id").select("node_id", F.array_join("streets", "; ").alias("streets"), "crashes", "deaths")


@query("ag25_signalized_split", f"SELECT intersection_signalized AS status, at_intersection, is_ambiguous, count(*) AS crashes, {Q.n(FATAL)} AS fatal FROM signal_status GROUP BY 1, 2, 3")
def _(s: Scene):
    return s.signal_status.groupBy(F.col("intersection_signalized").alias("status"), "at_intersection", "is_ambiguous").agg(F.count(F.lit(1)).alias("crashes"), A.n_fatal().alias("fatal"))


@query("ag25_ambiguity_kinds", f"SELECT {Q.n('NOT at_intersection AND coalesce(k.on_covered, false)')} AS not_reported, {Q.n('at_intersection AND intersection_node_id IS NULL')} AS not_found, {Q.n('at_intersection AND t.dist > 20')} AS off_road, "
       f"{Q.n('at_intersection AND intersection_node_id IS NULL AND t.dist > 20')} AS not_found_off_road FROM signal_status x LEFT JOIN marked_nodes k ON k.node_id = x.intersection_node_id LEFT JOIN ({Q.nearest_piece('incidents', 'incident_id', 'through', 'seg_id')}) t USING (incident_id)")
def _(s: Scene):
    road = P.nearest(s.stored, s.through, point_id="incident_id", key=["seg_id"]).select("incident_id", "dist")
    return A.ambiguity_kinds(s.signal_status, s.marked_nodes, road)


@query("ag26_signals_per_street", "SELECT street, count(*) AS signalized FROM node_street JOIN marked_nodes USING (node_id) WHERE signalized AND street IN (SELECT street FROM covered_streets) GROUP BY street")
def _(s: Scene):
    share = A.exploded_signal_share(s.marked_nodes).where("signalized > 0").select("street", "signalized")
    return share.join(s.covered.select("street"), "street", "left_semi")


@query("ag27_street_summary", f"SELECT street, base, display, {Q.dm('x_min')} AS x_min, {Q.dm('y_min')} AS y_min, {Q.dm('x_max')} AS x_max, {Q.dm('y_max')} AS y_max, {Q.dm('length_m')} AS length_dm, CAST(owner_code AS BIGINT) AS owner_code, crashes FROM street_index")
def _(s: Scene):
    return s.street_index.select("street", "base", "display", *[dm(c).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], dm("length_m").alias("length_dm"), F.col("owner_code").cast("bigint").alias("owner_code"), "crashes")


@query("ag28_alias_groups", "SELECT alias_key, member FROM aliases")
def _(s: Scene):
    return s.aliases


@query("ag29_corridor_completeness", f"SELECT name_key, round(al / 1609.344e0, 3) AS covered_miles, {Q.pct('tag', 'al')} AS tagged_pct, under_segments, round(low / 1609.344e0, 3) AS under_miles, {Q.pct('tag', 'al')} < 90 AS flagged FROM (SELECT name_key, sum(len) AS al, coalesce(sum(len) FILTER (WHERE first_owner = 'State route'), 0e0) AS tag, count(*) FILTER (WHERE first_owner = 'City' AND ov_same >= 0.5e0) AS under_segments, coalesce(sum(len) FILTER (WHERE first_owner = 'City' AND ov_same >= 0.5e0), 0e0) AS low FROM rulebook WHERE ov_same > 0 GROUP BY name_key) q")
def _(s: Scene):
    from curbline.plans.scene import RULES

    out = R.corridor_completeness(R.first_pass_tags(s.measured, RULES))
    return out.withColumns({"covered_miles": F.round("covered_miles", 3), "under_miles": F.round("under_miles", 3)})


@query("ag30_under_tag_impact", f"SELECT count(*) AS city, {Q.n('ov_same >= 0.05')} AS under_tagged, {Q.n('ov_same >= 0.05 AND ' + FATAL)} AS under_tagged_fatal, {Q.n("c.street LIKE '%VALLEY1%'")} AS layer_gap, {Q.n("c.street LIKE '%VALLEY1%' AND " + FATAL)} AS layer_gap_fatal FROM classified c JOIN rulebook b USING (seg_id) WHERE b.owner = 'City'")
def _(s: Scene):
    return R.under_tag_impact(s.classified, s.rulebook, under=0.05, gap_names=("VALLEY1",))


@query("ag31_gap_percentiles", "SELECT share, CAST(floor(v * 10 + 0.500001) AS BIGINT) AS gap_dm FROM (SELECT unnest([0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0, 1e0]) AS share, unnest(quantile_cont(g, [0.5, 0.75, 0.9, 0.95, 0.99, 1])) AS v FROM (SELECT sqrt(" + Q.gap2() + ") AS g FROM met a JOIN met b ON a.name_a = b.name_a AND a.crossing_key < b.crossing_key AND " + Q.gap2() + " <= 62500e0 AND (a.name_a = b.name_a)) q) u")
def _(s: Scene):
    # the lattice has no divided roads, so gaps along one street (up to a block) stand in
    one = s.met.withColumn("name_b", F.lit("*"))
    return scan.percentiles(X.same_pair_gaps(one, 250.0), "dist", [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]).select("share", dm("value").alias("gap_dm"))


_NN = Q.nearest_place("signals", "signal_id", "(SELECT signal_id AS other, x, y FROM signals)", "other", "a.signal_id <> b.other")


@query("ag32_nn_distance_profile", f"SELECT measure, round(v, 3) AS value FROM (SELECT unnest(['p10', 'p25', 'p50', 'p75', 'p90', 'p95']) AS measure, unnest(quantile_cont(dist, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95])) AS v FROM ({_NN}) q) z UNION ALL "
       + " UNION ALL ".join(f"SELECT 'within_{k}', {Q.pct(Q.n(f'dist <= {k}'), 'count(*)')} FROM ({_NN}) q" for k in (5, 15, 25, 40)))
def _(s: Scene):
    return K.nn_profile(s.signals.select("signal_id", "x", "y"), point_id="signal_id").withColumn("value", F.round("value", 3))


@query("ag33_crossing_density", f"SELECT street, round(chain_len / 1609.344e0, 3) AS miles, coalesce(c, 0) AS crossings, round(coalesce(c, 0) / (chain_len / 1609.344e0), 3) AS per_mile, round(CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0, 3) AS gap_miles, coalesce(c, 0) / (chain_len / 1609.344e0) >= 4 AND CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0 <= 1 AS usable, CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0 >= 3 AS cliff FROM lines LEFT JOIN (SELECT street, count(*) AS c FROM mark_near GROUP BY street) k USING (street) LEFT JOIN (SELECT street, max(gap) AS g FROM (SELECT street, pos - lag(pos) OVER (PARTITION BY street ORDER BY pos) AS gap FROM (SELECT street, m AS pos FROM mark_near UNION ALL SELECT street, 0e0 FROM lines UNION ALL SELECT street, chain_len FROM lines) u) z GROUP BY street) y USING (street)".replace("mark_near", f"(SELECT street, m FROM (SELECT p.signal_id, s.street, s.m_start + {Q.foot()} * s.len AS m, row_number() OVER (PARTITION BY p.signal_id, s.street ORDER BY sqrt({Q.d2()}), s.seg_id) AS rn FROM marked p JOIN chains s ON {Q.d2()} <= 900e0) w WHERE rn = 1)"))
def _(s: Scene):
    marked = s.tagged.where(C.is_marked("markings")).select("signal_id", "x", "y")
    out = K.crossing_density(marked, s.ref, s.lines, point_id="signal_id")
    return out.withColumns({c: F.round(c, 3) for c in ("miles", "per_mile", "gap_miles")})


_IN_CITY = "(SELECT {p}.* FROM {t} {p} WHERE (SELECT count(*) FROM boundary s WHERE (s.y1 > {p}.y) <> (s.y2 > {p}.y) AND {p}.x < s.x1 + ({p}.y - s.y1) * (s.x2 - s.x1) / nullif(s.y2 - s.y1, 0e0)) % 2 = 1)"
_CUTS = (
    "(SELECT seg_id, t FROM (SELECT s.seg_id, ((r.x1 - s.x1) * (r.y2 - r.y1) - (r.y1 - s.y1) * (r.x2 - r.x1)) / nullif((s.x2 - s.x1) * (r.y2 - r.y1) - (s.y2 - s.y1) * (r.x2 - r.x1), 0e0) AS t, "
    "((r.x1 - s.x1) * (s.y2 - s.y1) - (r.y1 - s.y1) * (s.x2 - s.x1)) / nullif((s.x2 - s.x1) * (r.y2 - r.y1) - (s.y2 - s.y1) * (r.x2 - r.x1), 0e0) AS u FROM pieces s CROSS JOIN boundary r) q "
    "WHERE t > 0 AND t < 1 AND u BETWEEN -1e-9 AND 1.000000001e0 UNION ALL SELECT seg_id, unnest([0e0, 1e0]) FROM pieces)"
)
_SPANS = f"(SELECT seg_id, t AS t0, lead(t) OVER (PARTITION BY seg_id ORDER BY t) AS t1 FROM {_CUTS} c)"
_PARTS = (
    "(SELECT *, sum(len) OVER (PARTITION BY street) AS chain_len, coalesce(sum(len) OVER (PARTITION BY street ORDER BY seg_id, t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS m_start FROM ("
    "SELECT s.street, w.seg_id, t0, s.len * (t1 - t0) AS len, s.x1 + t0 * (s.x2 - s.x1) AS x1, s.y1 + t0 * (s.y2 - s.y1) AS y1, s.x1 + t1 * (s.x2 - s.x1) AS x2, s.y1 + t1 * (s.y2 - s.y1) AS y2, s.x1 + (t0 + t1) / 2 * (s.x2 - s.x1) AS x, "
    f"s.y1 + (t0 + t1) / 2 * (s.y2 - s.y1) AS y FROM {_SPANS} w JOIN pieces s USING (seg_id) WHERE t1 - t0 > 1e-9) z WHERE " + _IN_CITY.split(" WHERE ", 1)[1][:-1].format(p="z") + ")"
)


@query("ag33_density_inside", f"SELECT * FROM (WITH parts AS {_PARTS}, own AS (SELECT street, any_value(chain_len) AS chain_len FROM parts GROUP BY street), near AS (SELECT street, m FROM (SELECT p.signal_id, s.street, s.m_start + {Q.foot()} * s.len AS m, row_number() OVER (PARTITION BY p.signal_id, s.street ORDER BY sqrt({Q.d2()}), s.seg_id, s.t0) AS rn "
       f"FROM {_IN_CITY.format(p='p', t='marked')} p JOIN parts s ON {Q.d2()} <= 900e0) w WHERE rn = 1), gap AS (SELECT street, max(gap) AS g FROM (SELECT street, pos - lag(pos) OVER (PARTITION BY street ORDER BY pos) AS gap FROM (SELECT street, m AS pos FROM near UNION ALL SELECT street, 0e0 FROM own UNION ALL SELECT street, chain_len FROM own) u) z GROUP BY street) "
       "SELECT street, round(chain_len / 1609.344e0, 3) AS miles, coalesce(c, 0) AS crossings, round(coalesce(c, 0) / (chain_len / 1609.344e0), 3) AS per_mile, round(CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0, 3) AS gap_miles, coalesce(c, 0) / (chain_len / 1609.344e0) >= 4 AND CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0 <= 1 AS usable, "
       "CASE WHEN c >= 2 THEN g ELSE chain_len END / 1609.344e0 >= 3 AS cliff FROM own LEFT JOIN (SELECT street, count(*) AS c FROM near GROUP BY street) k USING (street) LEFT JOIN gap USING (street)) whole")
def _(s: Scene):
    marked = s.tagged.where(C.is_marked("markings")).select("signal_id", "x", "y")
    out = density_inside(marked, s.streets, s.boundary, point_id="signal_id")
    return out.withColumns({c: F.round(c, 3) for c in ("miles", "per_mile", "gap_miles")})


@query("ag34_inside_outside", f"SELECT k.signal_id IS NOT NULL AS inside, lower(coalesce(markings, '')) AS markings, {MARKED} AS is_marked, count(*) AS n FROM tagged t LEFT JOIN (SELECT signal_id FROM tagged p JOIN boundary s ON (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < s.x1 + (p.y - s.y1) * (s.x2 - s.x1) / nullif(s.y2 - s.y1, 0e0) GROUP BY signal_id HAVING count(*) % 2 = 1) k USING (signal_id) GROUP BY 1, 2, 3")
def _(s: Scene):
    inside = P.points_in_polygon(s.tagged, s.boundary, point_id="signal_id").withColumn("_in", F.lit(True))
    both = s.tagged.join(inside, "signal_id", "left")
    return both.groupBy(C.flag(F.col("_in")).alias("inside"), F.lower(F.coalesce("markings", F.lit(""))).alias("markings"), C.is_marked("markings").alias("is_marked")).agg(F.count(F.lit(1)).alias("n"))


@query("ag35_density_grid", f"SELECT CAST(floor(x / 500e0) AS BIGINT) AS gx, CAST(floor(y / 500e0) AS BIGINT) AS gy, count(*) AS crashes, {Q.n(FATAL)} AS fatal FROM incidents GROUP BY 1, 2")
def _(s: Scene):
    return A.density_grid(s.incidents)


@query("ag36_name_quality_flags", "SELECT street, 'directional split' AS flag FROM (SELECT street, count(*) OVER (PARTITION BY substr(street, 3)) AS k FROM (SELECT DISTINCT street FROM streets) d) q WHERE k > 1")
def _(s: Scene):
    return A.name_quality_flags(s.streets.select("street").distinct())


@query("ag37_interstate_audit", f"SELECT street, count(*) AS crashes, {Q.n(FATAL)} AS fatal, {Q.n("a.owner = 'City'")} AS was_city, {Q.n("a.owner = 'State route'")} AS was_state, (SELECT string_agg(CAST(v AS VARCHAR), '/' ORDER BY v) FROM (SELECT DISTINCT unnest(list(speed)) AS v) u WHERE v > 0) AS speeds FROM {_FIRST} a JOIN classified b USING (incident_id) WHERE mtfcc = 'S1100' GROUP BY street")
def _(s: Scene):
    return R.interstate_audit(_both_methods(s))


_OPTIONS = " UNION ALL ".join(
    f"SELECT '{name}' AS option, {Q.n(c)} AS city, {Q.n(st)} AS state, {Q.n(f'({c}) AND {FATAL}')} AS city_fatal, {Q.n(f'({st}) AND {FATAL}')} AS state_fatal FROM both_labels"
    for name, c, st in (
        ("before", "ob = 'City'", "ob = 'State route'"), ("moved", "ob = 'City' AND mtfcc <> 'S1100'", "ob = 'State route' OR (ob = 'City' AND mtfcc = 'S1100')"), ("apart", "ob = 'City' AND mtfcc <> 'S1100'", "ob = 'State route' AND mtfcc <> 'S1100'"),
    )
).replace("both_labels", f"(SELECT a.owner AS ob, b.mtfcc, b.severity FROM {_FIRST} a JOIN classified b USING (incident_id)) bl")


@query("ag37_interstate_options", f"SELECT *, {Q.pct('city', 'city + state')} AS city_pct, {Q.pct('state', 'city + state')} AS state_pct FROM ({_OPTIONS}) q")
def _(s: Scene):
    return R.interstate_options(_both_methods(s))


@query("ag38_reconcile", "SELECT part, got, want, got = want AS agrees FROM (SELECT 'owners' AS part, count(*) AS got FROM classified WHERE owner IS NOT NULL UNION ALL SELECT 'streets', CAST(sum(crashes) AS BIGINT) FROM street_index UNION ALL SELECT 'ranking', CAST(sum(total) AS BIGINT) FROM ranking) p CROSS JOIN (SELECT count(*) AS want FROM incidents) w")
def _(s: Scene):
    from curbline.operators.refresh import reconcile

    parts = {
        "owners": A.totals_by(s.classified, ["owner"]).agg(F.sum("crashes").alias("n")), "streets": s.street_index.agg(F.sum("crashes").alias("n")),
        "ranking": s.ranking.agg(F.sum("total").alias("n")),
    }
    return reconcile(s.classified, parts)


@query("ag38_top_in_two_ways", "SELECT street, total, fatal, 'first' AS side FROM ranking WHERE false")
def _(s: Scene):
    from curbline.operators.refresh import tables_differ

    one = A.top(s.ranking.select("street", "total", "fatal"), 25, "total", "fatal")
    per = A.totals_by(s.named, ["street"]).select("street", F.col("crashes").alias("total"), "fatal")
    return tables_differ(one, A.top(per, 25, "total", "fatal"))


@query("ag39_inventory", "SELECT 'junctions' AS table_name, count(*) AS rows FROM nodes UNION ALL SELECT 'corridors', count(*) FROM ranking UNION ALL SELECT 'sidewalks', count(*) FROM sidewalks UNION ALL SELECT 'crossings', count(*) FROM xings")
def _(s: Scene):
    return A.inventory({"junctions": s.nodes, "corridors": s.ranking, "sidewalks": s.sidewalks, "crossings": s.signal_crossings})


@query("ag40_street_signal_share", f"SELECT street, count(*) AS junctions, {Q.n('signalized')} AS signalized, {Q.pct(Q.n('signalized'), 'count(*)')} AS signalized_pct FROM node_street JOIN marked_nodes USING (node_id) GROUP BY street")
def _(s: Scene):
    return A.exploded_signal_share(s.marked_nodes)


# --- 2.5-2.7 windows, top-k, sets -----------------------------------------------------------------


@query("wn01_rank_corridors", "SELECT street, total, fatal, row_number() OVER (ORDER BY total DESC, fatal DESC, street) AS rank FROM ranking")
def _(s: Scene):
    return s.ranked.select("street", "total", "fatal", "rank")


@query("wn02_running_deaths", "SELECT street, total, fatal, CAST(sum(fatal) OVER (ORDER BY fatal DESC, total DESC, street ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_fatal FROM ranking")
def _(s: Scene):
    return A.deaths_running(s.ranking)


@query("wn05_first_match", f"SELECT signal_id, seg_id FROM signal_segment WHERE dist <= 125")
def _(s: Scene):
    from pyspark.sql import Window

    pairs = P.within_distance(s.signals.select("signal_id", "x", "y"), s.streets.select("seg_id", *P.GEOMETRY), 125.0)
    first = Window.partitionBy("signal_id").orderBy("dist", "seg_id")
    return pairs.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("signal_id", "seg_id")


_MONTHS = ", ".join(f"{Q.n(f'incident_date >= lim{m}')} AS m{m}_n, {Q.n(f'incident_date >= lim{m} AND {FATAL}')} AS m{m}_fatal" for m in (12, 6, 3, 1))


@query("wn07_trailing_windows", f"SELECT street, count(*) AS all_n, {Q.n(FATAL)} AS all_fatal, {_MONTHS} FROM named CROSS JOIN (SELECT " + ", ".join(f"max(incident_date) - INTERVAL {m} MONTH AS lim{m}" for m in (12, 6, 3, 1)) + " FROM incidents) w GROUP BY street")
def _(s: Scene):
    return A.trailing_windows(s.named, ["street"])


@query("wn08_coverage", "SELECT min(incident_date) AS first_date, max(incident_date) AS last_date FROM incidents")
def _(s: Scene):
    return A.coverage_dates(s.incidents)


@query("tk01_top25_by_total", "SELECT street, total, fatal FROM ranking ORDER BY total DESC, fatal DESC, street LIMIT 25")
def _(s: Scene):
    return A.top(s.ranking.select("street", "total", "fatal"), 25, "total", "fatal")


@query("tk01_top25_by_fatal", "SELECT street, total, fatal FROM ranking ORDER BY fatal DESC, total DESC, street LIMIT 25")
def _(s: Scene):
    return A.top(s.ranking.select("street", "total", "fatal"), 25, "fatal", "total")


@query("tk02_top_junctions", "SELECT node_id, crashes FROM full_nodes ORDER BY crashes DESC, node_id LIMIT 5")
def _(s: Scene):
    return A.top(s.full_nodes.select("node_id", "crashes"), 5, "crashes", tie="node_id")


@query("tk04_farthest", f"SELECT incident_id, street, {Q.dm('seg_m')} AS seg_dm FROM named ORDER BY round(seg_m, 6) DESC, incident_id LIMIT 10")
def _(s: Scene):
    far = s.named.orderBy(F.round("seg_m", 6).desc(), "incident_id").limit(10)
    return far.select("incident_id", "street", dm("seg_m").alias("seg_dm"))


@query("st01_union_all", f"SELECT part, count(*) AS n, count(street) AS named FROM (SELECT 'located' AS part, street FROM named WHERE coalesce({GOOD}, false) UNION ALL SELECT 'set aside', NULL FROM incidents WHERE NOT coalesce({GOOD}, false)) q GROUP BY part")
def _(s: Scene):
    located = s.named.where(C.good_location(box=CITY_BOX)).withColumn("part", F.lit("located"))
    aside = s.incidents.where(~C.good_location(box=CITY_BOX)).withColumn("part", F.lit("set aside"))
    return located.unionByName(aside, allowMissingColumns=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("street").alias("named"))


@query("st02_streets_added", "SELECT street FROM covered_streets WHERE by_own AND NOT by_route")
def _(s: Scene):
    own, route = s.covered.where("by_own").select("street"), s.covered.where("by_route").select("street")
    return own.exceptAll(route)


@query("st03_snapshot_ids", "SELECT 'gone' AS change, count(*) AS n FROM old_snap WHERE incident_id NOT IN (SELECT incident_id FROM new_snap) UNION ALL SELECT 'kept', count(*) FROM old_snap WHERE incident_id IN (SELECT incident_id FROM new_snap) UNION ALL SELECT 'new', count(*) FROM new_snap WHERE incident_id NOT IN (SELECT incident_id FROM old_snap)")
def _(s: Scene):
    old, new = s.old_snapshot.select("incident_id"), s.new_snapshot.select("incident_id")
    both = old.withColumn("_o", F.lit(1)).join(new.withColumn("_w", F.lit(1)), "incident_id", "full_outer")
    tests = {"gone": F.col("_w").isNull(), "kept": F.col("_o").isNotNull() & F.col("_w").isNotNull(), "new": F.col("_o").isNull()}
    counts = both.agg(*[F.count_if(test).alias(k) for k, test in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("change"), F.col(k).alias("n")) for k in tests])).alias("_c")).select("_c.*")


@query("st04_name_pairs", "SELECT DISTINCT name_a, name_b FROM met")
def _(s: Scene):
    return s.met.select("name_a", "name_b").distinct()
