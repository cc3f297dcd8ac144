"""Who owns a road and what that makes of an incident (RL*, AG22, AG23, AG29, AG30, AG37)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.functions.geometry import METRES_PER_MILE, piece_length
from curbline.operators.aggregates import dominant, n_fatal
from curbline.operators.graph import cluster_points
from curbline.operators.overlap import overlap_measures
from curbline.operators.spatial import nearest, nearest_point, points_in_polygon
from curbline.session import cut


@dataclass(frozen=True)
class Rulebook:
    """Thresholds of the ordered ownership rules, and the names they single out."""

    wide: float = 10.0
    tight: float = 8.0
    overlap: float = 0.60
    override: float = 0.85
    doubtful: float = 0.30
    same_name: float = 0.20
    limited_names: Sequence[str] = ()
    forced_ids: Sequence[int] = ()
    forced_names: Sequence[str] = field(default_factory=tuple)


def segment_measures(segments: DataFrame, routes: DataFrame, rules: Rulebook) -> DataFrame:
    """Segments with ``len, ov10, ov8, ov_same, name_hit``: how much they run beside routes."""
    beside = overlap_measures(segments, routes, wide=rules.wide, tight=rules.tight, key="name_key")
    beside = beside.withColumnsRenamed({"ov_wide": "ov10", "ov_tight": "ov8"})
    out = segments.withColumn("len", piece_length()).join(beside, "seg_id", "left")
    return out.fillna(0.0, ["ov10", "ov8", "ov_same"]).fillna(False, ["name_hit"])


def tag_segments(measured: DataFrame, rules: Rulebook) -> DataFrame:
    """Owner, rule, basis and doubt of every measured segment; the first rule that holds wins (RL1-RL3)."""
    beside = ((F.col("ov10") >= rules.overlap) & F.col("name_hit")) | (F.col("ov8") >= rules.override)
    forced = F.col("name_key").isin(*[n.upper() for n in rules.forced_names]) if rules.forced_names else F.lit(False)
    if rules.forced_ids:
        forced = forced | F.col("seg_id").isin(*rules.forced_ids)
    pct = lambda c: F.format_string("%.0f%%", 100 * F.col(c))
    name = F.initcap(F.lower("street"))
    # Rule names and the sentence stated for each.
    ladder = [
        (F.col("mtfcc") == "S1100", C.INTERSTATE, "interstate_mainline", F.lit("interstate: MTFCC S1100")),
        (F.col("mtfcc") == "S1630", C.RAMP, "interstate_ramp", F.lit("interstate ramp: MTFCC S1630")),
        (C.has_keyword("name", rules.limited_names), C.LIMITED, "limited_access_override", F.concat(F.lit("limited-access override: "), name)),
        (beside, C.STATE_ROUTE, "state_route_overlap", F.concat(F.lit("state route: "), pct("ov10"), F.lit(" overlap, name="), F.col("name_key"))),
        (forced, C.STATE_ROUTE, "force_state_route_manual", F.lit("force-state-route: manual override")),
        (F.col("ov_same") >= rules.same_name, C.STATE_ROUTE, "force_state_route_completeness",
         F.concat(F.lit("force-state-route: "), pct("ov_same"), F.lit(" collinear w/ same-named SR ("), F.col("name_key"), F.lit(")"))),
        (F.lit(True), C.CITY, "city_residual", F.lit("city: no state-route overlap")),
    ]

    def chain(index: int) -> Column:
        out = None
        for step in ladder:
            test, value = C.flag(step[0]), step[index] if isinstance(step[index], Column) else F.lit(step[index])
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    doubt = ((F.col("ov10") >= rules.doubtful) & (F.col("ov10") < rules.overlap)) | (
        (F.col("ov10") >= rules.overlap) & ~F.col("name_hit") & (F.col("ov8") < rules.override)
    )
    return measured.withColumns({"owner": chain(1), "rule": chain(2), "basis": chain(3), "is_doubtful": doubt})


def first_pass_tags(measured: DataFrame, rules: Rulebook) -> DataFrame:
    """The earlier three-rule form: interstate, ramp, state-route overlap, else city."""
    beside = ((F.col("ov10") >= rules.overlap) & F.col("name_hit")) | (F.col("ov8") >= rules.override)
    owner = F.when(F.col("mtfcc") == "S1100", F.lit(C.INTERSTATE)).when(F.col("mtfcc") == "S1630", F.lit(C.RAMP)).when(beside, F.lit(C.STATE_ROUTE)).otherwise(F.lit(C.CITY))
    return measured.withColumn("owner", owner)


def names_containing(names: DataFrame, tokens: DataFrame, *, name: str, token: str, shortest: int) -> DataFrame:
    """Distinct names that contain any token of at least ``shortest`` letters, by an equi join on
    the name's substrings (names are short; the token list may be long)."""
    upper = names.select(F.col(name).alias("_name")).distinct().where("_name is not null")
    start = F.sequence(F.lit(1), F.greatest(F.length("_name") - shortest + 1, F.lit(1)))
    parts = upper.withColumn("_i", F.explode(start)).withColumn(
        "_n", F.explode(F.sequence(F.lit(shortest), F.greatest(F.length("_name") - F.col("_i") + 1, F.lit(shortest))))
    )
    pieces = parts.select("_name", F.upper(F.col("_name").substr(F.col("_i"), F.col("_n"))).alias("_token"))
    words = tokens.select(F.upper(F.trim(F.col(token))).alias("_token")).distinct().where(F.length("_token") >= shortest)
    return pieces.join(words, "_token", "left_semi").select(F.col("_name").alias(name)).distinct()


def classify_incidents(incidents: DataFrame, rulebook: DataFrame, routes: DataFrame, *, corner: float = 10.0, cell: float = 125.0, route_cell: float = 500.0, snapped: DataFrame | None = None) -> DataFrame:
    """Each incident inherits owner, rule and basis of its nearest segment (RL4), plus flags.

    Attributes join once per matched segment id, not inside the spatial join. ``snapped``: the nearest segments
    (incident_id, seg_id, seg_m) where they are known already.
    """
    base = incidents.drop("seg_id", "seg_m", "owner", "rule", "basis", "street", "route_m", "is_limited", "is_override", "is_corner", "lanes", "speed", "mtfcc")
    hit = snapped
    if hit is None:
        hit = nearest(base, rulebook, point_id="incident_id", key=["seg_id"], cell=cell).select("incident_id", "seg_id", F.col("dist").alias("seg_m"))
    route = nearest(base, routes, point_id="incident_id", key=["route_id"], cell=route_cell).select("incident_id", F.col("dist").alias("route_m"))
    attrs = rulebook.select("seg_id", "owner", "rule", "basis", "street", "lanes", "speed", "mtfcc")
    near_named = names_containing(attrs, routes, name="street", token="name", shortest=4).withColumn("_named", F.lit(True))
    attrs = attrs.join(near_named, "street", "left")
    out = base.join(hit, "incident_id", "left").join(attrs, "seg_id", "left").join(route, "incident_id", "left")
    corner_case = C.flag((F.col("owner") == C.CITY) & C.at_intersection() & (F.col("route_m") <= corner) & F.col("_named").isNull())
    return out.withColumns(
        {
            "is_limited": C.flag(F.col("owner").isin(*C.LIMITED_OWNERS)),
            "is_override": C.flag(F.col("rule").isin("limited_access_override", "force_state_route_manual", "force_state_route_completeness")),
            "is_corner": corner_case,
        }
    ).drop("_named")


def first_pass_classify(incidents: DataFrame, boundary: DataFrame, routes: DataFrame, *, box: tuple[float, float, float, float], limit: float = 30.0, cell: float = 500.0) -> DataFrame:
    """Bad location, outside the city, state route within ``limit``, or city; one bucket each (RL5)."""
    marked = incidents.withColumn("good", C.good_location(box=box))
    usable = marked.where("good")
    inside = cut(points_in_polygon(usable, boundary, point_id="incident_id")).withColumn("_in", F.lit(True))
    near = nearest(usable.join(inside, "incident_id", "left_semi"), routes, point_id="incident_id", key=["route_id"], cell=cell)
    out = marked.join(inside, "incident_id", "left").join(near.select("incident_id", "route_id", F.col("dist").alias("route_m")), "incident_id", "left")
    label = F.when(~F.col("good"), F.lit("Excluded")).when(F.col("_in").isNull(), F.lit("Outside")).when(F.col("route_m") <= limit, F.lit(C.STATE_ROUTE)).otherwise(F.lit(C.CITY))
    kept = F.when(F.col("route_m") <= limit, F.col("route_id")).alias("route_id")
    return out.select(*incidents.columns, C.flag(F.col("_in")).alias("in_city"), label.alias("owner"), kept, "route_m")


def signal_crossings(signals: DataFrame, segments: DataFrame, *, r: float = 30.0, point_id: str = "signal_id", cell: float = 125.0) -> DataFrame:
    """Signals merged to crossings (AG22): members, heads, buttons, routes, usual route and street, centre."""
    snapped = nearest(signals, segments, point_id=point_id, key=["seg_id"], carry=["street"], cell=cell).select(point_id, "street")
    members = signals.join(snapped, point_id, "left").join(cluster_points(signals, r, point_id=point_id, out="crossing_id"), point_id)
    members = cut(members)
    core = members.groupBy("crossing_id").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("kind") == "Pedestrian Signal").alias("n_heads"), F.count_if(F.col("kind") == "Push Button").alias("n_buttons"),
        F.count_distinct("route_number").alias("n_routes"), F.avg("x").alias("x"), F.avg("y").alias("y"),
    )
    route = dominant(members, ["crossing_id"], "route_number", out="dom_route", share="_s").drop("_s")
    street = dominant(members, ["crossing_id"], "street", out="dom_street", share="_s").drop("_s")
    return core.join(route, "crossing_id", "left").join(street, "crossing_id", "left")


def covered_streets(snapped: DataFrame, *, least_route: int = 4, share: float = 0.25, least_own: int = 4) -> DataFrame:
    """Streets whose junctions count as covered by the signal inventory (AG23, ST2).

    ``snapped``: one row per signal with ``route_number, street``. A street is in when it is a
    well-signalled route's main street or holds ``share`` of it, or has enough signals itself.
    """
    pairs = snapped.groupBy("route_number", "street").agg(F.count(F.lit(1)).alias("n"))
    named = pairs.where(F.col("street").isNotNull() & (F.trim("street") != ""))
    whole = pairs.where(F.col("route_number").isNotNull()).groupBy("route_number").agg(F.sum("n").alias("_all")).where(F.col("_all") >= least_route)
    main = named.groupBy("route_number").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("street").alias("s"))).alias("_m"))
    judged = named.join(whole, "route_number").join(main, "route_number")
    by_route = judged.where((F.col("street") == F.col("_m.s")) | (F.col("n") >= share * F.col("_all"))).select("street").distinct().withColumn("by_route", F.lit(True))
    own = named.groupBy("street").agg(F.sum("n").alias("own_signals"))
    out = own.join(by_route, "street", "left").fillna(False, ["by_route"])
    return out.withColumn("by_own", F.col("own_signals") >= least_own).where("by_route or by_own")


def mark_nodes(nodes: DataFrame, crossings: DataFrame, covered: DataFrame, *, snap: float = 30.0, cell: float = 500.0) -> DataFrame:
    """Junctions with their nearest crossing, signal flag and coverage flag."""
    near = nearest_point(nodes, crossings, point_id="node_id", key=["crossing_id"], cell=cell).select("node_id", F.col("dist").alias("nearest_crossing_m"))
    on = nodes.select("node_id", F.explode("streets").alias("street")).join(covered.select("street"), "street", "left_semi").select("node_id").distinct().withColumn("on_covered", F.lit(True))
    out = nodes.join(near, "node_id", "left").join(on, "node_id", "left").fillna(False, ["on_covered"])
    return out.withColumn("signalized", C.flag(F.col("nearest_crossing_m") <= snap))


def intersection_status(incidents: DataFrame, nodes: DataFrame, crossings: DataFrame, *, snap: float = 30.0, cell: float = 250.0) -> DataFrame:
    """Junction, nearest signal and four-valued signal status per incident (RL6)."""
    node = nearest_point(incidents, nodes, point_id="incident_id", key=["node_id"], carry=["signalized", "on_covered"], cell=cell)
    node = node.select("incident_id", "node_id", "signalized", "on_covered", F.col("dist").alias("_dn"))
    sig = nearest_point(incidents, crossings, point_id="incident_id", key=["crossing_id"], cell=cell).select("incident_id", F.col("dist").alias("nearest_ped_signal_m"))
    out = incidents.join(node, "incident_id", "left").join(sig, "incident_id", "left")
    at, near = C.at_intersection(), C.flag(F.col("_dn") <= snap)
    status = F.when(~at, F.lit("")).when(near & F.col("signalized"), F.lit("yes")).when(near & F.col("on_covered"), F.lit("no")).otherwise(F.lit("no_signal_coverage"))
    return out.withColumns(
        {"at_intersection": at, "intersection_node_id": F.when(near, F.col("node_id")), "is_ambiguous": (~at & near) | (at & ~near), "intersection_signalized": status}
    ).drop("node_id", "signalized", "on_covered", "_dn")


def incident_junctions(incidents: DataFrame, nodes: DataFrame, *, snap: float = 30.0, cell: float = 250.0) -> DataFrame:
    """Incidents with a junction within ``snap``: ``incident_id, severity, intersection_node_id``, as in RL6 without the rest of it."""
    near = nearest_point(incidents, nodes, point_id="incident_id", key=["node_id"], cell=cell, within=snap * (1 + 1e-9)).where(F.col("dist") <= snap)
    return incidents.select("incident_id", "severity").join(near.select("incident_id", F.col("node_id").alias("intersection_node_id")), "incident_id")


def audit_verdict(points: DataFrame, routes: DataFrame, *, limit: float = 12.0, cell: float = 500.0) -> DataFrame:
    """Does the nearest route carry the incident's own street name, closer than ``limit``? (RL7)"""
    hit = nearest(points, routes, point_id="incident_id", key=["route_id"], carry=["name"], cell=cell)
    word = F.element_at(F.split(F.upper(F.trim(F.col("name"))), r"\s+"), -1)
    same = C.flag((word != "") & F.upper(F.col("street")).contains(word) & (F.col("dist") < limit))
    judged = points.select("incident_id", "street").join(hit, "incident_id")
    verdict = F.when(same, F.lit("under-tagged")).otherwise(F.lit("city correct"))
    return judged.select("incident_id", "street", F.col("name").alias("route_name"), F.col("dist").alias("route_m"), verdict.alias("verdict"))


def interstate_reclass(incidents: DataFrame, mainline: DataFrame, *, snap: str = "seg_m", limit: float = 30.0, cell: float = 500.0) -> DataFrame:
    """Interstate when the incident's own nearest street is one and close; the distance-only test
    beside it, for comparison (RL8)."""
    near = nearest(incidents, mainline, point_id="incident_id", key=["seg_id"], cell=cell).select("incident_id", F.col("dist").alias("interstate_m"))
    out = incidents.join(near, "incident_id", "left")
    used = C.flag((F.col("mtfcc") == "S1100") & (F.col(snap) <= limit))
    naive = C.flag(F.col("interstate_m") <= limit) & ~C.flag(F.col("mtfcc") == "S1630")
    return out.withColumns({"on_interstate": used, "naive_interstate": naive, "over_captured": naive & ~used})


def corridor_completeness(tagged: DataFrame, *, least: float = 90.0, under: float = 0.50) -> DataFrame:
    """Per name key with a route of the same name: covered miles, share tagged, under-tagged part (AG29)."""
    span = tagged.where(F.col("ov_same") > 0)
    low = (F.col("owner") == C.CITY) & (F.col("ov_same") >= under)
    per = span.groupBy("name_key").agg(
        F.sum("len").alias("_all"), F.coalesce(F.sum(F.when(F.col("owner") == C.STATE_ROUTE, F.col("len"))), F.lit(0.0)).alias("_tag"),
        F.count_if(low).alias("under_segments"), F.coalesce(F.sum(F.when(low, F.col("len"))), F.lit(0.0)).alias("_low"),
    )
    share = C.percent("_tag", "_all")
    return per.select("name_key", (F.col("_all") / METRES_PER_MILE).alias("covered_miles"), share.alias("tagged_pct"), "under_segments", (F.col("_low") / METRES_PER_MILE).alias("under_miles"), (share < least).alias("flagged"))


def under_tag_impact(incidents: DataFrame, tagged: DataFrame, *, under: float = 0.50, gap_names: Sequence[str] = ()) -> DataFrame:
    """City incidents on under-tagged segments, and on roads the route layer lacks (AG30)."""
    ids = tagged.where((F.col("owner") == C.CITY) & (F.col("ov_same") >= under)).select("seg_id").withColumn("_u", F.lit(True))
    city = incidents.where(F.col("owner") == C.CITY).join(ids, "seg_id", "left")
    on, band = C.flag(F.col("_u")), C.has_keyword("street", gap_names)
    return city.agg(F.count(F.lit(1)).alias("city"), F.count_if(on).alias("under_tagged"), F.count_if(on & C.is_fatal()).alias("under_tagged_fatal"), F.count_if(band).alias("layer_gap"), F.count_if(band & C.is_fatal()).alias("layer_gap_fatal"))


def interstate_audit(incidents: DataFrame, *, before: str = "owner_before") -> DataFrame:
    """Per interstate: crashes, deaths and what the earlier method called them (AG37)."""
    inter = incidents.where(C.flag(F.col("mtfcc") == "S1100"))
    return inter.groupBy("street").agg(
        F.count(F.lit(1)).alias("crashes"), n_fatal().alias("fatal"), F.count_if(C.flag(F.col(before) == C.CITY)).alias("was_city"),
        F.count_if(C.flag(F.col(before) == C.STATE_ROUTE)).alias("was_state"), F.array_sort(F.collect_set(F.when(F.col("speed") > 0, F.col("speed")))).alias("_sp"),
    ).withColumn("speeds", F.array_join("_sp", "/")).drop("_sp")


def interstate_options(incidents: DataFrame, *, before: str = "owner_before") -> DataFrame:
    """City / state split before, with interstates moved to the state, and with them set apart (AG37)."""
    b, inter = F.col(before), C.flag(F.col("mtfcc") == "S1100")
    city, state = C.flag(b == C.CITY), C.flag(b == C.STATE_ROUTE)
    options = [("before", city, state), ("moved", city & ~inter, state | (city & inter)), ("apart", city & ~inter, state & ~inter)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("option"), c.alias("c"), s.alias("s")) for n, c, s in options]))
    per = incidents.select(rows.alias("_o"), "severity").groupBy(F.col("_o.option").alias("option")).agg(
        F.count_if("_o.c").alias("city"), F.count_if("_o.s").alias("state"), F.count_if(F.col("_o.c") & C.is_fatal()).alias("city_fatal"), F.count_if(F.col("_o.s") & C.is_fatal()).alias("state_fatal")
    )
    return per.withColumns({"city_pct": C.percent("city", F.col("city") + F.col("state")), "state_pct": C.percent("state", F.col("city") + F.col("state"))})
