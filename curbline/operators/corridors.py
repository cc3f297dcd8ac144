"""Safe crossings along roads, and fact tables per corridor, junction and place (JN17, LR4-LR8, AG33, LC1-LC3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import columns as C
from curbline.functions.geometry import METRES_PER_FOOT, METRES_PER_MILE
from curbline.operators import aggregates as A
from curbline.operators import network as N
from curbline.operators.chains import along_nearest, longest_gap, measured, spacing_and_gaps
from curbline.operators.crossings import crossings_between, meeting_points
from curbline.operators.graph import cluster_points
from curbline.operators.overlap import _pairs
from curbline.operators.scan import group_median, percentiles
from curbline.operators.spatial import as_pieces, nearest, nearest_point, nearest_two_roads, within_distance
from curbline.session import cut

LINE = ["street"]


def line_presence(pieces: DataFrame, lines: DataFrame, *, r: float = 20.0, seg_id: str = "seg_id", line_id: str = "walk_id") -> DataFrame:
    """Does a line run within ``r`` of each piece's middle, and its width where recorded (JN17)."""
    middle = pieces.select(seg_id, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    hit = nearest(middle, lines, point_id=seg_id, key=[line_id], carry=["width"], within=r)
    out = pieces.select(seg_id).join(hit, seg_id, "left")
    width = F.when(F.col("width") > 0, F.col("width")).otherwise(F.lit(0))
    return out.select(seg_id, F.col(line_id).isNotNull().alias("has_line"), width.alias("width"))


def near_lines(points: DataFrame, ref: DataFrame, r: float, *, point_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every line within ``r`` of each point: ``point_id, *keep, street, m, dist`` at its nearest piece.

    ``keep``: columns of the points; they are the same in all rows of one id.
    """
    slim = ref.select("street", "seg_id", "x1", "y1", "x2", "y2", "len", "m_start", "m_dir", "chain_id")
    pairs = within_distance(points.select(point_id, *dict.fromkeys(["x", "y", *keep])), slim, r).withColumn("m", measured())
    best = pairs.groupBy(point_id, *keep, "street").agg(F.min(F.struct("dist", "seg_id", "m", "chain_id")).alias("_b"))
    return best.select(point_id, *keep, "street", F.col("_b.m").alias("m"), F.col("_b.dist").alias("dist"), F.col("_b.chain_id").alias("chain_id"))


def point_at(marks: DataFrame, chains: DataFrame, *, step: float = 200.0) -> DataFrame:
    """``marks`` (with ``chain_id, m``) plus the ``x, y`` of that measure, clamped to the chain's ends."""
    low = F.when(F.col("m_dir") > 0, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    spans = chains.select("chain_id", "chain_len", low.alias("_lo"), "len", "m_dir", "x1", "y1", "x2", "y2")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor((F.col("_lo") + F.col("len")) / step))))
    sizes = chains.select("chain_id", "chain_len").distinct()
    at = marks.join(sizes, "chain_id").withColumn("_m", F.least(F.greatest(F.col("m"), F.lit(0.0)), F.col("chain_len"))).drop("chain_len")
    at = at.withColumn("_b", F.floor(F.col("_m") / step))
    met = at.join(spans.drop("chain_len"), ["chain_id", "_b"])
    off = F.greatest(F.col("_lo") - F.col("_m"), F.col("_m") - (F.col("_lo") + F.col("len")), F.lit(0.0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_m") - F.col("_lo")) / F.col("len")))
    share = F.when(F.col("m_dir") > 0, share).otherwise(1.0 - share)
    met = met.withColumns({"_off": off, "_s": share})
    pick = F.min(F.struct("_off", "_lo", (F.col("x1") + F.col("_s") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("_s") * (F.col("y2") - F.col("y1"))).alias("y"))).alias("_p")
    return met.groupBy(*marks.columns).agg(pick).select(*marks.columns, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def bearing(dx: Column, dy: Column) -> Column:
    """Undirected bearing in degrees, 0 <= b < 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def merged_places(lines: DataFrame, points: DataFrame, *, place_id: str, r: float = 8.0) -> DataFrame:
    """Marked lines and points merged to places by single linkage of their middles within ``r`` (LR4, AG33).

    A place is stood for by its longest line, else by its first point (the smallest id, also of equally long lines):
    ``place, place_id, is_line, n_lines, n_points, x1, y1, x2, y2``. ``place_id`` is unique over both inputs.
    """
    shape = ["x1", "y1", "x2", "y2"]
    both = lines.select(place_id, *shape, F.lit(True).alias("is_line")).unionByName(as_pieces(points).select(place_id, *shape, F.lit(False).alias("is_line")))
    both = cut(both.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2}))
    labels = cluster_points(both, r, point_id=place_id, out="place")
    length = F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 3)
    best = F.min(F.struct((~F.col("is_line")).alias("late"), (-length).alias("short"), place_id, *shape)).alias("_b")
    out = both.join(labels, place_id).groupBy("place").agg(best, F.count_if("is_line").alias("n_lines"), F.count_if(~F.col("is_line")).alias("n_points"))
    return out.select("place", f"_b.{place_id}", (~F.col("_b.late")).alias("is_line"), "n_lines", "n_points", *[f"_b.{c}" for c in shape])


def crossing_lines(lines: DataFrame, ref: DataFrame, *, line_id: str, r: float = 30.0, touch: float = 12.0, angle: float = 45.0, reach: float = 8.0) -> DataFrame:
    """Lines that really cross a road: steeper than ``angle`` to it and within ``touch`` (LR4).

    ``line_id, street, m, dist`` of the line's middle.
    """
    middle = lines.select(line_id, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    near = cut(near_lines(middle, ref, r, point_id=line_id))  # read by each of the tests below
    spots = near.select(line_id, "street", "chain_id", F.explode(F.array(F.struct(F.lit("p").alias("k"), (F.col("m") - reach).alias("m")), F.struct(F.lit("q").alias("k"), (F.col("m") + reach).alias("m")))).alias("_s"))
    spots = point_at(spots.select(line_id, "street", "chain_id", F.col("_s.k").alias("k"), F.col("_s.m").alias("m")), ref)
    pick = lambda k, c: F.min(F.when(F.col("k") == k, F.col(c)))
    road = spots.groupBy(line_id, "street").agg((pick("q", "x") - pick("p", "x")).alias("_dx"), (pick("q", "y") - pick("p", "y")).alias("_dy"))
    own = lines.select(line_id, bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("_b"))
    turn = F.abs(F.col("_b") - bearing(F.col("_dx"), F.col("_dy")))
    steep = road.join(own, line_id).where(F.least(turn, 180.0 - turn) > angle).select(line_id, "street")
    roads = ref.select("street", "x1", "y1", "x2", "y2")
    pairs = lines.join(near.select(line_id, "street"), line_id).select(F.concat_ws("|", line_id, "street").alias("_pair"), line_id, "street", "x1", "y1", "x2", "y2")
    meets = _pairs(pairs, roads, "_pair", touch, ["street"]).select("_pair").distinct()
    touching = pairs.join(meets, "_pair", "left_semi").select(line_id, "street")
    return near.join(steep, [line_id, "street"], "left_semi").join(touching, [line_id, "street"], "left_semi").drop("chain_id")


def crossing_points(points: DataFrame, ref: DataFrame, through: DataFrame, *, point_id: str, near: float = 8.0) -> DataFrame:
    """Marked points on a road: within ``near`` of it and no farther than from any other street (LR4)."""
    on = near_lines(points, ref, near, point_id=point_id, keep=["x", "y"])
    asked = on.select(F.concat_ws("|", point_id, "street").alias("_pair"), point_id, F.col("street").alias("_own"), "x", "y", "m", "dist")
    asked = cut(asked)
    other = nearest(asked, through, point_id="_pair", key=["seg_id"], carry=["street"], within=near, differ=("_own", "street"))
    out = asked.join(other.select("_pair", F.col("dist").alias("_other")), "_pair", "left")
    return out.where(F.col("_other").isNull() | (F.col("dist") <= F.col("_other"))).select(point_id, F.col("_own").alias("street"), "m", "dist")


def junction_points(ref: DataFrame, through: DataFrame) -> DataFrame:
    """Where each reference line meets differently named through-roads (LR5): ``street, x, y``."""
    return meeting_points(ref, through)


def junction_signals(crossings: DataFrame, ref: DataFrame, corners: DataFrame, *, point_id: str = "crossing_id", r: float = 30.0) -> DataFrame:
    """Signals near a road that also lie near one of its junctions (LR5): ``point_id, street, m, dist``."""
    on = near_lines(crossings, ref, r, point_id=point_id, keep=["x", "y"]).drop("chain_id")
    keyed = cut(on.withColumn("_pair", F.concat_ws("|", point_id, "street")))
    pair = keyed.select("_pair", "street", "x", "y")
    slim = as_pieces(corners).drop("x", "y")
    close = within_distance(pair, slim, r, by=LINE).select("_pair").distinct()
    return keyed.join(close, "_pair", "left_semi").select(point_id, "street", "m", "dist")


def safe_crossings(marked: DataFrame, signals: DataFrame, ref: DataFrame, *, r: float = 30.0) -> DataFrame:
    """Marked and signalized places of each road merged within ``r`` (LR6, ST1).

    Both inputs: ``place_id (string), street, x, y``. Result per road: ``safe_id, street, x, y, signalized, m``.
    """
    both = marked.withColumn("is_signal", F.lit(False)).unionByName(signals.withColumn("is_signal", F.lit(True)))
    both = both.withColumn("place_id", F.concat_ws("|", "street", "place_id"))
    labels = cluster_points(both, r, point_id="place_id", by=LINE, out="safe_id")
    merged = both.join(labels, "place_id").groupBy("safe_id", "street").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.bool_or("is_signal").alias("signalized"))
    merged = cut(merged)
    at = nearest(merged, ref, point_id="safe_id", key=["seg_id"], by=LINE, carry=["m_start", "m_dir", "len"])
    return merged.join(at.withColumn("m", measured()).select("safe_id", "m"), "safe_id")


def crossing_distances(incidents: DataFrame, safe: DataFrame, ref: DataFrame, *, r: float = 30.0) -> DataFrame:
    """Crossing-related incidents within ``r`` of each road and the along-road distance to its nearest
    safe crossing (LR3, LR7): ``incident_id, street, is_fatal, m, along_m``."""
    rel = incidents.where(C.crossing_related()).select("incident_id", "x", "y", C.is_fatal().alias("is_fatal"))
    on = near_lines(rel, ref, r, point_id="incident_id", keep=["is_fatal"]).drop("chain_id", "dist")
    on = cut(on.withColumn("_pair", F.concat_ws("|", "incident_id", "street")))
    hit = along_nearest(on, safe, point_id="_pair", target_id="safe_id", by=LINE)
    return on.join(hit.select("_pair", "along_m"), "_pair", "left").select("incident_id", "street", "m", "along_m", "is_fatal")


def distance_stats(distances: DataFrame, *, near_ft: float = 100.0, gap_ft: float = 250.0) -> DataFrame:
    """Per road: crossing-related incidents by distance to the nearest safe crossing (LR7)."""
    distances, d = cut(distances), F.col("along_m") / METRES_PER_FOOT
    stats = distances.groupBy("street").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if("is_fatal").alias("fatal"), F.avg("along_m").alias("mean_m"), F.max("along_m").alias("max_m"),
        F.count_if(C.flag(d <= near_ft)).alias("near"), F.count_if(C.flag(d > gap_ft)).alias("in_gap"), F.count_if(C.flag((d > near_ft) & (d <= gap_ft))).alias("between"),
    )
    return stats.join(group_median(distances, LINE, "along_m", "median_m"), LINE, "left")


def corridor_gaps(positions: DataFrame, lines: DataFrame, *, good_ft: float = 300.0) -> DataFrame:
    """Per road: longest stretch without a position, its ends and its multiple of ``good_ft``, and mean, median and
    largest spacing (WN3, WN4, LR7)."""
    gaps = cut(spacing_and_gaps(positions, lines, by=LINE))
    inner = gaps.groupBy("street").agg(F.avg(F.when(F.col("inner"), F.col("gap"))).alias("mean_spacing"), F.max(F.when(F.col("inner"), F.col("gap"))).alias("max_spacing"))
    out = longest_gap(gaps, by=LINE).join(inner, "street").join(group_median(gaps.where("inner"), LINE, "gap", "median_spacing"), LINE, "left")
    return out.withColumn("gap_ratio", F.col("longest_gap") / (good_ft * METRES_PER_FOOT))


def safe_summary(safe: DataFrame, lines: DataFrame) -> DataFrame:
    """Per road with safe crossings (LC2): how many, how many signalized, their spacing and the longest gap."""
    count = safe.groupBy("street").agg(F.count(F.lit(1)).alias("safe_n"), F.count_if("signalized").alias("signal_n"))
    return count.join(corridor_gaps(safe, lines), LINE, "left").select("street", "safe_n", "signal_n", "longest_gap", "median_spacing", "gap_ratio")


def crossing_density(points: DataFrame, ref: DataFrame, lines: DataFrame, *, point_id: str, r: float = 30.0, per_mile: float = 4.0, max_gap: float = 1.0, cliff: float = 3.0) -> DataFrame:
    """Per road: length, crossings, crossings per mile, longest gap, usable and cliff flags (AG33)."""
    on = near_lines(points, ref, r, point_id=point_id)
    count = on.groupBy("street").agg(F.count(F.lit(1)).alias("crossings"))
    gap = longest_gap(spacing_and_gaps(on, lines, by=LINE), by=LINE)
    out = lines.join(count, "street", "left").fillna(0, ["crossings"]).join(gap, "street", "left")
    miles = F.col("chain_len") / METRES_PER_MILE
    longest = F.when(F.col("crossings") >= 2, F.col("longest_gap")).otherwise(F.col("chain_len")) / METRES_PER_MILE
    out = out.select("street", miles.alias("miles"), "crossings", (F.col("crossings") / miles).alias("per_mile"), longest.alias("gap_miles"))
    return out.withColumns({"usable": (F.col("per_mile") >= per_mile) & (F.col("gap_miles") <= max_gap), "cliff": F.col("gap_miles") >= cliff})


def nodes_to_safe(nodes: DataFrame, safe: DataFrame, ref: DataFrame) -> DataFrame:
    """Along-road distance from each junction of a road to its nearest safe crossing (LR8)."""
    spread = nodes.select("node_id", "x", "y", F.explode("streets").alias("street")).join(ref.select("street").distinct(), "street", "left_semi")
    spread = cut(spread.withColumn("_pair", F.concat_ws("|", "node_id", "street")))
    at = nearest(spread, ref, point_id="_pair", key=["seg_id"], by=LINE, carry=["m_start", "m_dir", "len"]).withColumn("m", measured())
    placed = cut(spread.join(at.select("_pair", "m"), "_pair"))
    hit = along_nearest(placed, safe, point_id="_pair", target_id="safe_id", by=LINE)
    return placed.join(hit.select("_pair", "along_m"), "_pair").select("node_id", "street", "along_m")


def location_facts(places: DataFrame, chains: DataFrame, graph: DataFrame, incidents: DataFrame, owners: DataFrame, sidewalks: DataFrame, nodes: DataFrame, *, place_id: str, window: float = 300.0, node_within: float = 35.0) -> DataFrame:
    """What is known about each place (LC1): its road and owner, doubt, sidewalk, incidents within
    ``window`` along the road, the road's trailing windows, its junction.

    ``incidents``: with ``street, chain_id, m``. ``owners``: ``seg_id, owner``.
    """
    snap = nearest_two_roads(places, chains, point_id=place_id, road="street", key=["seg_id"], carry=["chain_id", "m_start", "m_dir", "len"])
    snap = snap.withColumn("m", measured()).select(place_id, "seg_id", "street", "chain_id", "m", F.col("dist").alias("snap_m"), "next_road", "next_dist", "is_ambiguous", "is_far")
    seg_owner = owners.select("seg_id", F.col("owner").alias("road_owner"))
    varies = chains.select("seg_id", "street").join(owners, "seg_id").groupBy("street").agg((F.count_distinct("owner") > 1).alias("owner_varies"))
    walk = line_presence(chains, sidewalks).select("seg_id", F.col("has_line").alias("has_sidewalk"))
    near = N.network_count(snap.select(place_id, "chain_id", "m"), incidents, graph, start_id=place_id, measures={"window_crashes": F.count(F.lit(1)), "window_fatal": A.n_fatal()}, window=window)
    whole = graph.groupBy("street", "cluster").agg(F.sum("chain_len").alias("connected_m"))
    sections = graph.groupBy("street").agg(F.count_distinct("cluster").alias("sections"))
    cluster = graph.select("chain_id", "cluster")
    recent = A.trailing_windows(incidents, ["street"])
    corner = nearest_point(places, nodes, point_id=place_id, key=["node_id"], within=node_within).select(place_id, "node_id", F.col("dist").alias("node_m"))
    out = snap.join(seg_owner, "seg_id", "left").join(varies, "street", "left").join(walk, "seg_id", "left").join(near, place_id, "left")
    out = out.join(cluster, "chain_id", "left").join(whole, ["street", "cluster"], "left").join(sections, "street", "left").join(recent, "street", "left").join(corner, place_id, "left")
    return out.drop("cluster").fillna(0, [c for c in recent.columns if c != "street"])


def corridor_facts(ranked: DataFrame, incidents: DataFrame, streets: DataFrame, signal_share: DataFrame, covered: DataFrame, safe_summary: DataFrame) -> DataFrame:
    """Per street of the whole list (LC2): rank and totals where it has crashes, else honest zeros;
    null where signals or safe crossings were not analysed."""
    groups = incidents.where(F.col("street").isNotNull()).groupBy("street").agg(*[F.count_if(C.owner_group("owner") == g).alias(f"{g.lower()}_crashes") for g in ("City", "State", "Limited")])
    signals = covered.select("street").join(signal_share.select("street", "signalized"), "street", "left").fillna(0, ["signalized"])
    out = streets.select("street", "length_m", "owner_code").join(ranked.select("street", "rank", "total", "fatal"), "street", "left").join(groups, "street", "left")
    out = out.join(signals, "street", "left").join(safe_summary, "street", "left")
    return out.fillna(0, ["total", "fatal", "city_crashes", "state_crashes", "limited_crashes"])


def junction_facts(nodes: DataFrame, to_safe: DataFrame) -> DataFrame:
    """Per junction (LC3): display name, place, crashes, deaths, status y/n/u, feet to the nearest safe crossing."""
    from curbline.operators.search import junction_index

    near = to_safe.groupBy("node_id").agg(F.min("along_m").alias("_m"))
    feet = F.bround(F.col("_m") / METRES_PER_FOOT).cast("bigint").alias("safe_ft")
    return junction_index(nodes).join(near, "node_id", "left").select("node_id", "display", "x", "y", "crashes", "deaths", "status", feet)


def match_rate(a: DataFrame, b: DataFrame, *, a_id: str, b_id: str, radii: Sequence[float] = (30.0, 50.0)) -> DataFrame:
    """Share of each side with a partner within each radius (JN15); ``only`` = without one in the widest."""
    widest = max(radii)
    rows = None
    for side, p, q, p_id, q_id in (("a", a, b, a_id, b_id), ("b", b, a, b_id, a_id)):
        hit = nearest_point(p, q, point_id=p_id, key=[q_id], within=widest).select(p_id, "dist")
        full = p.select(p_id).join(hit, p_id, "left")
        one = full.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(C.flag(F.col("dist") <= r)).alias(f"within_{int(r)}") for r in radii], F.count_if(F.col("dist").isNull()).alias("only"))
        one = one.select(F.lit(side).alias("side"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def network_vs_radius(samples: DataFrame, incidents: DataFrame, graph: DataFrame, *, window: float = 300.0) -> DataFrame:
    """Per sample point: incidents by network distance and by straight line on its cluster (GR8)."""
    cluster = graph.select("chain_id", "cluster")
    net = N.network_count(samples.select("sample_id", "chain_id", "m"), incidents, graph, start_id="sample_id", measures={"by_network": F.count(F.lit(1))}, window=window)
    spots = incidents.join(cluster, "chain_id").groupBy("cluster", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    asked = samples.select("sample_id", "chain_id", "x", "y").join(cluster, "chain_id").drop("chain_id")
    pairs = within_distance(asked, as_pieces(spots).drop("x", "y"), window, by=["cluster"])
    radius = pairs.groupBy("sample_id").agg(F.sum("_n").alias("by_radius"))
    return net.join(radius, "sample_id", "left").fillna(0, ["by_radius"])


def nn_profile(points: DataFrame, *, point_id: str, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95), limits: Sequence[float] = (5, 15, 25, 40)) -> DataFrame:
    """Nearest-other-point distances: quantiles and shares within limits (AG32)."""
    asked = points.withColumn("_me", F.col(point_id))
    other = points.withColumnRenamed(point_id, "_other")
    near = nearest_point(asked, other, point_id=point_id, key=["_other"], differ=("_me", "_other"), cell=250.0).select(point_id, "dist")
    q = percentiles(near, "dist", shares).select(F.concat(F.lit("p"), F.bround(F.col("share") * 100).cast("int")).alias("measure"), "value")
    w = A.threshold_sensitivity(near, "dist", limits).select(F.concat(F.lit("within_"), F.col("limit_m").cast("int")).alias("measure"), F.col("within_pct").alias("value"))
    return q.unionByName(w)


def grade_separated_count(through: DataFrame, separated: DataFrame) -> DataFrame:
    """Plan-view crossings of through-roads with interstates and ramps: counted, never noded (JN10)."""
    return crossings_between(through, separated).groupBy("street").agg(F.count(F.lit(1)).alias("crossings"))
