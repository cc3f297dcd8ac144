"""Where differently named lines meet, and the junctions this makes (JN9-JN11, AG31, GR3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geometry import cells_near
from curbline.operators.graph import cluster_points, connected_components
from curbline.operators.scan import global_rank, percentiles
from curbline.operators.spatial import as_pieces, within_distance
from curbline.session import cut

CELL = 100.0
_EPS = 1e-9
_SAFE = 0.01  # registration margin, so that rounding cannot lose the cell of a crossing


def _sides(pieces: DataFrame, name: str, mark: str) -> DataFrame:
    slim = pieces.select(F.col(name).alias(f"name_{mark}"), *[F.col(c).alias(f"{mark}{c}") for c in ("x1", "y1", "x2", "y2")])
    slim = slim.where((F.col(f"{mark}x1") != F.col(f"{mark}x2")) | (F.col(f"{mark}y1") != F.col(f"{mark}y2"))).distinct()
    spread = slim.withColumn("_at", F.explode(cells_near(CELL, _SAFE, *[f"{mark}{c}" for c in ("x1", "y1", "x2", "y2")])))
    return spread.withColumns({"_cx": F.col("_at.cx"), "_cy": F.col("_at.cy")}).drop("_at")


def _meet(left: DataFrame, right: DataFrame, name: str, keep: Column) -> DataFrame:
    """``name_a, name_b, x, y``: crossings, touching ends, middles of shared runs; 1 mm apart."""
    pairs = _sides(left, name, "a").join(_sides(right, name, "b"), ["_cx", "_cy"]).where(keep)
    c = F.col
    boxes = (
        (F.least("ax1", "ax2") <= F.greatest("bx1", "bx2") + _SAFE) & (F.least("bx1", "bx2") <= F.greatest("ax1", "ax2") + _SAFE)
        & (F.least("ay1", "ay2") <= F.greatest("by1", "by2") + _SAFE) & (F.least("by1", "by2") <= F.greatest("ay1", "ay2") + _SAFE)
    )
    pairs = pairs.where(boxes)
    dx, dy, ex, ey = c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("bx2") - c("bx1"), c("by2") - c("by1")
    wx, wy = c("bx1") - c("ax1"), c("by1") - c("ay1")
    den = dx * ey - dy * ex
    skew = F.abs(den) > 1e-12
    solved = pairs.withColumns(
        {
            "_skew": skew,
            "_t": (wx * ey - wy * ex) / F.nullif(den, F.lit(0.0)),
            "_u": (wx * dy - wy * dx) / F.nullif(den, F.lit(0.0)),
        }
    )
    inside = c("_t").between(-_EPS, 1 + _EPS) & c("_u").between(-_EPS, 1 + _EPS)
    px, py = c("ax1") + c("_t") * dx, c("ay1") + c("_t") * dy
    point = solved.where(c("_skew") & inside).select("name_a", "name_b", px.alias("x"), py.alias("y"), "_cx", "_cy")
    # a pair may share several cells: count it in the cell of the crossing
    point = point.where((F.floor(c("x") / CELL) == c("_cx")) & (F.floor(c("y") / CELL) == c("_cy"))).drop("_cx", "_cy")
    return _rounded(point.unionByName(_shared_runs(solved.where(~c("_skew")))))


def _shared_runs(parallel: DataFrame) -> DataFrame:
    """Middle of every maximal run where two parallel pieces lie on one carrier line."""
    c = F.col
    dx, dy = c("ax2") - c("ax1"), c("ay2") - c("ay1")
    long = F.sqrt(dx * dx + dy * dy)
    sign = F.when((dx < 0) | ((dx == 0) & (dy < 0)), F.lit(-1.0)).otherwise(F.lit(1.0))
    line = parallel.withColumns({"_ux": sign * dx / long, "_uy": sign * dy / long})

    def off(p):
        return c(f"{p[0]}x{p[1]}") * c("_uy") - c(f"{p[0]}y{p[1]}") * c("_ux")

    def along(p):
        return c(f"{p[0]}x{p[1]}") * c("_ux") + c(f"{p[0]}y{p[1]}") * c("_uy")

    low = F.greatest(F.least(along("a1"), along("a2")), F.least(along("b1"), along("b2")))
    high = F.least(F.greatest(along("a1"), along("a2")), F.greatest(along("b1"), along("b2")))
    line = line.withColumns({"_s0": low, "_s1": high, "_off": off("a1"), "_gap": F.abs(off("a1") - off("b1"))})
    runs = line.where((c("_gap") < 1e-6) & (c("_s0") <= c("_s1") + 1e-6)).select(
        "name_a", "name_b", "_s0", "_s1", "_ux", "_uy", "_off",
        F.round(c("_ux") * 1e9).alias("_ku"), F.round(c("_uy") * 1e9).alias("_kv"), F.round(c("_off") * 1000).alias("_ko"),
    ).dropDuplicates(["name_a", "name_b", "_ku", "_kv", "_ko", "_s0", "_s1"])
    # one carrier line of one pair of names: a few pieces
    carrier = Window.partitionBy("name_a", "name_b", "_ku", "_kv", "_ko").orderBy("_s0", "_s1")
    seen = F.max("_s1").over(carrier.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", F.when(c("_s0") <= seen + 1e-6, F.lit(0)).otherwise(F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(carrier.rowsBetween(Window.unboundedPreceding, 0)))
    middle = runs.groupBy("name_a", "name_b", "_ku", "_kv", "_ko", "_run").agg(
        ((F.min("_s0") + F.max("_s1")) / 2).alias("_s"), F.min("_ux").alias("_ux"), F.min("_uy").alias("_uy"), F.min("_off").alias("_off")
    )
    return middle.select("name_a", "name_b", (c("_s") * c("_ux") + c("_off") * c("_uy")).alias("x"), (c("_s") * c("_uy") - c("_off") * c("_ux")).alias("y"))


def _rounded(points: DataFrame) -> DataFrame:
    keyed = points.withColumns({"_qx": F.round(F.col("x") * 1000).cast("bigint"), "_qy": F.round(F.col("y") * 1000).cast("bigint")})
    best = keyed.groupBy("name_a", "name_b", "_qx", "_qy").agg(F.min(F.struct("x", "y")).alias("_p"))
    key = F.concat_ws("|", "name_a", "name_b", "_qx", "_qy")
    return best.select(key.alias("crossing_key"), "name_a", "name_b", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def line_crossings(pieces: DataFrame, *, name: str = "street") -> DataFrame:
    """Crossing points of every pair of differently named lines, names in order (JN9)."""
    return _meet(pieces, pieces, name, F.col("name_a") < F.col("name_b"))


def crossings_between(left: DataFrame, right: DataFrame, *, name: str = "street") -> DataFrame:
    """Crossing points of each named line of ``left`` with the union of ``right`` (JN10)."""
    one = right.withColumn(name, F.lit("*"))
    return _meet(left, one, name, F.lit(True)).drop("name_b", "crossing_key").withColumnRenamed("name_a", name)


def meeting_points(left: DataFrame, right: DataFrame, *, name: str = "street") -> DataFrame:
    """Where each line of ``left`` meets differently named lines of ``right``: ``name, x, y``."""
    met = _meet(left, right, name, F.col("name_a") != F.col("name_b"))
    return met.select(F.col("name_a").alias(name), "x", "y").distinct()


def endpoint_nodes(pieces: DataFrame, *, name: str = "street", grid: float = 1.0) -> DataFrame:
    """Ends of differently named pieces that fall on the same grid point (JN11)."""
    ends = pieces.select(name, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("_e"))
    ends = ends.select(name, F.bround(F.col("_e.x") / grid).cast("bigint").alias("gx"), F.bround(F.col("_e.y") / grid).cast("bigint").alias("gy")).distinct()
    nodes = ends.groupBy("gx", "gy").agg(F.array_sort(F.collect_set(name)).alias("streets"))
    return nodes.where(F.size("streets") >= 2)


def same_pair_gaps(crossings: DataFrame, limit: float = 60.0) -> DataFrame:
    """Distances between crossings of one pair of names, up to ``limit`` (AG31)."""
    left = crossings.select("crossing_key", "name_a", "name_b", "x", "y")
    right = as_pieces(left).drop("x", "y").withColumnRenamed("crossing_key", "other_key")
    near = within_distance(left, right, limit, by=["name_a", "name_b"])
    return near.where(F.col("crossing_key") < F.col("other_key")).select("name_a", "name_b", "dist")


def merge_radius(gaps: DataFrame) -> float:
    """20 m when no gap is wider; else the 99th percentile rounded up, kept in 25..30 m."""
    widest = gaps.agg(F.max("dist")).first()[0]
    if widest is not None and widest <= 20.0:
        return 20.0
    p99 = percentiles(gaps, "dist", [0.99]).first()[1] if widest is not None else 0.0
    return float(min(30.0, max(25.0, math.ceil(p99))))


def junction_nodes(crossings: DataFrame, *, radius: float, same_pair: float = 120.0) -> DataFrame:
    """Junctions: crossings merged within ``radius``, and within ``same_pair`` when the two
    names agree. ``node_id, x, y, streets, n_streets`` (GR3)."""
    # numbers in the order of the keys: the rounds below carry them in place of long strings
    crossings = cut(global_rank(crossings, [F.col("crossing_key")], "_id"))
    close = cluster_points(crossings, radius, point_id="_id", out="_near")
    pair = cluster_points(crossings, same_pair, point_id="_id", by=["name_a", "name_b"], out="_pair")
    both = cut(close.join(pair, "_id"))
    # both labels are crossings: linking them links the two clusterings
    comps = connected_components(both.select(F.col("_near").alias("a"), F.col("_pair").alias("b")).distinct())
    labelled = both.join(comps, both["_near"] == comps["vertex"], "left").select("_id", F.coalesce("component", "_near").alias("_node"))
    members = cut(crossings.join(labelled, "_id"))
    centre = members.groupBy("_node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    names = members.select("_node", F.explode(F.array("name_a", "name_b")).alias("name")).distinct()
    names = names.groupBy("_node").agg(F.array_sort(F.collect_set("name")).alias("streets"))
    nodes = centre.join(names, "_node").withColumn("n_streets", F.size("streets").cast("bigint"))
    return global_rank(nodes, [F.col("_node")], "node_id").drop("_node").select("node_id", "x", "y", "streets", "n_streets")
