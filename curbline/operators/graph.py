"""Connected components and single-linkage clusters (GR1, GR2)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.session import cut

MAX_ROUNDS = 60
# Distinct places in one small cell beyond which pairs are first settled on a finer grid.
CROWDED = 1_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, component`` (smallest vertex) for every vertex with an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a
    minimum per vertex plus an equi join, never a list of neighbours, so a vertex with very
    many edges is pre-aggregated and its join partition may be split.
    """
    current = cut(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(F.col("v") != F.col("m")).distinct()
    )
    if current.isEmpty():
        return current.select(F.col("v").alias("vertex"), F.col("m").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("_m")).withColumn("_m", F.least("v", "_m"))
        large = both.where(F.col("m") > F.col("v")).join(least, "v").select(F.col("m").alias("v"), F.col("_m").alias("m")).distinct()
        large = cut(large)
        lowest = large.groupBy("v").agg(F.min("m").alias("_m"))
        rest = large.join(lowest, "v").where(F.col("m") != F.col("_m")).select(F.col("m").alias("v"), F.col("_m").alias("m"))
        small = cut(rest.unionByName(lowest.select("v", F.col("_m").alias("m"))).distinct())
        # both tables hold distinct rows: they are equal if one holds the other and is no longer
        settled = small.count() == current.count() and small.join(current, ["v", "m"], "left_anti").isEmpty()
        current = small
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("m").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return current.select(F.col("v").alias("vertex"), F.col("m").alias("component")).unionByName(roots)


def cluster_points(points: DataFrame, r: float, *, point_id: str, by: Sequence[str] = (), out: str = "cluster") -> DataFrame:
    """Single-linkage clusters: ``point_id, out`` with the smallest member id as label.

    Points in one cell of side r/sqrt(2) are linked by construction, so the graph is over
    occupied cells, with at most 20 neighbours each, and not over pairs of points.
    """
    by = list(by)
    side = r / math.sqrt(2.0) * (1 - 1e-9)
    where = {"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)}
    pts = cut(points.select(point_id, *by, "x", "y").withColumns(where))
    cell = [*by, "_cx", "_cy"]
    places = pts.select(*cell, "x", "y").distinct()
    cells = cut(pts.groupBy(*cell).agg(F.min(point_id).alias("_v")))
    links = _cell_links(cut(places), r, side, by)
    ends = links
    for end, name in (("a", "_v"), ("b", "_w")):
        one = cells.select(*by, F.col("_cx").alias(f"_{end}x"), F.col("_cy").alias(f"_{end}y"), F.col("_v").alias(f"_{end}v"))
        ends = ends.join(one, [*by, f"_{end}x", f"_{end}y"])
    comps = connected_components(ends.select(F.col("_av").alias("a"), F.col("_bv").alias("b")))
    named = cells.join(comps, cells["_v"] == comps["vertex"], "left").select(*cell, F.coalesce("component", "_v").alias(out))
    return pts.join(named, cell).select(point_id, out)


def _cell_links(places: DataFrame, r: float, side: float, by: list[str]) -> DataFrame:
    """Pairs of different cells holding two places at most ``r`` apart."""
    most = places.groupBy(*by, "_cx", "_cy").count().agg(F.max("count")).first()[0] or 0
    offsets = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    link = [*by, "_ax", "_ay", "_bx", "_by"]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.withColumnsRenamed({c: f"_a_{c}" for c in left.columns if c not in by and c not in ("_cx", "_cy")})
        b = right.withColumnsRenamed({c: f"_b_{c}" for c in right.columns if c not in by and c not in ("_cx", "_cy")})
        a = a.withColumnsRenamed({"_cx": "_ax", "_cy": "_ay"}).withColumn(
            "_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
        )
        a = a.withColumns({"_bx": F.col("_ax") + F.col("_o.i"), "_by": F.col("_ay") + F.col("_o.j")}).drop("_o")
        return a.join(b.withColumnsRenamed({"_cx": "_bx", "_cy": "_by"}), [*by, "_bx", "_by"])

    def close(pairs: DataFrame) -> DataFrame:
        gx, gy = F.col("_a_x") - F.col("_b_x"), F.col("_a_y") - F.col("_b_y")
        return pairs.where(gx * gx + gy * gy <= r * r).select(*link).distinct()

    if most <= CROWDED:
        return close(meet(places, places))
    # Crowded: settle cell pairs on a grid 8 times finer (at most 64 squares per cell) and
    # compare single places only where squares neither surely link nor surely do not.
    fine = side / 8
    spots = places.withColumns({"fx": F.floor(F.col("x") / fine), "fy": F.floor(F.col("y") / fine)})
    squares = spots.select(*by, "_cx", "_cy", "fx", "fy").distinct()
    pairs = meet(squares, squares)
    gx, gy = F.abs(F.col("_a_fx") - F.col("_b_fx")), F.abs(F.col("_a_fy") - F.col("_b_fy"))
    far = ((gx + 1) * (gx + 1) + (gy + 1) * (gy + 1)) * fine * fine
    nx, ny = F.greatest(gx - 1, F.lit(0)), F.greatest(gy - 1, F.lit(0))
    near = (nx * nx + ny * ny) * fine * fine
    pairs = cut(pairs.withColumns({"_far": far, "_near": near}).where(F.col("_near") <= r * r))
    sure = pairs.where(F.col("_far") <= r * r).select(*link).distinct()
    open_pairs = pairs.where(F.col("_far") > r * r).join(sure, link, "left_anti")
    left = spots.select(*by, F.col("fx").alias("_a_fx"), F.col("fy").alias("_a_fy"), F.col("x").alias("_a_x"), F.col("y").alias("_a_y"))
    right = spots.select(*by, F.col("fx").alias("_b_fx"), F.col("fy").alias("_b_fy"), F.col("x").alias("_b_x"), F.col("y").alias("_b_y"))
    checked = close(open_pairs.join(left, [*by, "_a_fx", "_a_fy"]).join(right, [*by, "_b_fx", "_b_fy"]))
    return sure.unionByName(checked)
