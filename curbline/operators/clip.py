"""Lines cut at the border of an area, and measures of the part inside (AG33)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions.geometry import cells_near
from curbline.operators.chains import merge_lines, reference_lines
from curbline.operators.corridors import crossing_density
from curbline.operators.scan import global_rank
from curbline.operators.spatial import GEOMETRY, points_in_polygon
from curbline.session import cut

_SAFE = 0.01  # registration margin, so that rounding cannot lose the cell of a crossing


def clip_lines(pieces: DataFrame, edges: DataFrame, *, by: Sequence[str] = (), seg_id: str = "seg_id", polygon: str = "polygon_id", cell: float = 500.0) -> DataFrame:
    """The stretches of pieces inside the union of polygons: ``*by, seg_id, part, t0, t1, x1, y1, x2, y2``.

    A piece is cut where it meets an edge (found by an equi join on cells); between two cuts it lies on one side, so the
    middle of each stretch decides. Runs along an edge count as inside or outside by their middle.
    """
    own = pieces.select(*by, seg_id, *GEOMETRY)
    near = own.select(seg_id, *GEOMETRY, F.explode(cells_near(cell, _SAFE)).alias("_at")).select(seg_id, *GEOMETRY, "_at.cx", "_at.cy")
    rim = edges.select(*GEOMETRY, F.explode(cells_near(cell, _SAFE)).alias("_at")).select(*[F.col(c).alias(f"e{c}") for c in GEOMETRY], "_at.cx", "_at.cy")
    met = near.join(rim, ["cx", "cy"])
    c = F.col
    dx, dy, ex, ey = c("x2") - c("x1"), c("y2") - c("y1"), c("ex2") - c("ex1"), c("ey2") - c("ey1")
    wx, wy = c("ex1") - c("x1"), c("ey1") - c("y1")
    den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    met = met.select(seg_id, ((wx * ey - wy * ex) / den).alias("_t"), ((wx * dy - wy * dx) / den).alias("_u"))
    places = met.where((c("_t") > 0) & (c("_t") < 1) & (c("_u") >= -1e-9) & (c("_u") <= 1 + 1e-9)).groupBy(seg_id).agg(F.collect_set("_t").alias("_ts"))
    cuts = own.join(places, seg_id, "left").withColumn("_ts", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("_ts", F.array().cast("array<double>")))))
    spans = F.zip_with(F.slice("_ts", F.lit(1), F.size("_ts") - 1), F.slice("_ts", F.lit(2), F.size("_ts") - 1), lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))
    parts = cuts.select(*own.columns, F.posexplode(spans).alias("part", "_s")).select(*own.columns, "part", "_s.t0", "_s.t1").where(c("t1") - c("t0") > 1e-9)
    parts = cut(parts.withColumn("_pid", F.concat_ws("|", seg_id, "part")))
    middle = (c("t0") + c("t1")) / 2
    inside = points_in_polygon(parts.select("_pid", (c("x1") + middle * dx).alias("x"), (c("y1") + middle * dy).alias("y")), edges, point_id="_pid", polygon=polygon, band=cell)
    kept = parts.join(inside, "_pid", "left_semi")
    at = {f"{k}{i}": c(f"{k}1") + c(t) * d for k, d in (("x", dx), ("y", dy)) for i, t in ((1, "t0"), (2, "t1"))}
    return kept.select(*by, seg_id, "part", "t0", "t1", *[v.alias(k) for k, v in at.items()])


def density_inside(points: DataFrame, pieces: DataFrame, edges: DataFrame, *, point_id: str, street: str = "street", **options) -> DataFrame:
    """Crossing density of each road's longest stretch inside the area, from points inside only."""
    inside = points.join(points_in_polygon(points, edges, point_id=point_id), point_id, "left_semi")
    parts = clip_lines(pieces, edges, by=[street])
    numbered = global_rank(parts, [F.col("seg_id"), F.col("part")], "_id").drop("seg_id").withColumnRenamed("_id", "seg_id")
    chains = cut(merge_lines(numbered.select(street, "seg_id", *GEOMETRY), by=[street]))
    lines = cut(reference_lines(chains, by=[street]))
    return crossing_density(inside, chains.join(lines.select("chain_id"), "chain_id", "left_semi"), lines, point_id=point_id, **options)
