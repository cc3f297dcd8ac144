"""Spatial joins on a square grid: nearest, within distance, polygon membership (JN1-JN5, JN14-JN17).

Every join is an equi join on (grouping columns, grid cell). The network side is registered
in all cells within ``reach`` of it, so each point is shuffled once, unreplicated, and sees
every candidate within ``reach``. The points side may be arbitrarily skewed: AQE splits a
hot cell, because the candidate reduction behind the join is a partial aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geometry import cell_of, cells_near, foot, squared_gap
from curbline.operators.scan import running_totals
from curbline.session import cut

GEOMETRY = ("x1", "y1", "x2", "y2")
# A cell with more registered pieces than this is divided until its parts are expected to hold fewer, at most 2 ** SPLITS
# times a side. Neither number decides how a point is answered, only how many candidates it looks at.
CROWD = 256
SPLITS = 6
# Copies of the few coarse cells at the top of the tree search, so that no key of a join holds all points.
SALTS = 64


def as_pieces(points: DataFrame) -> DataFrame:
    """Points as zero-length pieces."""
    return points.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")})


def _register(pieces: DataFrame, cell: float, reach: float) -> DataFrame:
    """One row per piece and cell within ``reach``."""
    spread = pieces.withColumn("_at", F.explode(cells_near(cell, reach)))
    return spread.withColumns({"_cx": F.col("_at.cx"), "_cy": F.col("_at.cy")}).drop("_at")


def _located(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({"_cx": cell_of("x", cell), "_cy": cell_of("y", cell)})


def _sections(pieces: DataFrame, cell: float, reach: float) -> DataFrame:
    """``_register`` with the section of the piece that each row stands for, as ``_x1, _y1, _x2, _y2``."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / cell)).cast("int")
    walked = pieces.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    ends = {f"_{c}{k}": F.col(f"{c}1") + d * (F.col("_i") + (k - 1)) / F.col("_n") for c, d in (("x", dx), ("y", dy)) for k in (1, 2)}
    walked = walked.withColumns(ends).drop("_n", "_i")

    def span(c: str) -> Column:
        a, b = F.col(f"_{c}1"), F.col(f"_{c}2")
        return F.explode(F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell)))

    return walked.withColumn("_cx", span("x")).withColumn("_cy", span("y"))


def _divided(sections: DataFrame, crowded: DataFrame, on: Sequence[str], cell: float) -> DataFrame:
    """Rows of crowded cells once per part of the cell that lies within one part's side of their section; others once."""
    rows = sections.join(crowded, list(on), "left").withColumn("_side", F.lit(cell) / F.expr("shiftleft(1, coalesce(_k, 0))"))
    steps = "greatest(1, ceil(greatest(abs(_x2 - _x1), abs(_y2 - _y1)) / _side))"

    def span(c: str, j: str) -> str:
        a, b = (f"(_{c}1 + (_{c}2 - _{c}1) * {at} / {steps})" for at in (j, f"({j} + 1)"))
        low, high = f"greatest(0, floor((least({a}, {b}) - _side - _c{c} * {cell}D) / _side))", f"least(shiftleft(1, _k) - 1, floor((greatest({a}, {b}) + _side - _c{c} * {cell}D) / _side))"
        return f"if({low} <= {high}, sequence({low}, {high}), array())"

    parts = f"flatten(flatten(transform(sequence(0, {steps} - 1), j -> transform({span('x', 'j')}, sx -> transform({span('y', 'j')}, sy -> struct(sx AS sx, sy AS sy))))))"
    parts = F.expr(f"if(_k IS NULL, array(struct(0L AS sx, 0L AS sy)), {parts})")
    out = rows.withColumn("_part", F.explode(F.array_distinct(parts))).withColumns({"_sx": F.col("_part.sx"), "_sy": F.col("_part.sy")})
    return out.drop("_part", "_k", "_side", "_x1", "_y1", "_x2", "_y2")


def _placed(points: DataFrame, crowded: DataFrame, on: Sequence[str], cell: float, reach: float) -> DataFrame:
    """Points with their cell, the part of it, and how far they see there (``_r2``, squared)."""
    side = F.lit(cell) / F.expr("shiftleft(1, _k)")

    def part(c: str) -> Column:
        inside = F.least(F.greatest(F.floor((F.col(c) - F.col(f"_c{c}") * cell) / side), F.lit(0)), F.expr("shiftleft(1, _k)") - 1)
        return F.coalesce(inside.cast("bigint"), F.lit(0))

    here = _located(points, cell).join(crowded, list(on), "left")
    seen = F.coalesce(F.least(side, F.lit(reach)), F.lit(reach))
    return here.withColumns({"_sx": part("x"), "_sy": part("y"), "_r2": seen * seen}).drop("_k")


def nearest(
    points: DataFrame,
    pieces: DataFrame,
    *,
    point_id: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    carry: Sequence[str] = (),
    cell: float = 125.0,
    within: float | None = None,
    differ: tuple[str, str] | None = None,
    dense: int = CROWD,
) -> DataFrame:
    """Nearest piece per point: ``point_id, *key, *carry, t, dist``; exact for any distance.

    Ties go to the smallest ``key``. ``by``: columns that must be equal on both sides.
    ``within``: keep matches up to this distance only. ``differ``: a (point column, piece
    column) pair that must not be equal. Points without any match are not in the result.

    The grid follows the density: cells with more than ``dense`` pieces are divided, as rows of the same join, and a
    point in a part of a cell sees as far as that part is wide. Points that see nothing that far go through a search from
    coarse to fine cells. Both ways are taken at every size, so the result is the same however far or crowded a point is.
    """
    by, key, carry = list(by), list(key), list(carry)
    extra = [differ[0]] if differ and differ[0] not in [point_id, *by] else []
    pts = points.select(point_id, "x", "y", *by, *extra).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    need = list(dict.fromkeys([*key, *carry, *([differ[1]] if differ else [])]))
    net = pieces.select(*by, *GEOMETRY, *[c for c in need if c not in by])
    reach = cell if within is None else within
    cell = float(max(cell, reach / 4))
    on = [*by, "_cx", "_cy"]
    sections = _sections(net, cell, reach)
    filled = sections.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense)
    halvings = F.least(F.ceil(F.log2(F.col("_n") / max(dense, 1)) / 2), F.lit(SPLITS)).cast("int")
    crowded = cut(filled.select(*on, halvings.alias("_k")))
    within_reach = [*on, "_sx", "_sy"]
    hits = _score(_placed(pts, crowded, on, cell, reach), _divided(sections, crowded, on, cell), within_reach, differ).where(F.col("_d2") <= F.col("_r2"))
    best = cut(_best(hits, point_id, within_reach, key, carry))
    missing = pts.join(best.select(point_id), point_id, "left_anti")
    if within is not None:  # elsewhere a point without a match has none
        missing = _located(missing, cell).join(crowded.select(*on), on, "left_semi")
    missing = cut(missing.select(*pts.columns))
    if missing.isEmpty():
        return best
    deepest = crowded.agg(F.coalesce(F.max("_k"), F.lit(0))).first()[0]
    return best.unionByName(_tree_search(missing, net, point_id, key, by, carry, cell / 2 ** min(deepest, 4), differ, within))


def _score(points: DataFrame, pieces: DataFrame, on: Sequence[str], differ) -> DataFrame:
    pieces = pieces.withColumnsRenamed({c: f"_p_{c}" for c in pieces.columns if c not in on})
    joined = points.join(pieces, list(on))
    if differ:
        other = differ[1] if differ[1] in on else f"_p_{differ[1]}"
        joined = joined.where(F.col(differ[0]) != F.col(other))
    geometry = ("_p_x1", "_p_y1", "_p_x2", "_p_y2")
    return joined.withColumn("_t", foot("x", "y", *geometry)).withColumn("_d2", squared_gap("_t", "x", "y", *geometry))


def _best(hits: DataFrame, point_id: str, group: Sequence[str], key, carry) -> DataFrame:
    def payload(c):
        return F.col(c if c in group else f"_p_{c}").alias(c)

    order = F.struct(F.col("_d2"), *[payload(k) for k in key], F.col("_t"), *[payload(c) for c in carry if c not in key])
    # grouping by the join key first lets the aggregate reuse the join's partitioning
    best = hits.groupBy(*dict.fromkeys([*group, point_id])).agg(F.min(order).alias("_b"))
    fields = [F.col(f"_b.{c}").alias(c) for c in dict.fromkeys([*key, *carry]) if c != point_id]
    return best.select(point_id, *fields, F.col("_b._t").alias("t"), F.sqrt("_b._d2").alias("dist"))


def _tree_search(points, pieces, point_id, key, by, carry, cell, differ, within=None) -> DataFrame:
    """Exact nearest search from coarse to fine cells, for points the first pass left over.

    A level holds its occupied cells with one point on a piece of each cell. Per point and
    level, cells farther than the best of those representatives cannot win and are dropped;
    the rest is refined. Few cells per point survive, however far the network is.
    """
    tag = [differ[1]] if differ else []
    leaves = _sections(pieces, cell, 0.0).drop("_x1", "_y1", "_x2", "_y2")
    # representatives of two different tags per cell, so that one always differs
    anchor = F.struct(*[F.col(c).alias("_tag") for c in tag], F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    ends = [F.min(anchor).alias("_r0")] + ([F.max(anchor).alias("_r1")] if differ else [])
    level0 = cut(leaves.groupBy(*by, "_cx", "_cy").agg(*ends))
    box = level0.agg(F.min("_cx"), F.max("_cx"), F.min("_cy"), F.max("_cy"), F.count(F.lit(1))).first()
    if box[4] == 0:
        return points.sparkSession.createDataFrame([], _best_schema(points, pieces, point_id, key, carry))
    x0, y0, wide = box[0], box[2], max(box[1] - box[0], box[3] - box[2]) + 1
    depth = max(0, math.ceil(math.log(wide, 4)))
    cells = level0.withColumns({"_cx": F.col("_cx") - x0, "_cy": F.col("_cy") - y0})
    reps = [e for e in ("_r0", "_r1") if e in level0.columns]

    def bound(row_rep: str) -> Column:
        geometry = tuple(f"{row_rep}.{c}" for c in GEOMETRY)
        d2 = squared_gap(foot("x", "y", *geometry), "x", "y", *geometry)
        return F.when(F.col(differ[0]) != F.col(f"{row_rep}._tag"), d2) if differ else d2

    salt = F.pmod(F.xxhash64(point_id), F.lit(SALTS))
    found = points.withColumns({"_cx": F.lit(0).cast("bigint"), "_cy": F.lit(0).cast("bigint"), "_u": F.lit(float("inf"))})
    for level in range(depth - 1, -1, -1):
        side = cell * 4**level
        up = cells.withColumns({"_cx": F.floor(F.col("_cx") / 4**level), "_cy": F.floor(F.col("_cy") / 4**level)})
        up = up.groupBy(*by, "_cx", "_cy").agg(F.min("_r0").alias("_r0"), *([F.max("_r1").alias("_r1")] if differ else []))
        up = up.withColumns({"_kx": F.col("_cx"), "_ky": F.col("_cy"), "_cx": F.floor(F.col("_cx") / 4), "_cy": F.floor(F.col("_cy") / 4)})
        on = [*by, "_cx", "_cy"]
        if depth - level <= 2:  # at most 16, then 256 cells for each value of ``by``: copied, so that points spread over the copies
            up = up.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            found, on = found.withColumn("_salt", salt), [*on, "_salt"]
        step = found.join(up, on)
        low_x, low_y = F.col("_kx") * side + x0 * cell, F.col("_ky") * side + y0 * cell
        gap_x = F.greatest(low_x - F.col("x"), F.col("x") - (low_x + side), F.lit(0.0))
        gap_y = F.greatest(low_y - F.col("y"), F.col("y") - (low_y + side), F.lit(0.0))
        step = step.withColumns({"_low": gap_x * gap_x + gap_y * gap_y, "_up": F.least(F.col("_u"), *[bound(r) for r in reps])})
        # the cells of one point are few, so this window never holds a large group
        step = step.withColumn("_best", F.min("_up").over(Window.partitionBy(point_id)))
        kept = step.where(F.col("_low") <= F.col("_best") * (1 + 1e-9) + 1e-6)
        found = kept.select(*points.columns, F.col("_kx").alias("_cx"), F.col("_ky").alias("_cy"), F.col("_best").alias("_u"))
        if level % 3 == 2:
            found = cut(found)
    leaves = leaves.withColumns({"_cx": F.col("_cx") - x0, "_cy": F.col("_cy") - y0})
    hits = _score(found.drop("_u"), leaves, [*by, "_cx", "_cy"], differ)
    if within is not None:
        hits = hits.where(F.col("_d2") <= within * within)  # the same test as in the first pass
    return _best(hits, point_id, by, key, carry)


def _best_schema(points, pieces, point_id, key, carry):
    from pyspark.sql import types as T

    of = {f.name: f.dataType for f in (*points.schema.fields, *pieces.schema.fields)}
    names = [point_id, *[c for c in dict.fromkeys([*key, *carry]) if c != point_id]]
    fields = [T.StructField(n, of[n]) for n in names]
    return T.StructType([*fields, T.StructField("t", T.DoubleType()), T.StructField("dist", T.DoubleType())])


def nearest_point(a: DataFrame, b: DataFrame, *, point_id: str, key: Sequence[str], **options) -> DataFrame:
    return nearest(a, as_pieces(b), point_id=point_id, key=key, **options)


def within_distance(
    points: DataFrame, pieces: DataFrame, r: float, *, by: Sequence[str] = (), cell: float | None = None
) -> DataFrame:
    """All (point, piece) pairs at most ``r`` apart, each once, with ``t`` and ``dist``."""
    by = list(by)
    side = cell or max(r, 50.0)
    taken = set(points.columns) - set(by)
    clash = [c for c in pieces.columns if c in taken and c not in GEOMETRY]
    if clash:
        raise ValueError(f"rename columns present on both sides: {clash}")
    on = [*by, "_cx", "_cy"]
    pairs = _score(_located(points, side), _register(pieces, side, r), on, None).where(F.col("_d2") <= r * r)
    back = {f"_p_{c}": c for c in pieces.columns if c not in on}
    return (
        pairs.withColumnsRenamed(back).withColumnsRenamed({"_t": "t"}).withColumn("dist", F.sqrt("_d2")).drop("_cx", "_cy", "_d2")
    )


def near_any(points: DataFrame, pieces: DataFrame, r: float, *, point_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Ids of points with at least one piece within ``r`` (each once)."""
    slim = pieces.select(*by, *GEOMETRY)
    return within_distance(points.select(point_id, "x", "y", *by), slim, r, by=by).select(point_id).distinct()


# Cells of polygon covers are moved by this much, so that no border of a cell runs along round coordinates.
_SHIFT = 0.3819660113
_RIM = 0.01


def _crossed_at(y: Column) -> Column:
    """Where an edge crosses the height ``y``: one formula for all looks, so that a point or corner on an edge has one side."""
    return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))


def polygon_cover(edges: DataFrame, *, polygon: str = "polygon_id", cell: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """The cells that edges touch, and those wholly inside.

    First table: ``polygon, _cx, _cy, x1, y1, x2, y2, _odd``, an edge as given per row in each cell it touches, ``_odd`` where
    the cell's lower left corner is inside, ``_over`` where the edge meets the line of the cell's left side above that corner.
    Second: ``_cx, _cy``. Rings must be closed; holes and parts go by even and odd.
    A corner is inside if the ring crosses the line through it an odd number of times before it: corners and crossings
    are counted in one running total, as every line is crossed an even number of times as a whole.
    """
    moved = edges.select(polygon, *[(F.col(c) - _SHIFT).alias(c) for c in GEOMETRY], *[F.col(c).alias(f"_as_{c}") for c in GEOMETRY])
    # with a margin, so that rounding cannot put a point on an edge into a cell that no edge touches
    bottom, rises = F.col("_cy") * cell, (F.col("x2") > F.col("x1")) == (F.col("y2") > F.col("y1"))
    over = F.when((F.col("y1") > bottom) != (F.col("y2") > bottom), rises == (_crossed_at(bottom) <= F.col("_cx") * cell)).otherwise(F.col("y1") > bottom)
    touched = _register(moved, cell, _RIM).withColumn("_over", over)
    touched = cut(touched.drop(*GEOMETRY).withColumnsRenamed({f"_as_{c}": c for c in GEOMETRY}))
    row = Window.partitionBy(polygon, "_cy").orderBy("_cx")  # the border cells of one polygon in one row
    border = cut(touched.select(polygon, "_cy", "_cx").distinct().withColumn("_next", F.lead("_cx").over(row)))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossed = moved.withColumns({"_from": F.ceil(low / cell), "_upto": F.ceil(high / cell) - 1}).where("_from <= _upto")
    crossed = crossed.withColumn("_cy", F.explode(F.sequence("_from", "_upto")))
    events = crossed.select(polygon, "_cy", _crossed_at(F.col("_cy") * cell).alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_cx"), F.lit(1).cast("bigint").alias("_n"), F.monotonically_increasing_id().alias("_tie"))
    asked = border.select(polygon, "_cy", "_cx").unionByName(border.where(F.col("_next") > F.col("_cx") + 1).select(polygon, "_cy", (F.col("_cx") + 1).alias("_cx")))
    looks = asked.distinct().select(polygon, "_cy", (F.col("_cx") * cell).alias("_x"), F.lit(1).alias("_kind"), "_cx", F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_tie"))
    order = [F.col(c) for c in (polygon, "_cy", "_x", "_kind", "_tie", "_cx")]
    corners = running_totals(events.unionByName(looks), order, {"_seen": F.col("_n")}).where(F.col("_kind") == 1)
    corners = cut(corners.select(polygon, "_cy", "_cx", (F.col("_seen") % 2 == 1).alias("_odd")))
    gaps = border.where(F.col("_next") > F.col("_cx") + 1).select(polygon, "_cy", (F.col("_cx") + 1).alias("_cx"), "_next").join(corners.where("_odd"), [polygon, "_cy", "_cx"])
    inside = gaps.select(F.explode(F.sequence("_cx", F.col("_next") - 1)).alias("_cx"), "_cy").distinct()
    return touched.join(corners, [polygon, "_cy", "_cx"]), inside


def points_in_polygon(points: DataFrame, edges: DataFrame, *, point_id: str, polygon: str = "polygon_id", band: float = 500.0) -> DataFrame:
    """Ids of points inside the union of polygons (JN1), over cells of side ``band``.

    Points in cells wholly inside are settled by an equi join on the cell, those in cells without an edge outside are
    never looked at again. Only points in cells that an edge touches meet edges, and only those of their own cell: the way
    from the cell's corner along its left side, then across to the point, changes sides at every edge it crosses.
    """
    touched, inside = polygon_cover(edges, polygon=polygon, cell=band)
    located = points.select(point_id, "x", "y", cell_of(F.col("x") - _SHIFT, band).alias("_cx"), cell_of(F.col("y") - _SHIFT, band).alias("_cy"))
    whole = located.join(inside, ["_cx", "_cy"], "left_semi").select(point_id)
    met = located.join(touched, ["_cx", "_cy"])
    left, y = F.col("_cx") * band + _SHIFT, F.col("y")
    up, across = (F.col("x1") > left) != (F.col("x2") > left), (F.col("y1") > y) != (F.col("y2") > y)
    rises = (F.col("x2") > F.col("x1")) == (F.col("y2") > F.col("y1"))
    # the plain ray test on the coordinates as given: a point on an edge falls to the same side as there
    beyond = _crossed_at(y) > left
    under = F.when(across, rises == beyond).otherwise(F.col("y1") <= y)
    climbs = F.coalesce((up & F.col("_over") & under).cast("int"), F.lit(0))
    passes = F.coalesce((across & beyond & (_crossed_at(y) <= F.col("x"))).cast("int"), F.lit(0))
    sides = met.groupBy("_cx", "_cy", point_id, polygon).agg(((F.sum(climbs + passes) + F.max(F.col("_odd").cast("int"))) % 2).alias("_in"))
    return whole.union(sides.where(F.col("_in") == 1).select(point_id)).distinct()


def nearest_two_roads(
    points: DataFrame, pieces: DataFrame, *, point_id: str, road: str, key: Sequence[str], carry: Sequence[str] = (),
    gap: float = 15.0, far: float = 35.0, cell: float = 125.0,
) -> DataFrame:
    """Best road, the next different road, and whether the choice is doubtful or far off (JN16)."""
    carry = list(dict.fromkeys([road, *carry]))
    first = nearest(points, pieces, point_id=point_id, key=key, carry=carry, cell=cell)
    start = points.select(point_id, "x", "y").join(first.select(point_id, F.col(road).alias("_road")), point_id)
    second = nearest(start, pieces, point_id=point_id, key=key, carry=[road], cell=cell, differ=("_road", road))
    second = second.select(point_id, F.col(road).alias("next_road"), F.col("dist").alias("next_dist"))
    both = first.join(second, point_id, "left")
    doubtful = F.coalesce(F.col("next_dist") - F.col("dist") <= gap, F.lit(False))
    return both.withColumn("is_ambiguous", doubtful).withColumn("is_far", ~F.col("is_ambiguous") & (F.col("dist") > far))


def transfer_by_location(old: DataFrame, new: DataFrame, *, old_id: str, new_id: str, value: str, r: float = 25.0) -> DataFrame:
    """Give each new point the value of its nearest old point if that is within ``r`` (JN14)."""
    return nearest_point(new, old, point_id=new_id, key=[old_id], carry=[value], within=r).select(new_id, value)
