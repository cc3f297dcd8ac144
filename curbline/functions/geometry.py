"""Closed-form plane geometry of points and straight pieces as ``Column`` expressions.

A line is the set of its straight pieces (x1, y1, x2, y2), all in metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRES_PER_MILE = 1609.344
METRES_PER_FOOT = 0.3048


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def piece_length(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def foot(px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Position 0..1 on the piece of its point nearest to (px, py)."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    along = (col(px) - col(x1)) * dx + (col(py) - col(y1)) * dy
    share = F.coalesce(along / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def squared_gap(t, px="x", py="y", x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """Squared distance from (px, py) to the point at share ``t`` of the piece."""
    gx = col(px) - (col(x1) + col(t) * (col(x2) - col(x1)))
    gy = col(py) - (col(y1) + col(t) * (col(y2) - col(y1)))
    return gx * gx + gy * gy


def decimetres(metres) -> Column:
    """Metres to whole tenths; halves (give or take rounding noise) go up."""
    return F.floor(col(metres) * 10.0 + 0.500001).cast("bigint")


def cells_near(cell: float, reach: float, x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """All grid cells that may lie within ``reach`` of the piece, each once.

    Long pieces are walked in cell-sized steps, so the count grows with length, not area.
    """
    x1, y1, x2, y2 = col(x1), col(y1), col(x2), col(y2)
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / cell)).cast("int")

    def around(i):
        ax, ay = x1 + (x2 - x1) * i / steps, y1 + (y2 - y1) * i / steps
        bx, by = x1 + (x2 - x1) * (i + 1) / steps, y1 + (y2 - y1) * (i + 1) / steps
        columns = F.sequence(F.floor((F.least(ax, bx) - reach) / cell), F.floor((F.greatest(ax, bx) + reach) / cell))
        rows = F.sequence(F.floor((F.least(ay, by) - reach) / cell), F.floor((F.greatest(ay, by) + reach) / cell))
        return F.flatten(F.transform(columns, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), steps - 1), around)))


def cell_of(value, cell: float) -> Column:
    return F.floor(col(value) / cell)


def with_capsule_interval(df: DataFrame, r: float, t0: str, t1: str, *, keep_misses: bool = False) -> DataFrame:
    """``df`` plus the shares [t0, t1] of piece a-b within ``r`` of piece p-q.

    Rows without any are dropped, or kept with nulls (``keep_misses``).
    The r-neighbourhood of p-q is convex (a band closed by two discs), so a straight piece
    meets it in one interval: the hull of its intervals with the band and with both discs.
    Columns: ax, ay, bx, by and px, py, qx, qy. Computed in steps, so that no term repeats.
    """
    c = F.col
    kept = df.columns
    step = df.withColumns(
        {"_dx": c("bx") - c("ax"), "_dy": c("by") - c("ay"), "_ex": c("qx") - c("px"), "_ey": c("qy") - c("py"), "_wx": c("ax") - c("px"), "_wy": c("ay") - c("py"), "_vx": c("ax") - c("qx"), "_vy": c("ay") - c("qy")}
    )
    dot = lambda a, b: c(f"_{a}x") * c(f"_{b}x") + c(f"_{a}y") * c(f"_{b}y")
    cross = lambda a, b: c(f"_{a}x") * c(f"_{b}y") - c(f"_{a}y") * c(f"_{b}x")
    step = step.withColumns({"_dd": dot("d", "d"), "_ee": dot("e", "e"), "_hp": dot("w", "d"), "_hq": dot("v", "d"), "_bs": dot("w", "e"), "_ds": dot("d", "e"), "_bc": cross("w", "e"), "_dc": cross("d", "e"), "_ww": dot("w", "w"), "_vv": dot("v", "v")})
    step = step.withColumn("_dd", F.nullif("_dd", F.lit(0.0))).withColumns(
        {"_rp": c("_hp") * c("_hp") - c("_dd") * (c("_ww") - r * r), "_rq": c("_hq") * c("_hq") - c("_dd") * (c("_vv") - r * r), "_wide": r * F.sqrt("_ee")}
    )

    def linear(base, slope, low, high):
        # base + t * slope within [low, high]; a flat line is inside everywhere or nowhere
        one, two = (low - c(base)) / F.nullif(c(slope), F.lit(0.0)), (high - c(base)) / F.nullif(c(slope), F.lit(0.0))
        inside = (c(base) >= low) & (c(base) <= high)
        first = F.when(c(slope) != 0, F.least(one, two)).when(inside, F.lit(-1e18)).otherwise(F.lit(1e18))
        last = F.when(c(slope) != 0, F.greatest(one, two)).when(inside, F.lit(1e18)).otherwise(F.lit(-1e18))
        return first, last

    s0, s1 = linear("_bs", "_ds", F.lit(0.0), c("_ee"))
    w0, w1 = linear("_bc", "_dc", -c("_wide"), c("_wide"))
    disc = lambda h, root, sign: F.when(c(root) >= 0, (-c(h) + sign * F.sqrt(root)) / c("_dd"))
    step = step.withColumns({"_lo": F.greatest(s0, w0), "_hi": F.least(s1, w1), "_p0": disc("_hp", "_rp", -1), "_p1": disc("_hp", "_rp", 1), "_q0": disc("_hq", "_rq", -1), "_q1": disc("_hq", "_rq", 1)})
    band = (c("_ee") > 0) & (c("_lo") <= c("_hi"))
    step = step.withColumns({"_c0": F.least(F.when(band, c("_lo")), "_p0", "_q0"), "_c1": F.greatest(F.when(band, c("_hi")), "_p1", "_q1")})
    # greatest and least skip nulls: no hit must stay null
    hit = c("_c0").isNotNull() & (F.greatest("_c0", F.lit(0.0)) <= F.least("_c1", F.lit(1.0)))
    found = F.struct(F.greatest("_c0", F.lit(0.0)).alias("t0"), F.least("_c1", F.lit(1.0)).alias("t1"))
    # a generator, not a filter: Catalyst would push the filter, all terms spelled out, to the join
    miss = F.array(F.lit(None).cast("struct<t0:double,t1:double>")) if keep_misses else F.array().cast("array<struct<t0:double,t1:double>>")
    out = step.select(*kept, F.explode(F.when(hit, F.array(found)).otherwise(miss)).alias("_iv"))
    return out.select(*kept, F.col("_iv.t0").alias(t0), F.col("_iv.t1").alias(t1))
