"""Shares of a line that run beside other lines (JN6-JN8), without polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geometry import cell_of, cells_near, piece_length, with_capsule_interval

STEP = 100.0


def _pairs(streets: DataFrame, routes: DataFrame, seg_id: str, r: float, by: Sequence[str], *, carry: Sequence[str] = ()) -> DataFrame:
    """Street chunks with the route pieces near them and the covered interval of the chunk.

    Streets are cut into chunks of at most ``STEP`` metres, each living in the one cell of
    its middle; routes are registered in every cell from which such a chunk could reach them.
    A chunk bounds the interval union that follows, however long its street piece is.
    ``carry``: columns of both sides to keep, as ``s_<name>`` and ``r_<name>``.
    """
    by, carry = list(by), list(carry)
    streets = streets.withColumns({f"s_{c}": F.col(c) for c in carry})
    routes = routes.withColumns({f"r_{c}": F.col(c) for c in carry})
    mine, theirs = [f"s_{c}" for c in carry], [f"r_{c}" for c in carry]
    parts = F.greatest(F.lit(1), F.ceil(piece_length() / STEP)).cast("int")
    cut_up = streets.select(seg_id, *by, *mine, "x1", "y1", "x2", "y2", parts.alias("_n")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    )
    def at(a, b, i):
        return F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")

    chunks = cut_up.select(
        seg_id, *by, *mine, "_i", "x1", "y1", "x2", "y2",
        at("x1", "x2", F.col("_i")).alias("ax"), at("y1", "y2", F.col("_i")).alias("ay"),
        at("x1", "x2", F.col("_i") + 1).alias("bx"), at("y1", "y2", F.col("_i") + 1).alias("by"),
    )
    middle = {"_cx": cell_of((F.col("ax") + F.col("bx")) / 2, STEP), "_cy": cell_of((F.col("ay") + F.col("by")) / 2, STEP)}
    chunks = chunks.withColumns(middle)
    beside = routes.select(*by, *theirs, F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("x2").alias("qx"), F.col("y2").alias("qy")).distinct()
    beside = beside.withColumn("_at", F.explode(cells_near(STEP, r + STEP / 2, "px", "py", "qx", "qy")))
    beside = beside.withColumns({"_cx": F.col("_at.cx"), "_cy": F.col("_at.cy")}).drop("_at")
    return with_capsule_interval(chunks.join(beside, [*by, "_cx", "_cy"]), r, "_t0", "_t1")


def _gain(t0: str, t1: str, seg_id: str, ok: Column | None = None) -> Column:
    """Metres this interval adds to the union of the earlier ones of its chunk."""
    start, stop = (F.col(t0), F.col(t1)) if ok is None else (F.when(ok, F.col(t0)), F.when(ok, F.col(t1)))
    chunk = Window.partitionBy(seg_id, "x1", "y1", "x2", "y2", "_i").orderBy(t0, t1)
    earlier = F.max(stop).over(chunk.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.greatest(F.lit(0.0), stop - F.greatest(start, F.coalesce(earlier, F.lit(0.0)))), F.lit(0.0)) * piece_length("ax", "ay", "bx", "by")


def _share(covered: str, whole: str) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.col(covered) / F.nullif(F.col(whole), F.lit(0.0)), F.lit(0.0)))


def buffer_overlap(streets: DataFrame, routes: DataFrame, r: float, *, seg_id: str = "seg_id", by: Sequence[str] = (), out: str = "overlap") -> DataFrame:
    """Per street segment with any route in reach: share of its length within ``r`` of the routes.

    With ``by`` (JN7) only routes with equal columns count. Segments without a route in
    reach are absent; join left and fill 0.
    """
    met = _pairs(streets, routes, seg_id, r, by)
    covered = met.withColumn("_gain", _gain("_t0", "_t1", seg_id)).groupBy(seg_id).agg(F.sum("_gain").alias("_covered"))
    whole = streets.groupBy(seg_id).agg(F.sum(piece_length()).alias("_whole"))
    return covered.join(whole, seg_id).select(seg_id, _share("_covered", "_whole").alias(out))


def overlap_measures(streets: DataFrame, routes: DataFrame, *, wide: float, tight: float, key: str, seg_id: str = "seg_id") -> DataFrame:
    """All overlap measures of the rulebook from one join (JN6-JN8).

    ``seg_id, ov_wide, ov_tight, ov_same, name_hit`` for segments with a route within ``wide``.
    The three interval unions share one shuffle on the chunk.
    """
    met = with_capsule_interval(_pairs(streets, routes, seg_id, wide, (), carry=[key]), tight, "_u0", "_u1", keep_misses=True)
    same = (F.col(f"s_{key}") == F.col(f"r_{key}")) & (F.col(f"s_{key}") != "")
    gains = met.withColumn("_same", same).withColumns({"_g_wide": _gain("_t0", "_t1", seg_id), "_g_same": _gain("_t0", "_t1", seg_id, F.col("_same"))})
    gains = gains.withColumn("_g_tight", F.when(F.col("_u0").isNotNull(), _gain("_u0", "_u1", seg_id)).otherwise(F.lit(0.0)))
    covered = gains.groupBy(seg_id).agg(*[F.sum(f"_g_{k}").alias(f"_{k}") for k in ("wide", "tight", "same")], F.bool_or("_same").alias("name_hit"))
    whole = streets.groupBy(seg_id).agg(F.sum(piece_length()).alias("_whole"))
    out = covered.join(whole, seg_id)
    return out.select(seg_id, *[_share(f"_{k}", "_whole").alias(f"ov_{k}") for k in ("wide", "tight", "same")], "name_hit")


def name_present(streets: DataFrame, routes: DataFrame, r: float, *, key: str, seg_id: str = "seg_id") -> DataFrame:
    """Ids of segments that a route with the same key touches within ``r`` (JN8)."""
    return _pairs(streets.where(F.col(key) != ""), routes, seg_id, r, [key]).select(seg_id).distinct()
