"""Linear referencing: merged lines, measures along them, gaps between positions (LR*, WN3, WN4, WN6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.functions.geometry import piece_length
from curbline.operators.scan import neighbouring
from curbline.operators.spatial import nearest
from curbline.session import cut

_MAX_ROUNDS = 64


def _snap(c: str) -> Column:
    return F.round(F.col(c) * 1000).cast("bigint")


def merge_lines(pieces: DataFrame, *, by: Sequence[str], seg_id: str = "seg_id") -> DataFrame:
    """Pieces with ``len, chain_id, chain_len, m_start, m_dir``.

    Pieces of one line that meet end to end at a point shared by exactly two ends form one
    chain. ``m_start`` is the chain measure of (x1, y1); ``m_dir`` is +1 when the piece runs
    with the chain. Measures come from pointer doubling: log2(longest chain) equi joins.
    """
    by = list(by)
    base = cut(pieces.withColumn("len", piece_length())).where(F.col("len") > 0)  # behind the written table: before it, the test would repeat all that x and y are made of
    end = lambda k: F.struct(F.lit(k).alias("end"), _snap(f"x{k + 1}").alias("nx"), _snap(f"y{k + 1}").alias("ny"))
    ends = base.select(*by, seg_id, F.explode(F.array(end(0), end(1))).alias("_e"))
    ends = ends.select(*by, F.col("_e.nx").alias("nx"), F.col("_e.ny").alias("ny"), F.struct(F.col(seg_id).alias("seg"), F.col("_e.end").alias("end")).alias("who"))
    joints = ends.groupBy(*by, "nx", "ny").agg(F.count(F.lit(1)).alias("n"), F.min("who").alias("p"), F.max("who").alias("q")).where("n = 2")
    # a half edge is 2 * piece + direction; direction 0 runs from end 0 to end 1
    arrive = lambda w: F.col(f"{w}.seg") * 2 + (1 - F.col(f"{w}.end"))
    leave = lambda w: F.col(f"{w}.seg") * 2 + F.col(f"{w}.end")
    hops = joints.select(F.explode(F.array(F.struct(arrive("p").alias("h"), leave("q").alias("nxt")), F.struct(arrive("q").alias("h"), leave("p").alias("nxt")))).alias("_j")).select("_j.h", "_j.nxt")
    halves = base.select(F.explode(F.array(F.col(seg_id) * 2, F.col(seg_id) * 2 + 1)).alias("h"), F.col("len").alias("d"))
    halves = cut(halves.join(hops, "h", "left"))
    done = _rank_halves(halves)
    forward = done.where(F.col("h") % 2 == 0).select((F.col("h") / 2).cast("bigint").alias(seg_id), F.col("d").alias("_df"), F.floor(F.col("term") / 2).alias("_tf"))
    backward = done.where(F.col("h") % 2 == 1).select(((F.col("h") - 1) / 2).cast("bigint").alias(seg_id), F.col("d").alias("_db"), F.floor(F.col("term") / 2).alias("_tb"))
    both = base.join(forward, seg_id).join(backward, seg_id)
    with_chain = F.col("_tb") <= F.col("_tf")
    return both.select(
        *base.columns,
        F.least("_tf", "_tb").alias("chain_id"),
        (F.col("_df") + F.col("_db") - F.col("len")).alias("chain_len"),
        F.when(with_chain, F.col("_db") - F.col("len")).otherwise(F.col("_df")).alias("m_start"),
        F.when(with_chain, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("m_dir"),
    )


def _rank_halves(halves: DataFrame) -> DataFrame:
    """Length from each half edge to the end of its chain, and the half edge that ends it."""
    state = halves.select("h", "d", "nxt", F.col("h").alias("term"), F.least("h", "nxt").alias("low"))
    size, covered = None, 1
    for _ in range(_MAX_ROUNDS):
        far = state.select(F.col("h").alias("nxt"), F.col("d").alias("_d"), F.col("nxt").alias("_n"), F.col("term").alias("_t"), F.col("low").alias("_l"))
        moved = state.join(far, "nxt", "left")
        step = F.col("nxt").isNotNull()
        state = cut(
            moved.select(
                "h",
                F.when(step, F.col("d") + F.col("_d")).otherwise(F.col("d")).alias("d"),
                F.col("_n").alias("nxt"),
                F.when(step, F.col("_t")).otherwise(F.col("term")).alias("term"),
                F.least("low", "_l").alias("low"),
            )
        )
        covered *= 2
        left = state.where(F.col("nxt").isNotNull()).count()
        if left == 0:
            return state.select("h", "d", "term")
        size = left if size is None else size
        if covered > 2 * size:
            break
    # what is still moving runs in closed loops: open each at its smallest half edge
    loops = state.where(F.col("nxt").isNotNull()).select("h", "low")
    opened = halves.join(loops, "h").withColumn("nxt", F.when(F.col("nxt") == F.col("low"), F.lit(None)).when((F.col("low") % 2 == 1) & (F.col("h") == F.col("low")), F.lit(None)).otherwise(F.col("nxt")))
    # the two directions of a loop must open at the same place: before end 0 of the smallest piece
    opened = opened.withColumn("nxt", F.when((F.col("low") % 2 == 1) & F.col("nxt").isNull() & (F.col("h") != F.col("low")), F.col("low")).otherwise(F.col("nxt")))
    rest = _rank_halves(cut(opened.select("h", "d", "nxt")))
    return state.where(F.col("nxt").isNull()).select("h", "d", "term").unionByName(rest)


def measured(t="t") -> Column:
    """Chain measure of the point at share ``t`` of a merged piece."""
    return F.col("m_start") + F.col("m_dir") * F.col(t) * F.col("len")


def measure(points: DataFrame, chains: DataFrame, *, point_id: str, by: Sequence[str] = (), seg_id: str = "seg_id", carry: Sequence[str] = (), **options) -> DataFrame:
    """Nearest chain of each point (of its own line with ``by``), offset and measure (LR1, LR9)."""
    want = list(dict.fromkeys([*carry, "chain_id", "chain_len", "m_start", "m_dir", "len"]))
    hit = nearest(points, chains, point_id=point_id, key=[seg_id], by=by, carry=want, **options)
    return hit.withColumn("m", measured()).select(point_id, seg_id, *dict.fromkeys([*carry, "chain_id", "chain_len"]), "m", "t", "dist")


def place(points: DataFrame, chains: DataFrame, *, point_id: str) -> DataFrame:
    """Where measures lie in the plane: ``point_id, chain_id, m, x, y`` for points with ``chain_id, m``.

    The inverse of ``measure``: every point looks up the piece that starts last before it, in one order of all chains.
    """
    ahead = F.col("m_dir") > 0
    low = F.when(ahead, F.col("m_start")).otherwise(F.col("m_start") - F.col("len"))
    ends = [F.when(ahead, F.col(f"{c}{a}")).otherwise(F.col(f"{c}{b}")).alias(f"{c}{a}") for c in "xy" for a, b in ((1, 2), (2, 1))]
    none = F.lit(None).cast(points.schema[point_id].dataType)
    pieces = chains.select("chain_id", low.alias("m"), F.lit(0).alias("_kind"), "seg_id", none.alias(point_id), F.struct("chain_id", low.alias("low"), "len", *ends).alias("_piece"))
    asked = points.select("chain_id", "m", F.lit(1).alias("_kind"), F.lit(None).cast(chains.schema["seg_id"].dataType).alias("seg_id"), point_id, F.lit(None).cast(pieces.schema["_piece"].dataType).alias("_piece"))
    seen = neighbouring(pieces.unionByName(asked), ["chain_id", "m", "_kind", "seg_id", point_id], F.col("_piece"), "_b", "_a").where(F.col("_kind") == 1)
    on = F.when(F.col("_b.chain_id") == F.col("chain_id"), F.col("_b")).when(F.col("_a.chain_id") == F.col("chain_id"), F.col("_a"))  # the second: rounding at the start
    seen = seen.withColumn("_on", on).where(F.col("_on").isNotNull())
    share = F.least(F.greatest((F.col("m") - F.col("_on.low")) / F.col("_on.len"), F.lit(0.0)), F.lit(1.0))
    return seen.select(point_id, "chain_id", "m", *[(F.col(f"_on.{c}1") + share * (F.col(f"_on.{c}2") - F.col(f"_on.{c}1"))).alias(c) for c in "xy"])


def reference_lines(chains: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The longest chain of every line: ``*by, chain_id, chain_len`` (LR2)."""
    best = chains.groupBy(*by).agg(F.min(F.struct((-F.col("chain_len")).alias("l"), F.col("chain_id").alias("c"))).alias("_b"))
    return best.select(*by, F.col("_b.c").alias("chain_id"), (-F.col("_b.l")).alias("chain_len"))


def along_nearest(points: DataFrame, targets: DataFrame, *, point_id: str, target_id: str, by: Sequence[str], m: str = "m") -> DataFrame:
    """Nearest target by difference of measures on the same line (LR3), the smallest ``target_id`` on ties.

    Points and targets are put in one order of line and measure; each point looks at the last target before it and the
    first behind it. Lines are never keys of a join, so one line may hold most rows. A null line or measure has no target.
    """
    by = list(by)
    known = F.lit(True)
    for c in (*by, m):
        known = known & F.col(c).isNotNull()
    held = targets.where(known).groupBy(*by, F.col(m).alias("_m")).agg(F.min(target_id).alias(target_id))  # the only one at its place
    marks = held.select(*by, "_m", F.lit(0).alias("_kind"), F.lit(None).cast(points.schema[point_id].dataType).alias(point_id), target_id)
    asked = points.where(known).select(*by, F.col(m).alias("_m"), F.lit(1).alias("_kind"), point_id, F.lit(None).cast(targets.schema[target_id].dataType).alias(target_id))
    place = F.when(F.col("_kind") == 0, F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by)], F.col("_m").alias("m"), F.col(target_id).alias("target")))
    seen = neighbouring(asked.unionByName(marks), [*by, "_m", "_kind", point_id], place).where(F.col("_kind") == 1)

    def near(side: str) -> Column:
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & (F.col(side)[f"by{i}"] == F.col(c))
        return F.when(same, F.struct(F.abs(F.col("_m") - F.col(side)["m"]).alias("d"), F.col(side)["target"].alias("target")))

    best = seen.select(point_id, F.least(near("before"), near("after")).alias("_b")).where(F.col("_b").isNotNull())
    return best.select(point_id, F.col("_b.target").alias(target_id), F.col("_b.d").alias("along_m"))


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, width: float, out: str = "previous") -> DataFrame:
    """The ``value`` of the row before this one along each line (WN3), without one window per line.

    Rows are compared inside stretches of ``width``; only one summary row per stretch
    meets in the window over the whole line, so a line holding most rows stays split.
    ``order`` starts with a position column.
    """
    by, pos = list(by), order[0]
    cutup = df.withColumn("_b", F.floor(F.col(pos) / width))
    inner = Window.partitionBy(*by, "_b").orderBy(*order)
    lagged = cutup.withColumns({out: F.lag(value).over(inner), "_first": F.row_number().over(inner) == 1})
    last = cutup.groupBy(*by, "_b").agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_last"))
    stretch = last.withColumn("_carry", F.lag(F.col("_last._v")).over(Window.partitionBy(*by).orderBy("_b"))).drop("_last")
    whole = lagged.join(stretch, [*by, "_b"])
    return whole.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(out))).drop("_b", "_first", "_carry")


def spacing_and_gaps(positions: DataFrame, lines: DataFrame, *, by: Sequence[str], m: str = "m", length: str = "chain_len", width: float = 2000.0) -> DataFrame:
    """Stretches between neighbouring positions of each line and its two ends.

    ``*by, from_m, to_m, gap, inner``; ``inner`` marks stretches between two positions.
    """
    at = positions.select(*by, F.col(m).alias("to_m"), F.lit(1).alias("_kind"))
    ends = lines.select(*by, F.explode(F.array(F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("k")), F.struct(F.col(length).alias("v"), F.lit(2).alias("k")))).alias("_e"))
    marks = at.unionByName(ends.select(*by, F.col("_e.v").alias("to_m"), F.col("_e.k").alias("_kind")))
    # ends sort before / after positions at the same measure
    marks = marks.withColumn("_w", F.struct(F.col("to_m").alias("m"), F.col("_kind").alias("k")))
    near = with_previous(marks, by, ["to_m", "_kind"], "_w", width=width, out="_p").where(F.col("_p").isNotNull())
    return near.select(*by, F.col("_p.m").alias("from_m"), "to_m", (F.col("to_m") - F.col("_p.m")).alias("gap"), ((F.col("_p.k") == 1) & (F.col("_kind") == 1)).alias("inner"))


def longest_gap(gaps: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The longest stretch of each line and its ends; of stretches equal to the millimetre the first along the line (WN4)."""
    best = gaps.groupBy(*by).agg(F.max(F.struct(F.round("gap", 3), (-F.col("from_m")).alias("neg"), F.col("to_m").alias("to"), "gap")).alias("_g"))
    return best.select(*by, F.col("_g.gap").alias("longest_gap"), (-F.col("_g.neg")).alias("gap_from"), F.col("_g.to").alias("gap_to"))


def status_runs(pieces: DataFrame, *, by: Sequence[str], status: Sequence[str], start: str = "m_low", end: str = "m_high", width: float = 2000.0) -> DataFrame:
    """Merge neighbouring pieces of a chain with equal ``status`` (WN6).

    ``*by, *status, run_from, run_to, pieces``.
    """
    by, status = list(by), list(status)
    marked = pieces.withColumn("_s", F.struct(*status))
    seen = with_previous(marked, by, [start, end], "_s", width=width, out="_p")
    starts = seen.withColumn("_from", F.when(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_s")), F.col(start)))
    cutup = starts.withColumn("_b", F.floor(F.col(start) / width))
    inner = Window.partitionBy(*by, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    local = cutup.withColumn("_run", F.last("_from", ignorenulls=True).over(inner))
    carry = cutup.groupBy(*by, "_b").agg(F.max("_from").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    runs = local.join(carry, [*by, "_b"]).withColumn("_run", F.coalesce("_run", "_carry"))
    return runs.groupBy(*by, *status, F.col("_run").alias("run_from")).agg(F.max(end).alias("run_to"), F.count(F.lit(1)).alias("pieces"))
