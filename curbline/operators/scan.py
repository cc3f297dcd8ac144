"""Running totals, ranks and exact percentiles over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.session import cut


def running_totals(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` plus running sums in global ``order`` (which must be a unique order).

    Range partition, sum per partition, shift each partition by the sums before it: only
    one row per partition meets in a single task.
    """
    names = {out: f"_v{i}" for i, out in enumerate(totals)}
    placed = df.withColumns({names[out]: value for out, value in totals.items()})
    ranged = placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)  # fixes which row lies in which partition
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in names.values()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_base") for v in names.values()])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(shift), "_part")  # one row per shuffle partition
    return out.select(*df.columns, *[(F.sum(v).over(inside) + F.col(f"{v}_base")).alias(o) for o, v in names.items()])


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    return running_totals(df, order, {out: F.lit(1).cast("bigint")})


def percentiles(df: DataFrame, value: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles as rows ``share, value`` (nulls ignored).

    Equal values are folded first, so copies cannot crowd one partition of the sort.
    """
    weight_sum = F.sum(weight) if weight else F.count(F.lit(1))
    folded = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(weight_sum.alias("_w"))
    ranked = running_totals(folded, [F.col("_x")], {"_hi": F.col("_w")}).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = ranked.agg(F.sum("_w").alias("_n"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    spot = total.select("_n", wanted.alias("share")).withColumn("_at", F.col("share") * (F.col("_n") - 1))
    spot = spot.withColumns({"_below": F.floor("_at"), "_above": F.ceil("_at")})
    spot = spot.select("share", "_at", "_below", F.explode(F.array_distinct(F.array("_below", "_above"))).alias("_k"))
    # a handful of rows: two positions per requested share
    held = ranked.join(F.broadcast(spot), (F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi")))
    low, high = F.min(F.struct("_k", "_x")), F.max(F.struct("_k", "_x"))
    return held.groupBy("share").agg(low.getField("_x").alias("_a"), high.getField("_x").alias("_b"), F.first("_at").alias("_at"), F.first("_below").alias("_c")).select(
        "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_c"))).alias("value")
    )


def neighbouring(df: DataFrame, order: Sequence[str], mark: Column, before: str = "before", after: str = "after") -> DataFrame:
    """``df`` plus the last non-null ``mark`` up to each row and the first one from it on, in global ascending ``order``.

    ``order`` must be a unique order. An as-of lookup in both directions without a window over the whole table: range
    partition, look inside each partition, and carry the nearest marks over the borders; only one row per partition
    meets in a single task.
    """
    order = list(order)
    ranged = cut(df.withColumn("_mark", mark).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    at = F.when(F.col("_mark").isNotNull(), F.struct(*order))
    edges = ranged.groupBy("_part").agg(F.min_by("_mark", at).alias("_first"), F.max_by("_mark", at).alias("_last"))
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_part", F.last("_last", ignorenulls=True).over(parts).alias("_carried"), F.last("_first", ignorenulls=True).over(back).alias("_coming"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reverse = Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(edges), "_part")  # one row per shuffle partition
    return out.select(
        *df.columns, F.coalesce(F.last("_mark", ignorenulls=True).over(inside), "_carried").alias(before), F.coalesce(F.last("_mark", ignorenulls=True).over(reverse), "_coming").alias(after))


def interval_sums(intervals: DataFrame, spots: DataFrame, *, interval_id: str, by: Sequence[str], measures: Sequence[str], m: str = "m") -> DataFrame:
    """``interval_id`` and, per row of ``intervals`` (interval_id, *by, lo, hi) folded by it, the sums of ``measures`` at positions in [lo, hi].

    ``spots``: ``*by, m`` and integer measures, one row per position. Two lookups per interval in a running total over
    sorted positions: no interval ever meets the positions inside it, and a line with most rows spreads over partitions.
    Intervals of one ``interval_id`` are distinct; sums are exact for integers.
    """
    zero = {k: F.lit(0).cast("bigint") for k in measures}
    at = spots.select(*by, F.col(m).alias("_m"), F.lit(1).alias("_kind"), F.lit(None).cast(intervals.schema[interval_id].dataType).alias(interval_id), *[F.col(k).cast("bigint").alias(k) for k in measures])
    ends = F.explode(F.array(F.struct(F.col("lo").alias("m"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("m"), F.lit(2).alias("kind"))))
    looks = intervals.select(*by, interval_id, ends.alias("_e")).select(*by, F.col("_e.m").alias("_m"), F.col("_e.kind").alias("_kind"), interval_id, *[v.alias(k) for k, v in zero.items()])
    order = [F.col(c) for c in (*by, "_m", "_kind", interval_id)]
    run = running_totals(at.unionByName(looks), order, {f"_to_{k}": F.col(k) for k in measures})
    side = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    return run.where(F.col("_kind") != 1).groupBy(interval_id).agg(*[F.sum(side * F.col(f"_to_{k}")).alias(k) for k in measures])


def group_percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """Exact interpolated percentiles of every group at once: ``*by, share, value`` (null values ignored).

    All groups are ordered in one range-partitioned table of folded values; a group's places are counted from the total
    before it. No group meets in a single task, so a group may hold most rows. Null group values form a group.
    """
    by = list(by)
    weight_sum = F.sum(weight) if weight else F.count(F.lit(1))
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(weight_sum.alias("_w"))
    ranked = running_totals(folded, [*[F.col(c) for c in by], F.col("_x")], {"_hi": F.col("_w")}).withColumn("_lo", F.col("_hi") - F.col("_w"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    per = ranked.groupBy(*by).agg(F.min("_lo").alias("_base"), F.sum("_w").alias("_n")).withColumn("share", wanted)
    per = per.withColumn("_at", F.col("share") * (F.col("_n") - 1))
    spots = per.select(*[F.col(c).alias(f"_by_{c}") for c in by], "share", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k"), "_base")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    place = F.col("_base") + F.col("_k")
    held = ranked.join(spots, same & (place >= F.col("_lo")) & (place < F.col("_hi")))
    low, high = F.min(F.struct("_k", "_x")), F.max(F.struct("_k", "_x"))
    found = held.groupBy(*by, "share").agg(low.getField("_x").alias("_a"), high.getField("_x").alias("_b"), F.first("_at").alias("_at"))
    return found.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def group_median(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return group_percentiles(df, by, value, [0.5]).select(*by, F.col("value").alias(out))
