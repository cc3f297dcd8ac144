"""Keeping the tables current: probes, snapshot diffs, merges, gates (ING1-ING5, AG38, ST*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP_DAYS = 30
SIGNATURE = ("incident_date", "severity", "lat5", "lon5", "victims")


def signature(incidents: DataFrame) -> DataFrame:
    """What makes an incident the same between two snapshots."""
    return incidents.select("incident_id", "incident_date", "severity", F.bround("lat", 5).alias("lat5"), F.bround("lon", 5).alias("lon5"), "victims")


def change_probe(old_rows: DataFrame, new_rows: DataFrame, *, key: str = "incident_id", date: str = "incident_date", days: int = OVERLAP_DAYS) -> DataFrame:
    """One row (ING1): new ids, vanished ids and row counts since ``days`` before the last known date."""
    last = old_rows.agg(F.max(date)).first()[0]
    # a first load has no last date: everything is new then
    since = F.lit(True) if last is None else F.col(date) >= F.date_sub(F.lit(last), days)
    recent = lambda df, side: df.where(since).groupBy(key).agg(F.count(F.lit(1)).alias(side))
    both = recent(old_rows, "old_n").join(recent(new_rows, "new_n"), key, "full_outer")
    out = both.agg(
        F.count_if(F.col("old_n").isNull()).alias("new_ids"), F.count_if(F.col("new_n").isNull()).alias("gone_ids"),
        F.coalesce(F.sum("old_n"), F.lit(0)).alias("old_rows"), F.coalesce(F.sum("new_n"), F.lit(0)).alias("new_rows"),
    )
    return out.withColumn("changed", (F.col("new_ids") > 0) | (F.col("gone_ids") > 0) | (F.col("old_rows") != F.col("new_rows")))


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str = "incident_id", compare: Sequence[str] = SIGNATURE) -> DataFrame:
    """Changed keys only (ING2): ``key, change`` = added, removed or modified; nulls compare equal."""
    a, b = old.select(key, F.struct(*compare).alias("_a")), new.select(key, F.struct(*compare).alias("_b"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), F.lit("added")).when(F.col("_b").isNull(), F.lit("removed")).when(~F.col("_a").eqNullSafe(F.col("_b")), F.lit("modified"))
    return both.select(key, kind.alias("change")).where("change is not null")


def merge_by_key(old: DataFrame, new: DataFrame, *, key: str = "incident_id") -> DataFrame:
    """``new`` rows replace those with the same key, the rest stay (ING3)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def gate(name: str, *, ok: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), value.cast("bigint").alias("value"))


def quality_gates(old: DataFrame, new: DataFrame, *, least_share: float, may_lose: int, may_gain: int) -> DataFrame:
    """One row per gate (ING4). ``old`` and ``new`` are classified incidents with ``is_limited``."""
    ask = lambda df, side: df.agg(
        F.count(F.lit(1)).alias(f"{side}_n"), F.max("incident_date").alias(f"{side}_last"), F.count_if("is_limited").alias(f"{side}_limited"),
        F.count_if(~F.col("is_limited")).alias(f"{side}_surface"), F.count("street").alias(f"{side}_named"), F.lit(1).alias("_one"),
    )
    both = ask(old, "old").join(ask(new, "new"), "_one")  # one row each
    c = F.col
    gates = [
        gate("enough_rows", ok=c("new_n") >= least_share * c("old_n"), value=c("new_n")),
        gate("parts_sum", ok=c("new_surface") + c("new_limited") == c("new_n"), value=c("new_surface") + c("new_limited")),
        gate("streets_sum", ok=c("new_named") == c("new_n"), value=c("new_named")),
        gate("not_shrunk", ok=c("new_n") >= c("old_n") - may_lose, value=c("new_n") - c("old_n")),
        gate("not_exploded", ok=c("new_n") <= c("old_n") + may_gain, value=c("new_n") - c("old_n")),
        gate("date_not_back", ok=c("new_last") >= c("old_last"), value=F.date_diff(c("new_last"), c("old_last"))),
    ]
    return both.select(F.explode(F.array(*gates)).alias("_g")).select("_g.*")


def _gate_rows(counts: DataFrame, gates: list[Column]) -> DataFrame:
    return counts.select(F.explode(F.array(*gates)).alias("_g")).select("_g.*")


def source_gates(declared: DataFrame, local: DataFrame, downloaded: DataFrame, *, least_share: float = 0.9) -> DataFrame:
    """Gates on the pull itself (ING4): the source does not declare far fewer rows (``declared``: one row, ``n``) than are
    held, and exactly as many rows came as it declared."""
    count = lambda df, out: df.agg(F.count(F.lit(1)).alias(out), F.lit(1).alias("_one"))
    both = declared.select(F.col("n").alias("declared"), F.lit(1).alias("_one")).join(count(local, "held"), "_one").join(count(downloaded, "came"), "_one")  # one row each
    c = F.col
    return _gate_rows(both, [
        gate("enough_declared", ok=c("declared") >= least_share * c("held"), value=c("declared")), gate("all_declared_came", ok=c("came") == c("declared"), value=c("came") - c("declared")),
    ])


def index_gates(incidents: DataFrame, ranking: DataFrame, streets: DataFrame, *, most_unlisted: int = 25) -> DataFrame:
    """Gates on what was built (ING4): corridor totals sum to the incidents, and the street index, which leaves generic
    names out, to nearly as many."""
    one = F.lit(1).alias("_one")
    both = incidents.agg(F.count(F.lit(1)).alias("n"), one).join(ranking.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("ranked"), one), "_one")
    both = both.join(streets.agg(F.coalesce(F.sum("crashes"), F.lit(0)).alias("listed"), one), "_one")  # one row each
    left = F.col("n") - F.col("listed")
    return _gate_rows(both, [
        gate("corridors_sum", ok=F.col("ranked") == F.col("n"), value=F.col("ranked")), gate("street_index_sum", ok=left.between(0, most_unlisted), value=left),
    ])


def require(gates: DataFrame) -> None:
    """Stop the refresh when a gate failed (a handful of rows on the driver)."""
    failed = [r["gate"] for r in gates.where(~F.col("passed")).collect()]
    if failed:
        raise RuntimeError("refresh stopped by gates: " + ", ".join(failed))


def status_delta(before: DataFrame, after: DataFrame, *, key: str = "incident_id", node: str = "intersection_node_id", status: str = "intersection_signalized") -> DataFrame:
    """Incidents that gained a junction, lost one or changed signal status (ING5)."""
    a = before.select(key, F.col(node).alias("_n0"), F.coalesce(F.col(status), F.lit("")).alias("_s0"))
    b = after.select(key, F.col(node).alias("_n1"), F.coalesce(F.col(status), F.lit("")).alias("_s1"))
    return a.join(b, key).agg(
        F.count(F.lit(1)).alias("common"), F.count_if(F.col("_n0").isNull() & F.col("_n1").isNotNull()).alias("gained_node"),
        F.count_if(F.col("_n0").isNotNull() & F.col("_n1").isNull()).alias("lost_node"), F.count_if(F.col("_s0") != F.col("_s1")).alias("status_changed"),
    )


def reconcile(whole: DataFrame, parts: dict[str, DataFrame], total: str = "n") -> DataFrame:
    """Does each one-row count table equal the count of ``whole``? (AG38)"""
    want = whole.agg(F.count(F.lit(1)).alias("want")).withColumn("_one", F.lit(1))
    rows = None
    for name, df in parts.items():
        got = df.select(F.lit(name).alias("part"), F.coalesce(F.col(total), F.lit(0)).cast("bigint").alias("got"), F.lit(1).alias("_one"))
        rows = got if rows is None else rows.unionByName(got)
    return rows.join(want, "_one").select("part", "got", "want", (F.col("got") == F.col("want")).alias("agrees"))


def tables_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table only, both ways (AG38)."""
    left = a.exceptAll(b).withColumn("side", F.lit("first"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
