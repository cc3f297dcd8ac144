"""Mixing sources to target weights by systematic sampling (native).

Within a source every document is expected ``target / source_size`` times. Documents are put in one global order by
source and falling size, their expected copies are prefix-summed, one pseudo-random offset per source is added, and a
document is emitted once for each integer its interval crosses. Falling size keeps the words taken within about one
document of the target. The order comes from a range partition, so that a hot source is spread over many tasks.

Defined results: a null or empty text has size 0 and takes part; null sources form one source, ordered last; repeated
rows are documents of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import numbered
from curbline.operators.scan import running_totals
from curbline.session import cut

WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 1 << 20  # offsets are multiples of 1 / _STEPS, exact beside large ranks


def source_targets(sizes: DataFrame, share: float, weights: Sequence[int], most: float) -> DataFrame:
    """``source, source_size, target`` by water filling: ``share`` of all words by weight, at most ``most`` per source."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = numbered(per, [F.col("source").asc_nulls_last()], "_k")
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", cycle.cast("bigint"))
    ranked = ranked.withColumn("_full", F.lit(float(most)) * F.col("source_size") / F.col("_w"))
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    if not total:
        return per.withColumn("target", F.lit(0.0))
    # Sources fill up in the order of size per weight; the water level is that of the first one that does not.
    run = running_totals(ranked, [F.col("_full"), F.col("_k")], {"_words": F.col("source_size"), "_ws": F.col("_w")})
    left = F.lit(float(share)) * F.lit(total) - F.lit(float(most)) * (F.col("_words") - F.col("source_size"))
    run = run.withColumn("_level", left / (F.lit(weight) - F.col("_ws") + F.col("_w")))
    level = run.where(F.col("_full") > F.col("_level")).agg(F.min_by("_level", F.struct("_full", "_k"))).first()[0]
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("_w") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, source, text_hash, size, source_size, target, copies, taken."""
    body = F.coalesce(F.col("text"), F.lit(""))
    sizes = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size")))
    targets = source_targets(sizes, share, weights, most)
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    placed = numbered(sizes, order, "_pos")
    first = placed.groupBy("source").agg((F.min("_pos") - 1).alias("_first"))
    targets = targets.join(first, targets["source"].eqNullSafe(first["source"])).drop(first["source"]).withColumnRenamed("source", "_s")
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), "_s"), F.lit("")))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("double") / _STEPS
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = placed.join(targets.withColumns({"_u": offset, "_rate": rate}), F.col("source").eqNullSafe(F.col("_s")))
    rank = F.col("_pos") - F.col("_first")
    crossed = F.floor(rank * F.col("_rate") + F.col("_u")) - F.floor((rank - 1) * F.col("_rate") + F.col("_u"))
    out = out.withColumn("copies", F.least(crossed, F.lit(int(most)).cast("bigint")))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` (of ``mix``) takes it, with the columns of ``docs``."""
    taken = plan.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")).groupBy("doc_id", "source", "text_hash").agg(F.first("row").alias("row"))
    same = rows["doc_id"].eqNullSafe(taken["doc_id"]) & rows["source"].eqNullSafe(taken["source"]) & (rows["text_hash"] == taken["text_hash"])
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def check_sql(share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most: float = 2.0, seed: str = "mix") -> str:
    cycle = "[" + ", ".join(map(str, weights)) + "]"
    return rf"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes GROUP BY source),
weighed AS (SELECT *, {cycle}[(k - 1) % {len(weights)} + 1] AS w FROM per),
ratio AS (SELECT *, {most!r}::DOUBLE * source_size / w AS full_at FROM weighed),
run AS (SELECT *, ({share!r}::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - {most!r}::DOUBLE * CAST(sum(source_size) OVER o - source_size AS BIGINT))
    / CAST(sum(w) OVER () - sum(w) OVER o + w AS BIGINT) AS level FROM ratio WINDOW o AS (ORDER BY full_at, k)),
found AS (SELECT arg_min(level, (full_at, k)) AS level FROM run WHERE full_at > level),
targets AS (SELECT source, source_size, coalesce(least({most!r}::DOUBLE * source_size, w * (SELECT level FROM found)), 0) AS target,
    CAST('0x' || substr(md5('{seed}' || coalesce(':' || source, '')), 1, 5) AS BIGINT)::DOUBLE / {_STEPS} AS u FROM ratio),
ranked AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id) AS r FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(r * rate + u) - floor((r - 1) * rate + u), {int(most)}) AS BIGINT) * size AS taken FROM ranked
"""
