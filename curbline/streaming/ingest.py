"""Person rows as a stream: folded to incidents, attributed, kept as mergeable deltas (ING6)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import columns as C

WATERMARK = "30 days"


def fold_rows(rows: DataFrame, *, key: str, order: Sequence[str], severity: str, fields: Sequence[str]) -> DataFrame:
    """Partial incidents that can be merged again: worst rank, people, first row by ``order``."""
    return rows.groupBy(key).agg(
        F.min(C.severity_rank(severity)).alias("rank"), F.count(F.lit(1)).alias("victims"), F.min(F.struct(*order, *fields)).alias("first_row")
    )


def merge_deltas(deltas: DataFrame, *, key: str, fields: Sequence[str]) -> DataFrame:
    """Current incidents from all partial ones; minimum, sum and minimum are order-free."""
    one = deltas.groupBy(key).agg(F.min("rank").alias("_r"), F.sum("victims").alias("victims"), F.min("first_row").alias("_f"))
    return one.select(key, C.severity_label("_r").alias("severity"), "victims", *[F.col(f"_f.{c}").alias(c) for c in fields])


def stream_incidents(
    stream: DataFrame, *, key: str, row_id: str, time: str, severity: str, fields: Sequence[str], folder: str, checkpoint: str,
    attribute: Callable[[DataFrame], DataFrame] | None = None, watermark: str = WATERMARK,
):
    """Start the fold; each micro-batch overwrites its own ``batch=<id>`` folder, so a retried batch
    is not counted twice. Rows sent again within the watermark are dropped by their id.
    Deletions cannot be seen here: the snapshot diff finds them.
    """
    deduped = stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key, row_id])

    def save(batch: DataFrame, batch_id: int) -> None:
        delta = fold_rows(batch, key=key, order=[row_id], severity=severity, fields=fields)
        if attribute is not None:
            delta = attribute(delta)
        delta.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return deduped.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_incidents(spark: SparkSession, folder: str, *, key: str, fields: Sequence[str]) -> DataFrame:
    return merge_deltas(spark.read.parquet(folder), key=key, fields=fields)


def compact(spark: SparkSession, folder: str, target: str, *, key: str) -> None:
    """Fold all batches into one generation; the result is again a delta table."""
    deltas = spark.read.parquet(folder).drop("batch")
    folded = deltas.groupBy(key).agg(F.min("rank").alias("rank"), F.sum("victims").alias("victims"), F.min("first_row").alias("first_row"))
    folded.write.mode("overwrite").parquet(target)
