"""Table outputs (SNK1-SNK3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions import columns as C


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = ()) -> None:
    """Parquet, optionally in folders; rows are brought together by folder first, and AQE splits
    what is too large for a task, so that the number of files per folder follows its size."""
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_search_tables(streets: DataFrame, junctions: DataFrame, aliases: DataFrame, folder: str) -> None:
    """The three lookup tables of name search (SNK2)."""
    for name, df in (("street_index", streets), ("junction_index", junctions), ("alias_index", aliases)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def compact_feed(incidents: DataFrame) -> DataFrame:
    """Small per-incident feed (SNK3): rounded place, owner code, fatal 0/1, ISO date, labels."""
    return incidents.select(
        "incident_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), C.owner_code("owner").alias("owner_code"), C.is_fatal().cast("int").alias("fatal"),
        F.coalesce(F.date_format("incident_date", "yyyy-MM-dd"), F.lit("")).alias("date"), "severity", F.coalesce("location", F.lit("")).alias("location"),
    )
