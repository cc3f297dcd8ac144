"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.session import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its low 33 bits


BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def python_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small: texts may be long, and a batch is held whole by a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, most)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches inside a task, and after it the worker's free memory back to the system.

    Workers wait for further tasks beside the executor; without this each keeps the most that it ever took.
    """

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def id_text() -> Column:
    """doc_id as text, for Python stages: beside a null, pandas would turn numbers into floats and lose digits."""
    return F.col("doc_id").cast("string").alias("doc_id")


def id_number() -> Column:
    """doc_id as the number it was before ``id_text``."""
    return F.col("doc_id").cast("bigint").alias("doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` plus its position (from 1) in the global ``order``.

    Range partition, sort inside partitions, then shift by the sizes of the partitions before. Only one row per
    partition meets in a single task; the sorted table is written, so that positions cannot change between reads.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", _ROW_BITS), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(shift), "_part")  # one row per shuffle partition
    return placed.select(*df.columns, (F.col("_base") + row + 1).alias(out))
