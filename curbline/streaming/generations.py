"""A stream of person rows upserted into generations of incidents, with late rows put aside (ING6).

Every micro-batch leaves four things under its own number: the partial incidents it adds (``delta``), the rows it took
(``seen``), the rows behind the watermark (``late``) and the highest time so far (``mark``). A batch that is run again
overwrites its own and reads only those before it, so nothing counts twice. Compaction folds the deltas into a generation,
bucket by bucket; the manifest says which generation holds each bucket and up to which batch, so a reader takes every
delta exactly once, and only buckets with new deltas are rewritten. Old generations and deltas can be removed afterwards.

Each row of the stream ends in exactly one place: an incident, the late rows, or, as a repeat of a row that was taken
within the watermark, nowhere. Deletions cannot be seen by a stream: the snapshot diff finds them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.streaming.ingest import fold_rows, merge_deltas

BUCKETS = 16


@dataclass(frozen=True)
class Store:
    """A folder of incidents: their key, the id and time of person rows, and what is kept of each first row."""

    folder: str
    key: str
    row_id: str
    time: str
    severity: str
    order: tuple[str, ...]
    fields: tuple[str, ...]
    delay_days: int = 30
    buckets: int = BUCKETS

    def path(self, *parts: str | int) -> str:
        return "/".join([self.folder.rstrip("/"), *map(str, parts)])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")


def _numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Numbers of the finished tables in a folder (those Spark has committed)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = [s.getPath() for s in store.listStatus(root)]
    return sorted(int(p.getName().removeprefix(prefix)) for p in found if store.exists(hadoop(p, "_SUCCESS")))


def _read(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """The tables of several batches, which lie in one folder, as one."""
    return spark.read.option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths).drop("batch") if paths else None


def absorb(store: Store, batch: DataFrame, batch_id: int, attribute: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Take one micro-batch into the store.

    ``attribute`` adds columns to ``key, *fields`` of each partial incident; they travel with the first row they came from.
    """
    spark, at = batch.sparkSession, F.col(store.time).cast("timestamp")
    earlier = [k for k in _numbers(spark, store.path("mark"), "batch=") if k < batch_id]
    mark = _read(spark, [store.path("mark", f"batch={k}") for k in earlier[-1:]])
    high = mark.first()["high"] if mark is not None else None  # one row
    edge = F.lit(high) - F.expr(f"INTERVAL {store.delay_days} DAYS") if high is not None else F.lit(None).cast("timestamp")
    is_late = F.coalesce(at < edge, F.lit(False))
    batch.where(is_late).write.mode("overwrite").parquet(store.path("late", f"batch={batch_id}"))
    taken = batch.where(~is_late).dropDuplicates([store.key, store.row_id])
    before = _read(spark, [store.path("seen", f"batch={k}") for k in earlier])
    if before is not None:  # only rows that can still come again without being late
        still = before.where(F.coalesce(F.col("_t") >= edge, F.lit(True))).select(F.col(store.key).alias("_k"), F.col(store.row_id).alias("_r"))
        taken = taken.join(still, F.col(store.key).eqNullSafe(F.col("_k")) & F.col(store.row_id).eqNullSafe(F.col("_r")), "left_anti")
    taken.select(store.key, store.row_id, at.alias("_t")).write.mode("overwrite").parquet(store.path("seen", f"batch={batch_id}"))
    fresh = spark.read.parquet(store.path("seen", f"batch={batch_id}")).select(F.col(store.key).alias("_k"), F.col(store.row_id).alias("_r"))
    rows = batch.where(~is_late).dropDuplicates([store.key, store.row_id]).join(fresh, F.col(store.key).eqNullSafe(F.col("_k")) & F.col(store.row_id).eqNullSafe(F.col("_r")), "left_semi")
    delta = fold_rows(rows, key=store.key, order=store.order, severity=store.severity, fields=store.fields)
    if attribute is not None:
        flat = delta.select(store.key, "rank", "victims", "first_row.*")
        more = attribute(flat.select(store.key, *store.fields))
        added = [c for c in more.columns if c not in (store.key, *store.fields)]
        flat = flat.join(more.select(store.key, *added), store.key, "left")
        delta = flat.select(store.key, "rank", "victims", F.struct(*store.order, *[f for f in store.fields if f not in store.order], *added).alias("first_row"))
    delta.withColumn("bucket", store.bucket()).write.mode("overwrite").parquet(store.path("delta", f"batch={batch_id}"))
    now = batch.agg(F.greatest(F.max(at), F.lit(high).cast("timestamp")).alias("high"))
    now.write.mode("overwrite").parquet(store.path("mark", f"batch={batch_id}"))  # the last to be written: the batch is in


def start(store: Store, stream: DataFrame, checkpoint: str, attribute: Callable[[DataFrame], DataFrame] | None = None):
    """Start the upsert of everything that is there now."""
    return stream.writeStream.foreachBatch(lambda batch, k: absorb(store, batch, k, attribute)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, store: Store) -> tuple[int, dict[int, int]]:
    """The last folded batch and the generation of each bucket: at most ``buckets`` rows."""
    versions = _numbers(spark, store.path("manifest"))
    if not versions:
        return -1, {}
    rows = spark.read.parquet(store.path("manifest", versions[-1])).collect()
    return rows[0]["upto"], {r["bucket"]: r["generation"] for r in rows if r["bucket"] >= 0}


def _parts(spark: SparkSession, store: Store) -> tuple[DataFrame | None, list[int], int, dict[int, int]]:
    """All partial incidents, the batches not folded yet, and the manifest."""
    upto, held = _manifest(spark, store)
    done = [k for k in _numbers(spark, store.path("mark"), "batch=") if k > upto]
    whole = None
    for generation in sorted(set(held.values())):
        part = spark.read.parquet(store.path("generation", generation)).where(F.col("bucket").isin([b for b, g in held.items() if g == generation]))
        whole = part if whole is None else whole.unionByName(part)
    deltas = _read(spark, [store.path("delta", f"batch={k}") for k in done if k in _numbers(spark, store.path("delta"), "batch=")])
    whole = deltas if whole is None else whole if deltas is None else whole.unionByName(deltas)
    return whole, done, upto, held


def current(spark: SparkSession, store: Store, fields: Sequence[str]) -> DataFrame:
    """Incidents as of the last finished batch: key, severity, victims and ``fields`` of the first row."""
    whole = _parts(spark, store)[0]
    if whole is None:
        raise ValueError("no batch has been taken yet")
    return merge_deltas(whole, key=store.key, fields=fields)


def late(spark: SparkSession, store: Store) -> DataFrame:
    """Rows that came behind the watermark."""
    return _read(spark, [store.path("late", f"batch={k}") for k in _numbers(spark, store.path("mark"), "batch=")])


def compact(spark: SparkSession, store: Store) -> int:
    """Fold finished deltas into a new generation of the buckets they touch; the number of the last batch folded."""
    whole, done, upto, held = _parts(spark, store)
    if not done:
        return upto
    deltas = _read(spark, [store.path("delta", f"batch={k}") for k in done])
    touched = [r["bucket"] for r in deltas.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    generation = max(_numbers(spark, store.path("generation")), default=-1) + 1
    folded = whole.where(F.col("bucket").isin(touched)).groupBy(store.key, "bucket").agg(F.min("rank").alias("rank"), F.sum("victims").alias("victims"), F.min("first_row").alias("first_row"))
    if touched:
        folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(store.path("generation", generation))
    held = held | {b: generation for b in touched}
    version = max(_numbers(spark, store.path("manifest")), default=-1) + 1
    rows = [(b, g, done[-1]) for b, g in sorted(held.items())] or [(-1, -1, done[-1])]  # nothing but empty batches so far
    spark.createDataFrame(rows, "bucket int, generation int, upto bigint").coalesce(1).write.mode("overwrite").parquet(store.path("manifest", version))
    return done[-1]


def remove_folded(spark: SparkSession, store: Store) -> list[str]:
    """Remove deltas and generations that the manifest has replaced; readers that started before must have ended."""
    upto, held = _manifest(spark, store)
    gone = [store.path("delta", f"batch={k}") for k in _numbers(spark, store.path("delta"), "batch=") if k <= upto]
    gone += [store.path("generation", g) for g in _numbers(spark, store.path("generation")) if g not in held.values() and g < max(held.values(), default=0)]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, gone):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone
