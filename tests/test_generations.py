"""The upserting stream against a batch fold of the same rows: repeats, late rows, restarts, compaction."""

import datetime as dt
import random

from pyspark.sql import functions as F

from curbline.streaming import generations as G
from curbline.streaming.ingest import fold_rows, merge_deltas

SCHEMA = "incident_id long, row_id long, at timestamp, injury string, place string"
LEVELS = ["Fatal", "Possible Injury", "No Injury", None]


def _rows(rng, n, first, days):
    start = dt.datetime(2024, 1, 1)
    return [(rng.randrange(60), first + i, start + dt.timedelta(days=rng.uniform(*days)), rng.choice(LEVELS), f"p{rng.randrange(9)}") for i in range(n)]


def _attribute(df):
    return df.withColumn("segment", F.concat(F.lit("seg-"), "place"))


def _store(folder, buckets=4):
    return G.Store(f"{folder}/store", "incident_id", "row_id", "at", "injury", ("row_id",), ("place",), 30, buckets)


def _batch(spark, rows):
    deltas = fold_rows(spark.createDataFrame(rows, SCHEMA), key="incident_id", order=["row_id"], severity="injury", fields=["place"])
    return {r[0]: (r[1], r[2], r[3], "seg-" + r[3]) for r in merge_deltas(deltas, key="incident_id", fields=["place"]).collect()}


def _now(spark, store):
    return {r[0]: tuple(r[1:]) for r in G.current(spark, store, ["place", "segment"]).collect()}


def test_stream_equals_batch_with_repeats_late_rows_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    waves = [_rows(rng, 120, 0, (0, 50)), _rows(rng, 120, 1000, (40, 100)), _rows(rng, 120, 2000, (90, 140))]
    waves[1] += waves[0][:10]  # sent again in time or behind the watermark
    old = [r for r in _rows(rng, 30, -500, (0, 20))]
    waves[2] += old + waves[1][:20]
    store, source = _store(tmp_path), f"{tmp_path}/in"
    want, taken, behind, high = [], set(), 0, None
    for k, wave in enumerate(waves):
        spark.createDataFrame(wave, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        G.start(store, stream, f"{tmp_path}/state", _attribute).awaitTermination()  # a new run from the same checkpoint
        for r in wave:
            if high is not None and r[2] < high - dt.timedelta(days=30):
                behind += 1
            elif (r[0], r[1]) not in taken:
                taken.add((r[0], r[1]))
                want.append(r)
        high = max([r[2] for r in wave] + ([high] if high else []))
        assert _now(spark, store) == _batch(spark, want)
        if k:
            assert G.compact(spark, store) == k and G.compact(spark, store) == k
            assert _now(spark, store) == _batch(spark, want)  # what was folded is not read twice
    assert behind > 0 and G.late(spark, store).count() == behind
    gone = G.remove_folded(spark, store)
    assert len(gone) >= 4 and _now(spark, store) == _batch(spark, want)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    rows = _rows(random.Random(2), 80, 0, (0, 10))
    store, df = _store(tmp_path), spark.createDataFrame(rows, SCHEMA)
    G.absorb(store, df.where("row_id < 40"), 0, _attribute)
    for _ in range(2):
        G.absorb(store, df, 1, _attribute)
    assert _now(spark, store) == _batch(spark, rows)
    G.compact(spark, store)
    G.absorb(store, df.limit(0), 2, _attribute)
    assert _now(spark, store) == _batch(spark, rows)


def test_empty_batches_fold_to_nothing(spark, tmp_path):
    store, none = _store(tmp_path), spark.createDataFrame([], SCHEMA)
    G.absorb(store, none, 0, _attribute)
    assert _now(spark, store) == {} and G.compact(spark, store) == 0
    rows = _rows(random.Random(5), 20, 0, (0, 10))
    G.absorb(store, spark.createDataFrame(rows, SCHEMA), 1, _attribute)
    assert _now(spark, store) == _batch(spark, rows)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = _store(tmp_path, buckets=16)
    first = _rows(random.Random(3), 200, 0, (0, 10))
    G.absorb(store, spark.createDataFrame(first, SCHEMA), 0, _attribute)
    G.compact(spark, store)
    more = [(7, 900, first[0][2], "Fatal", "p1")]
    G.absorb(store, spark.createDataFrame(more, SCHEMA), 1, _attribute)
    G.compact(spark, store)
    held = G._manifest(spark, store)[1]
    assert list(held.values()).count(1) == 1 and len(held) > 4
    assert _now(spark, store) == _batch(spark, first + more)
