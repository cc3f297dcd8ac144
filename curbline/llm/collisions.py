"""Approximate nearest neighbours by collision counting over single projections, with virtual rehashing.

Vectors are scaled to length one, so that the nearest by cosine is the nearest by distance. ``PROJECTIONS`` random lines
are fixed by a seed. Index rows are dealt to blocks, queries to groups, and every block meets every group once, in a task
that holds one of each. There each projection of the block is one sorted array. For a query at radius R, the window of a
projection is the stretch of that array within R * WIDTH of the query's own projection; R grows by ``GROWTH`` (virtual
rehashing: no bucket is ever stored, windows only widen). Vectors that lie in at least ``THRESHOLD`` of all windows are
verified by their exact cosine. A query is done in a block when ``k`` verified vectors are within R, or when the windows
hold the whole block. The best k over all blocks are the answer.

A vector at distance R falls into a window with probability 2 Phi(WIDTH) - 1 = 0.83; with 48 projections and a threshold
of 0.75 it is missed with probability 0.06, and less the nearer it is. Most other vectors stay below the threshold.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite numbers take
no part, neither as queries nor as candidates; a query never finds its own row; ties go to the smaller vec_id; repeated
vec_ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbline.llm.common import numbered
from curbline.session import cut

PROJECTIONS, WIDTH, GROWTH, THRESHOLD = 48, 1.3642, 1.25, 0.75
_FIRST_RADIUS, _LAST_RADIUS = 0.15, 2.0  # distances between vectors of length one
BLOCK, QUERIES = 16_384, 512  # rows of a block and queries of a group in one task
_SEED = 20_240_607


def lines(dimensions: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dimensions, PROJECTIONS))


def nearest_in_block(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its number, positions in the block of at most k verified vectors (best first), and their cosines."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    directions = lines(vectors.shape[1])
    placed = np.ascontiguousarray((unit @ directions).T)
    order = np.argsort(placed, axis=1)
    arrays = np.take_along_axis(placed, order, axis=1)  # one sorted array per projection
    hashed = asked @ directions
    lengths, n = np.linalg.norm(vectors, axis=1), len(ids)
    need = int(np.ceil(THRESHOLD * PROJECTIONS))
    out = []
    for q in range(len(asked)):
        hits, seen = np.zeros(n, np.uint8), np.zeros(n, bool)
        found, scores = np.empty(0, np.int64), np.empty(0)
        middle = [int(np.searchsorted(arrays[p], hashed[q, p])) for p in range(PROJECTIONS)]
        low, high, radius = list(middle), list(middle), _FIRST_RADIUS
        while True:
            for p in range(PROJECTIONS):
                a = int(np.searchsorted(arrays[p, : low[p]], hashed[q, p] - radius * WIDTH, "left"))
                b = high[p] + int(np.searchsorted(arrays[p, high[p] :], hashed[q, p] + radius * WIDTH, "right"))
                hits[order[p, a : low[p]]] += 1  # a row is once in each array
                hits[order[p, high[p] : b]] += 1
                low[p], high[p] = a, b
            fresh = np.flatnonzero((hits >= need) & ~seen)
            seen[fresh] = True
            fresh = fresh[rows[fresh] != query_rows[q]]
            if len(fresh):
                exact = vectors[fresh] @ queries[q] / (lengths[fresh] * np.linalg.norm(queries[q]))
                found, scores = np.r_[found, fresh], np.r_[scores, exact]
                best = np.lexsort((ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            if (len(found) >= k and 2 - 2 * scores[-1] <= radius * radius) or (not any(low) and min(high) == n):
                break
            radius = radius * GROWTH if radius < _LAST_RADIUS else radius * 4
        out.append((q, found, scores))
    return out


def clean(vectors: DataFrame) -> DataFrame:
    """_row, vec_id, vector (array of double) of the rows that take part."""
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    usual = sound.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return sound.limit(0).withColumn("_row", F.lit(0).cast("bigint"))
    big = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (x < big) & (x > -big))
    sound = sound.where((F.size("vector") == usual["n"]) & finite & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull())
    return numbered(sound, [F.col("vec_id")], "_row")


def search(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``."""
    rows = cut(clean(vectors))
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = rows.select(F.floor(F.col("_row") / BLOCK).alias("block"), F.lit(False).alias("asking"), "_row", "vec_id", "vector")
    groups = cut(numbered(asked, [F.col("_row")], "_q").select(F.floor(F.col("_q") / QUERIES).alias("group"), F.lit(True).alias("asking"), "_row", "vec_id", "vector"))
    n_blocks, n_groups = (rows.agg(F.max("_row")).first()[0] or 0) // BLOCK + 1, (groups.agg(F.max("group")).first()[0] or 0) + 1
    # every block meets every group: rows are copied once per group, queries once per block
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_groups - 1).cast("bigint"))))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        asking = frame["asking"].to_numpy(bool)
        held, queries = frame[~asking], frame[asking]
        if not len(held) or not len(queries):
            return pd.DataFrame({"_row": [], "query_id": [], "vec_id": [], "score": []})
        ids, names, query_rows = held["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["_row"].to_numpy()
        found = nearest_in_block(np.stack(held["vector"].to_list()), ids, held["_row"].to_numpy(), np.stack(queries["vector"].to_list()), query_rows, k)
        return pd.DataFrame({
            "_row": np.concatenate([np.full(len(p), query_rows[q]) for q, p, _ in found]), "query_id": np.concatenate([np.full(len(p), names[q]) for q, p, _ in found]),
            "vec_id": np.concatenate([ids[p] for _, p, _ in found]), "score": np.concatenate([s for _, _, s in found]),
        })

    columns = ["block", "group", "asking", "_row", "vec_id", "vector"]
    met = left.select(columns).union(right.select(columns)).groupBy("block", "group").applyInPandas(meet, "_row long, query_id long, vec_id long, score double")
    first = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")  # at most k rows per block
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
