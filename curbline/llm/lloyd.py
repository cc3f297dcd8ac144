"""Exact centroid clustering with heap-ordered bounds, in integers.

Vectors are kept in blocks of at most ``BLOCK`` rows. A block holds one heap per cluster. A vector's key is its gap, the
distance to the second nearest centroid less that to its own, plus what its cluster's heap had drifted when the key was
made. When centroids move, a heap's drift grows by the way of its own centroid and the longest way of any other; vectors
whose key is above the drift still have a gap and stay without being looked at. Only vectors whose gap has expired are
popped, compared with every centroid exactly, and pushed to the heap of the nearest (ties: the smaller number).

Distances are exact integers; bounds are floating-point numbers made smaller by more than their rounding error, so that a
doubtful vector is popped rather than kept. Per round, tasks turn written blocks into new blocks (with their sums), Spark
adds up the sums, and the driver gets one row per cluster: the number of clusters times the dimensions bounds what is
collected and broadcast, whatever the table's size.

Defined results: vectors that are null, of another length than ``dimensions``, or hold null or non-finite components take no
part; repeated rows are vectors of their own; rows without vec_id take part but start no cluster; fewer vectors than
clusters give fewer clusters; an empty cluster keeps its centroid; an empty table gives an empty result; other columns
are ignored. A component of 2 ** 27 or more after scaling raises an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.session import cut

BLOCK = 4096
_LARGEST = 1 << 27
_SLACK = 1e-6  # distances are below 2 ** 31, so their rounding error is below 2 ** -21
STATE = "vec_ids array<bigint>, width int, vectors binary, clusters binary, drift array<double>, heaps array<int>, keys binary, members binary, sums array<bigint>, popped bigint"


def kept_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id and ``vector``, floor(scale * x) per component as bigint, of the rows that take part."""
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    big = F.lit(float("inf"))
    sound = wide.where((F.size("_v") == dimensions) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < big) & (x > -big)))
    level = F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x))
    fits = F.forall("_v", lambda x: F.abs(x * F.lit(float(scale))) < _LARGEST)
    return sound.select("vec_id", F.when(fits, level).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("array<bigint>")).alias("vector"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose salted ids have the smallest hashes: k rows on the driver."""
    named = kept.where(F.col("vec_id").isNotNull()).select("vector", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("_h"))
    return np.array([r["vector"] for r in named.orderBy("_h", "vector").limit(k).collect()], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):  # a column at a time keeps the differences small
        difference = vectors - c
        out[:, j] = np.einsum("ij,ij->i", difference, difference)
    return out


def ways(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Per cluster: how far its own centroid moved, plus the farthest that any other did; never rounded down."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float)) * (1 + _SLACK)
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(len(moved))])
    return moved + others


class Block:
    """Vectors with their clusters and one heap of (key, position) per cluster."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k = vectors, k
        self.clusters = np.full(len(vectors), -1, np.int32)
        self.drift = [0.0] * k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        self.popped = 0

    def place(self, rows: np.ndarray, centroids: np.ndarray) -> list[tuple[int, float, int]]:
        """Compare ``rows`` with every centroid; (cluster, key, row) for the heaps."""
        exact = squared(self.vectors[rows], centroids)
        nearest = exact.argmin(axis=1)  # the first of equals
        at = np.arange(len(rows))
        own = np.sqrt(exact[at, nearest].astype(float))
        exact[at, nearest] = np.iinfo(np.int64).max
        gap = np.sqrt(exact.min(axis=1).astype(float)) - own
        self.clusters[rows] = nearest
        self.popped += len(rows)
        return [(j, g + self.drift[j] - _SLACK * (1 + abs(g) + self.drift[j]), i) for j, g, i in zip(nearest.tolist(), gap.tolist(), rows.tolist())]

    def start(self, centroids: np.ndarray) -> None:
        for j, key, i in self.place(np.arange(len(self.vectors)), centroids):
            self.heaps[j].append((key, i))
        for heap in self.heaps:
            heapify(heap)

    def move(self, centroids: np.ndarray, way: np.ndarray) -> None:
        expired: list[int] = []
        for j, heap in enumerate(self.heaps):
            self.drift[j] += float(way[j])
            while heap and heap[0][0] <= self.drift[j]:
                expired.append(heappop(heap)[1])
        for j, key, i in self.place(np.array(expired, np.int64), centroids) if expired else []:
            heappush(self.heaps[j], (key, i))

    def sums(self) -> np.ndarray:
        """Per cluster the sum of each component, and the count."""
        out = np.zeros((self.k, self.vectors.shape[1] + 1), np.int64)
        np.add.at(out[:, :-1], self.clusters, self.vectors)
        out[:, -1] = np.bincount(self.clusters, minlength=self.k)
        return out


def _stored(ids: list, block: Block) -> dict:
    small = np.abs(block.vectors).max(initial=0) < 1 << 15
    pairs = [x for heap in block.heaps for x in heap]
    return {
        "vec_ids": ids, "width": 2 if small else 4, "vectors": block.vectors.astype("<i2" if small else "<i4").tobytes(), "clusters": block.clusters.astype("<i4").tobytes(), "drift": block.drift,
        "heaps": [len(h) for h in block.heaps], "keys": np.array([p[0] for p in pairs], "<f8").tobytes(), "members": np.array([p[1] for p in pairs], "<i4").tobytes(),
        "sums": block.sums().ravel().tolist(), "popped": block.popped,
    }


def _loaded(row: dict, k: int, dimensions: int) -> Block:
    block = Block(np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dimensions).astype(np.int64), k)
    block.clusters, block.drift = np.frombuffer(row["clusters"], "<i4").copy(), list(row["drift"])
    keys, members, at = np.frombuffer(row["keys"], "<f8").tolist(), np.frombuffer(row["members"], "<i4").tolist(), 0
    for j, n in enumerate(row["heaps"]):  # heaps are stored as they lie, and stay heaps
        block.heaps[j] = list(zip(keys[at : at + n], members[at : at + n]))
        at += n
    return block


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _state_schema() -> pa.Schema:
    return pa.schema([
        ("vec_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("vectors", pa.binary()), ("clusters", pa.binary()), ("drift", pa.list_(pa.float64())), ("heaps", pa.list_(pa.int32())),
        ("keys", pa.binary()), ("members", pa.binary()), ("sums", pa.list_(pa.int64())), ("popped", pa.int64()),
    ])


def started(kept: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors, each assigned to its nearest centroid, with their heaps."""
    k, dimensions = centroids.shape

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            made = Block(np.concatenate([v for _, v in held]), k)
            made.start(centroids)
            ids = [i for part, _ in held for i in part.to_pylist()]
            held.clear()
            return _batch([_stored(ids, made)], _state_schema())

        n = 0
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            for at in range(0, len(flat), block):
                part = flat[at : at + block]
                if n + len(part) > block:
                    yield closed()
                    n = 0
                held.append((batch.column("vec_id").slice(at, block), part))
                n += len(part)
        if held:
            yield closed()

    return kept.select(F.col("vec_id").cast("bigint"), "vector").mapInArrow(build, STATE)


def moved(state: DataFrame, centroids: np.ndarray, way: np.ndarray) -> DataFrame:
    """The blocks after their centroids moved by ``way``."""
    k, dimensions = centroids.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _loaded(row, k, dimensions)
                block.move(centroids, way)
                yield _batch([_stored(row["vec_ids"], block)], _state_schema())

    return state.mapInArrow(step, STATE)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def members(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and exact squared distance to its centroid, a row per vector."""
    dimensions = centroids.shape[1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, dimensions).astype(np.int64)
                clusters = np.frombuffer(row["clusters"], "<i4")
                away = vectors - centroids[clusters]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(clusters, pa.int32()), pa.array(np.einsum("ij,ij->i", away, away))], ["vec_id", "cluster", "distance"])

    return state.select("vec_ids", "width", "vectors", "clusters").mapInArrow(spread, "vec_id bigint, cluster int, distance bigint")


def new_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) per component, exactly; empty clusters keep theirs. One row per number comes to the driver."""
    k, dimensions = old.shape
    totals = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = [0] * (k * (dimensions + 1))
    for r in totals:
        flat[r["at"]] = r["x"]
    out = old.copy()
    for j in range(k):
        *sums, n = flat[j * (dimensions + 1) : (j + 1) * (dimensions + 1)]
        if n:
            out[j] = [s // n for s in sums]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, salt: str = "1:", block: int = BLOCK) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Members (vec_id, cluster, distance), the final centroids, and the last blocks (with ``popped``, the vectors compared in the last round)."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions, scale)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.empty((0, dimensions), np.int64), spark.createDataFrame([], STATE)
    state = cut(started(kept, centroids, block))
    for _ in range(rounds):
        nearer = new_centroids(state, centroids)
        state, centroids = cut(moved(state, nearer, ways(centroids, nearer))), nearer
    return members(state, centroids), centroids, state


def report(vectors: DataFrame, **options) -> DataFrame:
    """Members with cluster_inertia, inertia and centroid_sha256."""
    found, centroids, _ = cluster(vectors, **options)
    found = cut(found)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row per cluster
    facts = [(j, sums.get(j, 0), sum(sums.values()), centroid_digest(c)) for j, c in enumerate(centroids)]
    table = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def check_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, salt: str = "1:") -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT v.id, v.vec_id, v.vector, c.cluster, list_sum(list_transform(list_zip(v.vector, c.centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM vectors v, c{r} c),
a{r} AS (SELECT id, any_value(vec_id) AS vec_id, any_value(vector) AS vector, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(vector) AS x, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS centroid FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.centroid, c.centroid) AS centroid FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH kept AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
vectors AS (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda x: floor({scale} * x)::BIGINT) AS vector FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY h, vector)::INTEGER - 1 AS cluster, vector AS centroid FROM (SELECT vector, sha256('{salt}' || vec_id) AS h FROM vectors WHERE vec_id IS NOT NULL ORDER BY h, vector LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c.centroid, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""
