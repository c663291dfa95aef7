"""Exact k-means by balls: a vector is compared only with the centroids that can be nearer than its own.

Vectors travel in blocks of packed integers with their clusters. In a round each block's members of a cluster form a ball around its
centroid. Only centroids nearer than twice the ball's radius are neighbours; sorted by distance they cut the ball into a stable core, whose
members stay, and annuli: a member at squared distance d from its centroid c meets the neighbours n with |c - n|^2 <= 4 d and no others, which
are strictly farther. A round reads and writes the blocks once, with each block's counts and sums; of these, k rows of sums per component
reach the driver, and the round before is deleted. Rounds end early once no centroid moves, which leaves the result as it is.

Starts are the k vectors whose ids hash lowest. Components become floor(scale * x), all arithmetic is on integers, and equal distances go to
the smaller number.

Defined results: vectors that are null, of another size, or hold null or non-finite components take no part; a null id counts as the empty text. Rows with
equal ids are separate vectors; as starts they stand in the order of their components. Fewer vectors than k give fewer
centroids. Empty clusters keep their centroid. Only the id and the vector are read. Integer components of 2**27 and more fail with a message, as squared distances
might pass 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discarded, stored_at

#: Vectors of a block at most.
BLOCK = 4_096
LIMIT = 1 << 27
STATE = "ids array<bigint>, width int, points binary, clusters binary, counts binary, sums binary, inertia binary"
STATE_FIELDS = [("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("points", pa.binary()), ("clusters", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary()), ("inertia", pa.binary())]


def kept_vectors(rows: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), x as double, for the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = (F.size(vec_col) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(key, "v").limit(k).collect()], np.int64)


def _narrow(points: np.ndarray) -> tuple[int, bytes]:
    """Integers in as few bytes as hold them all."""
    most = int(np.abs(points).max(initial=0))
    if most >= LIMIT:
        raise ValueError(f"components of {LIMIT} and more: squared distances might pass 64 bits")
    width = 2 if most < 1 << 15 else 4
    return width, points.astype(f"<i{width}").tobytes()


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors, all in cluster 0."""
    schema = pa.schema(STATE_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        points: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            width, raw = _narrow(np.concatenate(points))
            row = [ids, width, raw, bytes(len(ids)), b"", b"", b""]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(at, BLOCK // 4)
                if len(ids) + part.num_rows > BLOCK:
                    yield block()
                    ids, points = [], []
                ids += part.column(0).to_pylist()
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
        if ids:
            yield block()

    return vectors.mapInArrow(run, STATE)


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points; doubles where they hold every sum."""
    step = points - centroid
    if len(step) and step.shape[1] * float(np.abs(step).max(initial=0)) ** 2 < 2.0**53:
        step = step.astype(float)
    return np.einsum("ij,ij->i", step, step).astype(np.int64)


def reassigned(points: np.ndarray, own: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each point, its squared distance, and how many distances were computed. own: the clusters so far; between: squared distances of
    the centroids."""
    cluster, distance, work = own.copy(), np.zeros(len(own), np.int64), len(own)
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        ball = points[members]
        d = squared(ball, centroids[c])
        order = np.array([j for j in np.argsort(between[c], kind="stable") if j != c and between[c][j] <= 4 * int(d.max())], int)
        annulus = np.searchsorted(between[c][order], 4 * d, side="right")  # how many neighbours a member meets; 0: the stable core
        best, at = d.copy(), np.full(len(d), c)
        for rank, j in enumerate(order):
            met = np.flatnonzero(annulus > rank)
            other = squared(ball[met], centroids[j])
            work += len(met)
            nearer = (other < best[met]) | ((other == best[met]) & (j < at[met]))
            best[met[nearer]], at[met[nearer]] = other[nearer], j
        cluster[members], distance[members] = at, best
    return cluster, distance, work


def _round(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The blocks with every vector in its nearest cluster, and the blocks' counts, sums and inertia of each cluster."""
    schema = pa.schema(STATE_FIELDS)
    between = np.stack([squared(centroids, c) for c in centroids])
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, raw, own = (batch.column(j)[i].as_py() for j in (1, 2, 3))
                points = np.frombuffer(raw, f"<i{width}").reshape(-1, size).astype(np.int64)
                cluster, distance, _ = reassigned(points, np.frombuffer(own, np.uint8 if len(own) == len(points) else np.int32).astype(int), centroids, between)
                sums = np.zeros((k, size), np.int64)
                inertia = np.zeros(k, np.int64)
                for c in np.unique(cluster):
                    sums[c], inertia[c] = points[cluster == c].sum(0), distance[cluster == c].sum()
                packed = cluster.astype(np.uint8 if k <= 256 else np.int32).tobytes()
                new = [packed, np.bincount(cluster, minlength=k).astype(np.int64).tobytes(), sums.tobytes(), inertia.tobytes()]
                columns = [batch.column(j).slice(i, 1) for j in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in new)], schema=schema)

    return state.mapInArrow(run, STATE)


def _totals(state: DataFrame, name: str, k: int) -> np.ndarray:
    """The sum over all blocks of a column of packed numbers: a row per number reaches the driver."""
    out = pa.schema([("place", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), np.int64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], schema=out)

    rows = state.select(name).mapInArrow(run, "place bigint, value bigint").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(len(rows), np.int64)
    for r in rows:
        total[r.place] = r.value
    return total.reshape(k, -1)


def clustered(vectors: DataFrame, size: int, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. vectors: kept_vectors()."""
    spark = vectors.sparkSession
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], out)
    state, path = stored_at(_blocks(vectors, size), "balls")
    for i in range(rounds + 1):
        last, (state, new) = path, stored_at(_round(state, centroids), "balls")
        discarded(spark, last)
        path = new
        if i == rounds:
            break
        counts = _totals(state, "counts", k)
        sums = _totals(state, "sums", k)
        moved = np.where(counts > 0, sums // np.maximum(counts, 1), centroids)  # // is floor
        if (moved == centroids).all():
            break
        centroids = moved
    inertia = [int(x) for x in _totals(state, "inertia", k).ravel()]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, width, raw, own = (batch.column(j)[i].as_py() for j in range(4))
                points = np.frombuffer(raw, f"<i{width}").reshape(-1, size).astype(np.int64)
                cluster = np.frombuffer(own, np.uint8 if k <= 256 else np.int32).astype(int)
                distance = np.zeros(len(ids), np.int64)
                for c in np.unique(cluster):
                    distance[cluster == c] = squared(points[cluster == c], centroids[c])
                columns = [ids, cluster, distance, [inertia[c] for c in cluster], [sum(inertia)] * len(ids), [names[c] for c in cluster]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return state.select("ids", "width", "points", "clusters").mapInArrow(rows_of, out)
