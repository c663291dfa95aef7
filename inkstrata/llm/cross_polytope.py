"""Approximate nearest neighbours by cross-polytope hashing, multiprobe and an exact reranking.

A pseudo-rotation is three rounds of seeded signs and a fast Hadamard transform. A unit vector's cell in a table is the signed axis nearest to its
rotation; while cells would hold more than CELL_ROWS vectors, a further polytope of as few dimensions as needed refines them. Each of
TABLES tables holds every vector, in chunks packed by cell with whole vectors, so that a candidate's distance needs no further
join. Queries, packed by cell too, meet the chunks of the cells that they probe by an equi-join; a task keeps each query's k nearest and emits only those.

A query probes its FIRST_PROBES likeliest cells of each table. Its kth distance so far tells how near the true neighbours must be: SIMULATED random
vectors at that distance are hashed, and as many further cells are probed, likeliest first, as find RECALL of them. A query for which that
is as much work as reading everything reads all cells of one table, which is exact; so does one with fewer than k candidates so far. The rule is the same at every
size: small or scattered tables are nearly scanned, large ones are not.

A cell of more than SPLIT_ROWS vectors, and more than one in HOT_CELLS, is split by a salt; only its queries are copied, once per salt.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Shorter
vectors count as padded with zeros. Rows with equal ids are separate candidates, but none of them answers a query with that id; query rows that share
an id are one query, and a candidate counts once, by its least distance to any of their vectors. Fewer candidates than k give
fewer rows. Scores are Euclidean distances of the original vectors in doubles, ties go to the smaller id. Only the id and the vector are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._util import discarded, stored, stored_at

TABLES, CELL_ROWS, FIRST_PROBES = 8, 256, 3
#: Random vectors at a query's kth distance, and the share of them that its probes must find.
SIMULATED, RECALL = 128, 0.96
#: Likeliest cells of a table that are ranked; a query that needs more reads all cells of one table.
RANKED = 4_096
#: Vectors of a chunk; vectors from which a cell may be split; cells above one in so many of all rows are.
CHUNK, SPLIT_ROWS, HOT_CELLS = 1_024, 4_096, 1_000
#: Vectors that a task holds before it packs them.
HELD = 8_192
HIT = "query_id bigint, row bigint, vec_id bigint, score double"


def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; float components stay floats."""
    kind = rows.schema[vec_col].dataType.elementType
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    ok = F.col(id_col).isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0)
    v = x if isinstance(kind, FloatType) else F.transform(x, lambda e: e.cast("double"))
    return rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    x, h = x.copy(), 1
    while h < width:
        pair = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


class Hasher:
    """Cells of unit vectors in several tables. shape: the dimensions of each polytope of a cell."""

    def __init__(self, width: int, shape: list[int], tables: int, seed: int = 13):
        self.width, self.shape, self.tables = width, shape, tables
        self.signs = np.random.default_rng(seed).choice((-1.0, 1.0), (tables, len(shape), 3, width))
        self.cells = math.prod(2 * d for d in shape)

    def rotated(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        out = []
        for d, signs in zip(self.shape, self.signs[table], strict=True):
            y = unit
            for s in signs:
                y = hadamard(y * s)
            out.append(y[:, :d])
        return out

    def cell(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The number of each vector's cell: its polytopes' signed axes as digits."""
        number = np.zeros(len(unit), np.int64)
        for y in self.rotated(unit, table):
            axis = np.abs(y).argmax(1)
            number = number * (2 * y.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return number

    def likeliest(self, rotated: list[np.ndarray], n: int) -> np.ndarray:
        """The n cells, likeliest first, of one vector by its rotations: those with the largest sums of signed components."""
        total, number = np.zeros(1), np.zeros(1, np.int64)
        for y in rotated:
            digit = np.stack((y, -y), 1).ravel()  # 2 * axis + sign
            total = (total[:, None] + digit).ravel()
            number = (number[:, None] * len(digit) + np.arange(len(digit))).ravel()
            if len(total) > n:
                best = np.argpartition(-total, n - 1)[:n]
                total, number = total[best], number[best]
        return number[np.argsort(-total, kind="stable")]


def cell_shape(n_rows: int, width: int) -> list[int]:
    """Polytopes for so many rows: a whole one, and further ones, the last as small as needed, until cells hold about CELL_ROWS."""
    shape, cells = [width], 2 * width
    while n_rows > cells * CELL_ROWS:
        more = 1 << math.ceil(math.log2(n_rows / (cells * CELL_ROWS)))
        shape.append(max(1, min(width, more // 2)))
        cells *= 2 * shape[-1]
    return shape


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles of one width."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width).astype(float)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def units(points: np.ndarray) -> np.ndarray:
    points = points / np.abs(points).max(1, keepdims=True)  # neither squares of small nor of large components leave the doubles' range
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _chunks(keys: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The positions of each key, at most so many at once."""
    order = np.argsort(keys, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        for at in range(0, len(group), most):
            yield group[at : at + most]


class Index:
    """How vectors of one table are hashed and packed. kind: the components' type in packed vectors."""

    FIELDS = [("table", pa.int32()), ("cell", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())]
    SCHEMA = "table int, cell bigint, n bigint, ids binary, rows binary, vectors binary"

    def __init__(self, width: int, n_rows: int, kind: str, tables: int):
        self.pad = max(2, 1 << math.ceil(math.log2(max(width, 1))))
        self.width, self.kind = width, kind
        self.hasher = Hasher(self.pad, cell_shape(n_rows, self.pad), tables)

    def hashable(self, points: np.ndarray) -> np.ndarray:
        return np.pad(units(points), ((0, 0), (0, self.pad - self.width)))

    def held(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, row numbers and vectors, HELD rows and more at once; a batch is bounded by the session."""
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), padded(batch.column(2), self.width)))
            if sum(len(k[0]) for k in kept) >= HELD:
                yield tuple(map(np.concatenate, zip(*kept, strict=True)))
                kept = []
        if kept:
            yield tuple(map(np.concatenate, zip(*kept, strict=True)))

    def census(self, base: DataFrame) -> DataFrame:
        """(table, cell, n): how many vectors a cell holds."""
        fields = pa.schema(self.FIELDS[:3])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, points in self.held(batches):
                unit = self.hashable(points)
                for table in range(self.hasher.tables):
                    cell, n = np.unique(self.hasher.cell(unit, table), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), table, np.int32)), pa.array(cell), pa.array(n.astype(np.int64))], schema=fields)

        return base.select("vec_id", "row", "v").mapInArrow(run, "table int, cell bigint, n bigint").groupBy("table", "cell").agg(F.sum("n").alias("n"))

    def packed(self, base: DataFrame) -> DataFrame:
        """Every vector in each table, packed by cell within a task."""
        fields = pa.schema(self.FIELDS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, rows, points in self.held(batches):
                unit = self.hashable(points)
                for table in range(self.hasher.tables):
                    cell = self.hasher.cell(unit, table)
                    groups = list(_chunks(cell, CHUNK))
                    columns = [[table] * len(groups), [int(cell[g[0]]) for g in groups], [len(g) for g in groups]]
                    columns += [[x[g].tobytes() for g in groups] for x in (ids, rows, points.astype(self.kind))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        return base.select("vec_id", "row", "v").mapInArrow(run, self.SCHEMA)

    def first_probes(self, queries: DataFrame) -> DataFrame:
        """(table, cell, query vectors packed): the likeliest cells of every query."""

        def cells(ids: np.ndarray, points: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            unit = self.hashable(points)
            for table in range(self.hasher.tables):
                rotated = self.hasher.rotated(unit, table)
                likeliest = np.stack([self.hasher.likeliest([y[i] for y in rotated], FIRST_PROBES) for i in range(len(points))])
                yield table, np.repeat(np.arange(len(points)), likeliest.shape[1]), likeliest.ravel()

        return self._asked(queries, cells)

    def further_probes(self, queries: DataFrame, norms: list[float]) -> DataFrame:
        """As first_probes(), of the cells that queries still need by their kth distance so far (kth; infinite: unknown)."""
        noise = np.random.default_rng(17).standard_normal((SIMULATED, self.pad))
        sizes = np.array(norms)

        def cells(ids: np.ndarray, points: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            unit, radius, hasher = self.hashable(points), np.linalg.norm(points, axis=1), self.hasher
            rotated = [hasher.rotated(unit, t) for t in range(hasher.tables)]
            found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(hasher.tables)]
            for i, q in enumerate(unit):
                ranked = [hasher.likeliest([y[i] for y in r], RANKED) for r in rotated]
                need = self.needed(q, radius[i], kth[i], sizes, noise, ranked)
                if need * hasher.tables >= hasher.cells or need > len(ranked[0]):
                    done = ranked[0][:FIRST_PROBES]
                    found[0].append((i, np.setdiff1d(np.arange(hasher.cells), done)))
                else:
                    for t, r in enumerate(ranked):
                        found[t].append((i, r[FIRST_PROBES : int(need)]))
            for t, own in enumerate(found):
                if own:
                    yield t, np.repeat([i for i, _ in own], [len(c) for _, c in own]), np.concatenate([c for _, c in own])

        return self._asked(queries, cells)

    def needed(self, q: np.ndarray, radius: float, kth: float, sizes: np.ndarray, noise: np.ndarray, ranked: list[np.ndarray]) -> float:
        """How many likeliest cells of each table find RECALL of random vectors at distance kth of a query with that norm."""
        if not np.isfinite(kth):
            return math.inf
        near = sizes[np.abs(sizes - radius) <= kth]  # norms that a vector at this distance can have
        if len(near):
            size = near[np.linspace(0, len(near) - 1, len(noise)).round().astype(int)]
            cosine = (radius**2 + size**2 - kth**2) / (2 * radius * size)
        else:
            cosine = np.full(len(noise), math.sqrt(max(0.0, 1 - (kth / radius) ** 2)))
        cosine = np.clip(cosine, -1, 1)[:, None]
        aside = noise.copy()
        aside[:, self.width :] = 0
        aside -= np.outer(aside @ q, q)
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        drawn = cosine * q + np.sqrt(1 - cosine**2) * aside / np.where(length > 0, length, 1)
        least = np.full(len(noise), np.inf)
        for t, cells in enumerate(ranked):
            place = np.argsort(cells)
            at = np.searchsorted(cells[place], own := self.hasher.cell(drawn, t))
            at = np.minimum(at, len(cells) - 1)
            least = np.minimum(least, np.where(cells[place][at] == own, place[at], np.inf))
        return float(np.sort(least)[math.ceil(RECALL * len(noise)) - 1]) + 1

    def _asked(self, queries: DataFrame, cells) -> DataFrame:
        """queries: vec_id, row, v and kth, packed by the cells that cells() names."""
        fields = pa.schema([("table", pa.int32()), ("cell", pa.int64()), ("q_ids", pa.binary()), ("q_kth", pa.binary()), ("q_vectors", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    ids, points, kth = part.column(0).to_numpy(), padded(part.column(1), self.width), part.column(2).to_numpy()
                    packed = points.astype(self.kind)
                    for table, query, cell in cells(ids, points, kth):
                        groups = list(_chunks(cell, CHUNK))
                        columns = [[table] * len(groups), [int(cell[g[0]]) for g in groups], *([x[query[g]].tobytes() for g in groups] for x in (ids, kth, packed))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        return queries.select("vec_id", "v", "kth").mapInArrow(run, "table int, cell bigint, q_ids binary, q_kth binary, q_vectors binary")

    def searched(self, pairs: DataFrame, k: int) -> DataFrame:
        """pairs of a packed cell and packed queries -> HIT rows: the k nearest of each query in a task."""
        fields = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        width, kind = self.width, self.kind

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, dict[int, tuple[float, int]]] = {}
            bound: dict[int, float] = {}

            def hits() -> pa.RecordBatch:
                flat = [(q, row, vec, score) for q, own in best.items() for row, (score, vec) in own.items()]
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), fields, strict=True)], schema=fields)

            for batch in batches:
                for i in range(batch.num_rows):
                    ids, rows, raw, q_ids, q_kth, q_raw = (batch.column(j)[i].as_py() for j in range(6))
                    ids, rows, q_ids, q_kth = (np.frombuffer(x, t) for x, t in ((ids, np.int64), (rows, np.int64), (q_ids, np.int64), (q_kth, float)))
                    points = np.frombuffer(raw, kind).reshape(-1, width).astype(float)
                    asked = np.frombuffer(q_raw, kind).reshape(-1, width).astype(float)
                    size, q_size = (points * points).sum(1), (asked * asked).sum(1)
                    rough = size - 2 * asked @ points.T + q_size[:, None]
                    rough -= 1e-12 * (size + q_size[:, None])  # below the exact square, whatever rounding did
                    limits = np.array([min(bound.get(q, np.inf), kth) for q, kth in zip(q_ids.tolist(), q_kth.tolist(), strict=True)])
                    near = (rough <= (limits**2)[:, None]) & (q_ids[:, None] != ids)
                    for j in np.flatnonzero(near.any(1)):
                        met = np.flatnonzero(near[j])
                        if len(met) > k:  # nothing beyond the kth rough square, with its rounding, can be among the k nearest
                            cut = np.partition(rough[j, met], k - 1)[k - 1]
                            met = met[rough[j, met] <= cut + 4e-12 * (size[met] + q_size[j])]
                        step = points[met] - asked[j]
                        score = np.sqrt((step * step).sum(1))
                        q = int(q_ids[j])
                        own = best.setdefault(q, {})
                        for s, row, vec in zip(score.tolist(), rows[met].tolist(), ids[met].tolist(), strict=True):
                            if row not in own or s < own[row][0]:
                                own[row] = (s, vec)
                        if len(own) > k:
                            best[q] = own = dict(sorted(own.items(), key=lambda x: (*x[1], x[0]))[:k])
                        if len(own) == k:
                            bound[q] = max(s for s, _ in own.values())
                    if len(best) > 50_000:
                        yield hits()
                        best.clear()
                        bound.clear()
            if best:
                yield hits()

        names = ["ids", "rows", "vectors", "q_ids", "q_kth", "q_vectors"]
        return pairs.select(*names).mapInArrow(search, HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest per query; a task drops all but its own k before they are shuffled."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    once = hits.groupBy("query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: str, k: int = 10, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vectors_of(); is_query: SQL condition on vec_id that names the queries."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema["v"].dataType, ArrayType) and isinstance(vectors.schema["v"].dataType.elementType, FloatType) else "<f8"
    base, base_at = stored_at(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    about = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.percentile_approx(norm, [i / 64 for i in range(65)], 10_000).alias("norms")).first()
    if not about.n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = Index(about.width, about.n, kind, tables)
    # at most tables * HOT_CELLS rows, as a table's cells share its rows
    split = max(SPLIT_ROWS, -(-about.n // HOT_CELLS))
    hot = stored(index.census(base).where(F.col("n") > split).select("table", "cell", F.ceil(F.col("n") / split).cast("int").alias("salts")), "hot-cells")
    salts = F.coalesce(F.col("salts"), F.lit(1))
    chunks = index.packed(base).join(F.broadcast(hot), ["table", "cell"], "left").withColumn("salt", F.pmod(F.xxhash64("rows"), salts).cast("int"))
    cells, cells_at = stored_at(merged(chunks.drop("salts"), ["table", "cell", "salt"], Index.FIELDS[3:]), "cells")

    def met(asked: DataFrame) -> DataFrame:
        spread = asked.join(F.broadcast(hot), ["table", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        packs = merged(spread, ["table", "cell", "salt"], [("q_ids", pa.binary()), ("q_kth", pa.binary()), ("q_vectors", pa.binary())])
        return index.searched(cells.join(packs, ["table", "cell", "salt"]), k)

    queries = base.where(is_query)
    found, found_at = stored_at(_best(met(index.first_probes(queries.withColumn("kth", F.lit(float("inf"))))), k), "first-hits")
    kth = found.where(F.col("rank") == k).select("vec_id", "query_id", "score").select(F.col("query_id").alias("k_id"), F.col("score").alias("k_score"))
    known = queries.join(kth, F.col("vec_id") == F.col("k_id"), "left").withColumn("kth", F.coalesce("k_score", F.lit(float("inf"))))
    rest = met(index.further_probes(known, about.norms))
    both = found.select("query_id", "row", "vec_id", "score").unionByName(rest)
    answer = stored(_best(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    discarded(spark, base_at, cells_at, found_at)
    return answer


def merged(rows: DataFrame, keys: list[str], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Packed rows of equal keys put together, up to CHUNK vectors (the first packed column holds eight bytes a vector). Rows stream through sorted partitions."""
    names = [*keys, *(n for n, _ in fields)]
    schema = pa.schema([*(("table", pa.int32()), ("cell", pa.int64()), ("salt", pa.int32())), *fields])
    sql = "table int, cell bigint, salt int, " + ", ".join(f"{n} binary" for n, _ in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, out = None, [], 0, []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                own, packed = tuple(batch.column(j)[i].as_py() for j in range(3)), [batch.column(j)[i].as_py() for j in range(3, len(names))]
                n = len(packed[0]) // 8
                if parts and (own != key or size + n > CHUNK):
                    out.append((*key, *(b"".join(p) for p in zip(*parts, strict=True))))
                    parts, size = [], 0
                    if len(out) >= 16:
                        yield batch_of(out)
                        out = []
                key, size = own, size + n
                parts.append(packed)
        if parts:
            out.append((*key, *(b"".join(p) for p in zip(*parts, strict=True))))
        if out:
            yield batch_of(out)

    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).select(*names).mapInArrow(run, sql)
