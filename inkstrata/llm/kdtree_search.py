"""Exact top-k by inner product: a KD-tree per shard, searched best first, with the kth score passed on between shards.

Median splits of a bounded sample cut space into at most CELLS cells; a cell's vectors are dealt to shards of about SHARD_ROWS rows by
their row's number. A pair of a query block and a shard is a row, and pairs are dealt by cell, shard and groups of BLOCKS_A_TASK blocks: a cell, however many
vectors fall into it, is never a task. A shard's tree splits at the median of its widest dimension down to
leaves of LEAF rows; every node keeps its tight bounding box. The bound of a query and a box is the sum over
dimensions of the larger of query*low and query*high: no vector in the box scores more. A queue visits nodes by falling bound and
stops when the bound is below the kth score so far. Queries, in blocks of QUERY_BLOCK of one cell, first search that cell's shards. The
kth scores found there and the cells' boxes, a table of at most CELLS rows, decide which further cells a block must meet; what no
query's bound reaches is never joined. Where all vectors fit one shard, or one cell, there is nothing further to meet and no pass for it. Queries and shards travel as rows of packed arrays.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as queries or candidates.
Shorter vectors count as padded with zeros. A null id takes no part. Rows with equal ids are separate candidates, but none of
them answers a query with that id. Query rows that share an id are one query: a candidate counts once, by its best score
for any of their vectors. Fewer candidates than k give fewer rows. Only the id and the vector are read.
Scores are computed in doubles; where dimension times the largest components of both sides reaches 2**53 they might not be exact, and
the search fails with that message. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import arrow_batch, arrow_rows, stored

LEAF = 256
SHARD_ROWS = 4_096
QUERY_BLOCK = 512
#: A bounded sample of vectors whose median splits make at most CELLS cells of space.
SAMPLE_ROWS, CELLS = 20_000, 256
#: Query blocks that meet a shard in one task; of more, groups do, each with a copy of the shard.
BLOCKS_A_TASK = 64
HIT = "query_id bigint, row bigint, vec_id bigint, score bigint"


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x), x as double, for the rows that take part."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


class Tree:
    """Arrays of a KD-tree: ids and points in leaf order, and per node its span, children, box and smallest id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order, nodes = np.arange(len(ids)), []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = order[a:b]
            box = points[own]
            low, high = box.min(0), box.max(0)
            me = len(nodes)
            nodes.append([a, b, -1, -1, low, high])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if b - a > leaf and (high > low).any():
                dim, mid = int(np.argmax(high - low)), (b - a) // 2
                order[a:b] = own[np.argpartition(box[:, dim], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.ids, self.points = ids[order], points[order]
        self.span = np.array([n[:4] for n in nodes], np.int64)
        self.low, self.high = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])

    def search(self, q: np.ndarray, own: int, k: int, floor: float, bounds: np.ndarray) -> list[tuple[float, int, int]]:
        """The k best (score, id, row) with score >= floor. bounds: of q and each node's box."""
        best: list[tuple[float, int, int]] = []
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < (best[0][0] if len(best) == k else floor):
                break
            a, b, left, right = self.span[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            score = self.points[a:b] @ q
            least = best[0][0] if len(best) == k else floor
            for i in np.nonzero((score >= least) & (self.ids[a:b, 0] != own))[0]:
                hit = (float(score[i]), -int(self.ids[a + i, 0]), -int(self.ids[a + i, 1]))
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return [(s, -x, -r) for s, x, r in best]


def _points(flat: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(flat), dim))
    for row, v in zip(out, flat, strict=True):
        row[: len(v)] = v
    return out


Splits = list[tuple[int, float, int, int]]


def median_splits(points: np.ndarray, cells: int) -> Splits:
    """A KD-tree over a sample, as nodes (dimension, border, low child, high child); a child below 0 is cell -1 - child."""
    nodes: Splits = []
    n_cells = 0

    def grow(own: np.ndarray, share: int) -> int:
        nonlocal n_cells
        spread = own.max(0) - own.min(0) if len(own) else np.zeros(1)
        dim = int(np.argmax(spread))
        if share < 2 or spread[dim] <= 0:
            n_cells += 1
            return -n_cells
        border = float(np.median(own[:, dim]))
        high = own[:, dim] >= border
        if high.all():  # the median is the least value
            high = own[:, dim] > border
            border = float(own[high, dim].min())
        me = len(nodes)
        nodes.append((dim, border, 0, 0))
        low = grow(own[~high], share // 2)
        nodes[me] = (dim, border, low, grow(own[high], share - share // 2))
        return me

    grow(points, cells)
    return nodes


def cells_of(points: np.ndarray, splits: Splits) -> np.ndarray:
    out = np.full(len(points), -1 if not splits else 0, np.int64)
    for me, (dim, border, low, high) in enumerate(splits):  # parents stand before their children
        here = np.flatnonzero(out == me)
        out[here] = np.where(points[here, dim] >= border, high, low)
    return -1 - out


def _placed(vectors: DataFrame, splits: Splits, dim: int) -> DataFrame:
    """vectors with the cell of each, and a number of its row."""
    schema = pa.schema([("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points([np.array(v, float)[:dim] for v in batch.column(batch.schema.get_field_index("v")).to_pylist()], dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(points, splits), schema.field(0).type)], names=[*batch.schema.names, "cell"])

    # numbers of rows in partitions, which keep shards bounded even where ids repeat
    return vectors.mapInArrow(run, "vec_id bigint, v array<bigint>, cell bigint").withColumn("row", F.monotonically_increasing_id())


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row per (cell, key): its rows' numbers, ids and vectors as binaries, and their box. A key has a bounded number of rows, by
    the choice of the number of keys."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        dim = max(map(len, group["v"]))
        group = group.sort_values(["vec_id", "row"], kind="stable")
        points = _points(list(group["v"]), dim)
        ids = {n: [group[n].to_numpy(np.int64).tobytes()] for n in ("row", "vec_id")}
        # what a shorter vector lacks counts as zeros, so boxes of different length are padded with zeros as well
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], key: [group[key].iloc[0]], "rows": ids["row"], "ids": ids["vec_id"], "points": [points.tobytes()], "low": [points.min(0).tobytes()], "high": [points.max(0).tobytes()], "dim": [dim]})

    return rows.groupBy("cell", key).applyInPandas(pack, f"cell bigint, {key} bigint, rows binary, ids binary, points binary, low binary, high binary, dim bigint")


def _by_cell(counts: dict[int, int], cell: str = "cell") -> Column:
    return F.create_map(*[F.lit(x).cast("long") for pair in (counts or {0: 1}).items() for x in pair])[F.col(cell)]


def _counts(rows: DataFrame, size: int) -> dict[int, int]:
    """How many shards (or blocks) of about size rows each cell has: at most CELLS rows reach the driver."""
    return {r.cell: -(-r.n // size) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _dealt(rows: DataFrame, key: str, counts: dict[int, int]) -> DataFrame:
    """rows with the number of their shard (or block) in their cell."""
    return rows.withColumn(key, F.pmod(F.xxhash64("row"), _by_cell(counts)))


def _met(asked: DataFrame, to: str, shards: DataFrame, per_cell: dict[int, int], n_blocks: int) -> DataFrame:
    """A row per asked block (home, block, its queries) and shard of the cell named by to, with both sides' columns."""
    groups = max(1, -(-n_blocks // BLOCKS_A_TASK))
    each = asked.withColumn("to_shard", F.explode(F.sequence(F.lit(0).cast("long"), _by_cell(per_cell, to) - 1))).withColumn("group", F.pmod(F.xxhash64("home", "block"), F.lit(groups)))
    copied = shards.withColumn("to_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return each.join(copied, (F.col(to) == F.col("cell")) & (F.col("to_shard") == F.col("shard")) & (F.col("group") == F.col("to_group")))


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: a query block's columns (q_), floors (kth scores, where known), a shard's columns -> HIT rows."""
    out = pa.schema([(n, pa.int64()) for n in ("query_id", "row", "vec_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                dim = max(row["dim"], row["q_dim"])
                if (row["cell"], row["shard"], dim) != last:
                    own = np.frombuffer(row["points"]).reshape(-1, row["dim"])
                    ids = np.stack((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)), 1)
                    tree, last = Tree(ids, np.pad(own, ((0, 0), (0, dim - row["dim"])))), (row["cell"], row["shard"], dim)
                q = np.pad(np.frombuffer(row["q_points"]).reshape(-1, row["q_dim"]), ((0, 0), (0, dim - row["q_dim"])))
                if dim * np.abs(q).max() * max(np.abs(tree.low).max(), np.abs(tree.high).max()) >= 2.0**53:
                    raise ValueError("components too large: scores would not be exact")
                q_ids, floors = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["floors"]) if row["floors"] else np.full(len(q), -np.inf)
                bounds = np.maximum(q, 0) @ tree.high.T + np.minimum(q, 0) @ tree.low.T
                hits = [(int(q_ids[j]), r, x, int(s)) for j in range(len(q_ids)) for s, x, r in tree.search(q[j], int(q_ids[j]), k, floors[j], bounds[j])]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], schema=out)

    return pairs.mapInArrow(search, HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows per query; a task drops all but its own k best before they are shuffled. Each row counts once, by its best score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("row"))
    once = hits.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_floors(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """blocks with the kth score that each of their queries has so far, in their order (floors: packed doubles)."""
    kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("k_id"), "kth")
    ids = pa.schema([("b_cell", pa.int64()), ("b_block", pa.int64()), ("place", pa.int64()), ("q_id", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, raw in arrow_rows(batch, "cell", "block", "q_ids"):
                q = np.frombuffer(raw, np.int64)
                yield arrow_batch(ids, [np.full(len(q), cell), np.full(len(q), block), np.arange(len(q)), q])

    each = blocks.select("cell", "block", "q_ids").mapInArrow(unpack, "b_cell bigint, b_block bigint, place bigint, q_id bigint")
    each = each.join(kth, F.col("q_id") == F.col("k_id"), "left").groupBy("b_cell", "b_block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("kth")))).alias("kths"))
    return blocks.join(each, (F.col("cell") == F.col("b_cell")) & (F.col("block") == F.col("b_block"))).drop("b_cell", "b_block").withColumn("kths", F.col("kths.kth"))


def _near(blocks: DataFrame, boxes: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """A row per block and cell whose box may hold a vector that one of its queries still needs (cells: searched already)."""
    names = ["cell", "block", "q_points", "q_dim"]
    out = pa.schema([("home", pa.int64()), ("home_block", pa.int64()), ("floors", pa.binary()), ("to_cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, block, q_points, q_dim, kths in arrow_rows(batch, *names, "kths"):
                floors = np.array(kths)
                q = np.frombuffer(q_points).reshape(-1, q_dim)
                for to, low, high in boxes:
                    n = min(len(low), q_dim)  # beyond it one of both is zero
                    part = q[:, :n]
                    bound = np.maximum(part, 0) @ high[:n] + np.minimum(part, 0) @ low[:n]
                    if to != cell and (bound >= floors).any():
                        yield arrow_batch(out, [[x] for x in (cell, block, floors.tobytes(), to)])

    return blocks.select(*names, "kths").mapInArrow(run, "home bigint, home_block bigint, floors binary, to_cell bigint")


def _boxes(shards: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The box of every cell, from its shards' boxes: at most CELLS rows and two vectors each."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        dim = max(rows["dim"])
        wide = lambda name: np.stack([np.pad(np.frombuffer(x), (0, dim - len(x) // 8)) for x in rows[name]])
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "low": [wide("low").min(0).tobytes()], "high": [wide("high").max(0).tobytes()]})

    rows = shards.select("cell", "low", "high", "dim").groupBy("cell").applyInPandas(merge, "cell bigint, low binary, high binary").collect()
    return [(r.cell, np.frombuffer(bytes(r.low)), np.frombuffer(bytes(r.high))) for r in rows]


def planned(vectors: DataFrame, is_query: str, k: int, shard_rows: int, query_block: int, cells: int) -> tuple[DataFrame, DataFrame | None]:
    """The hits of each query in its own cell, and the pairs of query blocks and shards of further cells that must still meet (none: there are no further cells)."""
    plain = stored(vectors, "vectors")
    n_rows = plain.count()
    splits: Splits = []
    if n_rows > shard_rows:
        rate = min(1.0, SAMPLE_ROWS / n_rows)
        drawn = plain.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("v").limit(2 * SAMPLE_ROWS).collect()
        dim = max((len(r.v) for r in drawn), default=1)
        sample = _points([np.array(r.v, float) for r in drawn], dim)
        splits = median_splits(sample, max(1, min(cells, -(-n_rows // shard_rows)))) if len(sample) else []
    if splits:
        base = stored(_placed(plain, splits, dim), "vector-cells")
    else:
        base = plain.withColumn("cell", F.lit(0).cast("long")).withColumn("row", F.monotonically_increasing_id())
    per_cell = _counts(base, shard_rows)
    queries = base.where(is_query)
    blocks_of = _counts(queries, query_block)
    n_blocks = sum(blocks_of.values())
    shards = _packed(_dealt(base, "shard", per_cell), "shard")
    blocks = _packed(_dealt(queries, "block", blocks_of), "block").select("cell", "block", F.col("ids").alias("q_ids"), F.col("points").alias("q_points"), F.col("dim").alias("q_dim"))
    if splits:
        shards, blocks = stored(shards, "shards"), stored(blocks, "query-blocks")
    first = blocks.withColumnRenamed("cell", "home").withColumn("floors", F.lit(None).cast("binary"))
    found = _best(_searched(_met(first, "home", shards, per_cell, n_blocks), k), k)
    if not splits:
        return found, None
    found = stored(found, "first-hits")
    near = stored(_near(_with_floors(blocks, found, k), _boxes(shards)), "near-pairs")
    asked = near.join(blocks.withColumnRenamed("cell", "b_cell"), (F.col("home") == F.col("b_cell")) & (F.col("home_block") == F.col("block"))).drop("b_cell", "home_block")
    return found, _met(asked, "to_cell", shards, per_cell, n_blocks)


def top_k(vectors: DataFrame, is_query: str, k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: integer_vectors(); is_query: SQL condition on vec_id that names the queries."""
    found, pairs = planned(vectors, is_query, k, shard_rows, query_block, cells)
    if pairs is not None:
        found = _best(found.select("query_id", "row", "vec_id", "score").unionByName(_searched(pairs, k)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
