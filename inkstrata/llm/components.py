"""Connected components of an edge table by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the least node it knows; nothing but the answer whether
all are stars reaches the driver, each half round's edges are a written table, and a hot node costs one partial aggregate and a
broadcast row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discarded, stored_at


#: Keys with more than this share of a side's rows are joined without a shuffle: there are fewer of them than this number.
HOT_KEYS = 2000


def joined_to_one(rows: DataFrame, key: str, one: DataFrame, n_rows: int) -> DataFrame:
    """rows joined with one (c, n, and what is asked for), which has a row per key: c, and n, how many of at most n_rows rows share it.

    A key of more than n_rows / HOT_KEYS rows would fill a task by itself. Those are fewer than HOT_KEYS keys, which are broadcast.
    """
    hot = F.col("n") * HOT_KEYS > n_rows
    large, other = one.where(hot).drop("n"), one.where(~hot).drop("n")
    at_once = rows.join(F.broadcast(large), F.col(key) == F.col("c"))
    rest = rows.join(F.broadcast(large.select("c")), F.col(key) == F.col("c"), "left_anti")
    return at_once.unionByName(rest.join(other, F.col(key) == F.col("c")))


def _linked(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over stored pairs (u, v)."""
    if larger:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "n")
        return joined_to_one(both.where("v > u"), "u", least, 2 * pairs.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), "m", "n")
    joined = joined_to_one(down, "u", least, pairs.count())
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node is either a centre or has a single edge, to a centre."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    by_node = ends.groupBy("node").agg(F.sum("out").alias("n_out"), F.min("out").alias("least"))
    return by_node.where("n_out > 1 or (n_out = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two nodes; root is the least node of its component. Ids are longs."""
    pairs, at = stored_at(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(pairs):
        large, large_at = stored_at(_linked(pairs, larger=True).where("u <> v").distinct(), "stars")
        pairs, new_at = stored_at(_linked(large, larger=False).where("u <> v").distinct(), "stars")
        discarded(edges.sparkSession, at, large_at)  # a round reads only the one before it
        at = new_at
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
