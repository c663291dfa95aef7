"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight. A source stops at ``max_epochs`` times its size; what it can't take is shared out again by
weight among the others until none is above its cap. A source then gives whole repetitions of all its documents and a seeded
fraction of one more: documents in the order of a keyed digest, until the words of the fraction are used up. The document
at the edge gives the first words of its text.

Defined results: a null or wordless text has size 0 and gives nothing. Null sources form one source, ranked last. Rows that
repeat id, source and size share a key and get equal amounts. An empty table gives an empty result. A ``total`` over what
all caps allow leaves every source at its cap. Other columns pass through ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import GAP, passing, stored

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the key by which the search for a source's edge first narrows down: 16 to this power groups a source.
DIGITS = 3


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


def draw_key(doc_id: Column, size: Column, seed: str) -> Column:
    """The place of a document in its source's seeded order."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return base.withColumn("key", draw_key(F.col("doc_id"), F.col("size"), seed))


def targets(sizes: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources are ranked by range partitions: a place in its partition and the number of rows in those before. Each round of the
    filling is one aggregate of the sources' table, of which a few numbers reach the driver.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order, place = F.col("source").asc_nulls_last(), F.monotonically_increasing_id()
    total = total.repartitionByRange(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    total = stored(total.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "source-ranks")
    before = dict(total.groupBy("part").count().collect())  # a row per partition
    starts = [(p, sum(n for q, n in before.items() if q < p)) for p in before] or [(0, 0)]
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts for x in pair])[F.col("part")]
    rank = start + F.col("place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    table = stored(total.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "sources")
    level, before = 0.0, -1
    want = float(table.agg(F.sum("source_size")).first()[0] or 0) * budget
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        row = table.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if row[2] == before or not row[1]:
            break
        before, level = row[2], (want - row[0]) / row[1]
    share = F.lit(level) * F.col("weight")
    return table.select("source", "source_size", "weight", F.when(share > F.col("cap"), F.col("cap")).otherwise(share).alias("target"))


def plan_mix(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: whole repetitions, and the edge of the fraction (edge_key, and the words each row at it gives).

    Words are first summed by the leading digits of the key; only the group that holds a source's edge is then put in order.
    """
    t, s = F.col("target"), F.col("source_size")
    whole = F.when(s > 0, F.floor(t / s)).otherwise(F.lit(0)).cast("long")
    src = sources.withColumn("whole", whole).withColumn("rest", F.floor(t - F.col("whole") * s + 0.5).cast("long"))
    # a fraction that rounds to all words is one more repetition; the target is at most max_epochs times s, so that is, too
    full = (s > 0) & (F.col("rest") >= s)
    src = src.withColumn("whole", F.when(full, F.col("whole") + 1).otherwise(F.col("whole"))).withColumn("rest", F.when(full, 0).otherwise(F.col("rest")).cast("long"))
    head = F.substring("key", 1, DIGITS).alias("head")
    groups = sizes.groupBy("source", head).agg(F.sum("size").alias("words"))
    sum_before = F.sum("words").over(Window.partitionBy("source").orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("before", F.coalesce(sum_before, F.lit(0)))
    same = groups["source"].eqNullSafe(src["source"])
    edge = groups.join(src, same).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    edge = edge.select(groups["source"].alias("e_source"), F.col("head").alias("e_head"), "before", "rest")
    inside = sizes.join(edge, sizes["source"].eqNullSafe(edge["e_source"]) & (F.substring("key", 1, DIGITS) == edge["e_head"]))
    inside = inside.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("key")
    start = F.col("before") + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
    found = inside.select(F.col("source").alias("f_source"), F.col("key").alias("edge_key"), F.floor((F.col("rest") - F.col("start")) / F.col("rows")).cast("long").alias("edge_words"))
    return stored(src.join(found, src["source"].eqNullSafe(found["f_source"]), "left").drop("f_source"), "mix-plan")


def apply_mix(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows with source, size and key. Catalyst broadcasts the plan's table only if its
    size allows; else it is a join by source, whose large parts the adaptive plan splits."""
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "edge_key", "edge_words")
    rows = sizes.join(p, sizes["source"].eqNullSafe(p["p_source"]))
    part = F.when(F.col("key") < F.col("edge_key"), F.col("size")).when(F.col("key") == F.col("edge_key"), F.col("edge_words")).otherwise(F.lit(0))
    return rows.withColumn("taken", (F.col("whole") * F.col("size") + part).cast("long")).drop("p_source", "whole", "edge_key", "edge_words")


def mixture(docs: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    sizes = stored(sized(docs, seed), "sizes")
    return apply_mix(sizes, plan_mix(sizes, targets(sizes, budget, weights, max_epochs))).drop("key")


def mixed_documents(docs: DataFrame, budget: float = BUDGET, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: docs' columns, a row per whole repetition, and the first words of the text for a part of one.

    Own columns of any name pass through, but for n_chars: a part's is the number of code points of its text.
    """
    sizes = stored(sized(docs, seed), "sizes")
    plan = plan_mix(sizes, targets(sizes, budget, weights, max_epochs))

    def repeated(rows: DataFrame) -> DataFrame:
        full = rows.withColumn("size", word_count(F.col("text"))).withColumn("key", draw_key(F.col("doc_id"), F.col("size"), seed))
        mixed = apply_mix(full, plan).where(F.col("taken") > 0)
        whole, rest = F.expr("taken div size"), F.col("taken") % F.col("size")
        copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
        bare = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
        # what stands behind the first words is the last piece of a split into one more piece than words
        tail = F.element_at(F.split(bare, GAP, (F.col("copy") + 1).cast("int")), -1)
        text = F.when(F.col("copy") < 0, F.col("text")).otherwise(F.rtrim(F.substring(bare, F.lit(1), (F.length(bare) - F.length(tail)).cast("int")), F.lit(" \t\n\x0b\x0c\r")))
        out = mixed.withColumn("copy", F.explode(copies))
        parts = {"text": text, "n_chars": F.when(F.col("copy") < 0, F.col("n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in rows.columns else {"text": text}
        return out.select(*[parts[n].alias(n) if n in parts else F.col(n) for n in rows.columns])

    return passing(docs, ("doc_id", "source", "text", "n_chars"), repeated)
