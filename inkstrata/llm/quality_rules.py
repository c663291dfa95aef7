"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule, so a new policy
version is a bit mask over a stored ledger, and ablations are bitwise aggregates; no text is read again.

Defined results: a null, empty or blank text has no words and fails only ``few_words``. Repeated rows get a row each. An
empty table gives an empty ledger. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A name and a condition under which a document fails, over the measurements. Its bit is its place in RULES."""

    name: str
    fails: str


#: Places are permanent: retired rules stay, new ones are appended, so that stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "2 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is rejected if any of the named rules fails."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[n] for n in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(r.name for r in RULES)))}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with MEASURES.

    Windows of three words are compared by 64-bit hashes within one text. Arrays live within a row, so nothing is shuffled.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, h = F.col("_w"), F.col("_h")
    last = F.size(w) - 3
    window = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    z, n = F.col("_z"), F.size(F.col("_z"))
    twin = F.filter(F.transform(z, lambda x, i: F.when(
        ((i > 0) & (x["h"] == F.get(z, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(z, i + 1)["h"])), x["at"])), lambda p: p.isNotNull())
    p = F.col("_p")
    covered = F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2)))
    return (
        docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
        .select(id_col, words_of(F.col("_text")).alias("_w"), lines.alias("_l"), F.regexp_count(text, F.lit(SYMBOLS)).alias("_s"))
        .select(
            id_col,
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.col("_s").cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.size("_l").cast("long").alias("n_lines"),
            window.alias("_h"),
        )
        .withColumn("_z", F.when(h.isNotNull() & (F.size(F.array_distinct(h)) < F.size(h)), ranked))
        .withColumn("_p", twin)
        .withColumn("n_repeat_words", F.when(F.col("_z").isNull(), F.lit(0)).otherwise(covered).cast("long"))
        .select(id_col, *MEASURES)
    )


def ledger(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds fail_bits: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measures.withColumn("fail_bits", bits)


def hits(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds kept and the policy's version to a ledger."""
    return book.withColumn("kept", hits(policy.mask(rules)) == 0).withColumn("policy", F.lit(policy.version))


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and that stay if it is dropped.

    One pass: the ledger is first counted by its bits under the policy (at most 2 to the number of rules), then those few
    rows are compared with each rule's bit.
    """
    mask = policy.mask(rules)
    by_bits = book.groupBy(hits(mask).alias("bits")).agg(F.count("*").alias("docs"))
    bit = F.lit(1).cast("long")
    places = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules])).alias("r")
    each, bit = by_bits.select("bits", "docs", places), F.col("r.bit")
    when = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0)).alias
    return each.groupBy(F.col("r.rule").alias("rule"), bit.alias("bit")).agg(
        F.sum("docs").alias("n_docs"),
        when(F.col("bits").bitwiseAND(bit) != 0)("n_failed"),
        when(F.col("bits") == bit)("n_only"),
        when((F.col("bits") == 0) | (F.col("bits") == bit))("n_kept_without"),
    )
