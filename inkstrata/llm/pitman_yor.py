"""A hierarchical Pitman-Yor language model: Chinese-restaurant seatings sampled by Gibbs, averaged predictive probabilities.

Dishes are all training words and the end of a text. A context is the word before, or the start. Every context is a restaurant; all
share one parent restaurant, whose base is uniform over the training words, the end, and one unseen word.

Seating: a sweep removes and reseats all customers of a (context, dish), for every such cell, given the parent's predictive probabilities
and the other tables, then the parent's customers (the contexts' tables). Customers of a dish are seated in blocks of at most a twentieth of
those already seated, so a dish of a million customers takes some 200 steps, for all dishes at once. The last round's SWEEPS sweeps give
predictive probabilities, which are averaged. Draws are hashes of the cell, the sweep and the customer,
so results don't depend on how rows are dealt out.

At scale: tasks gather their documents in blocks of bounded size and send each block's distinct (context, word) pairs, sorted and packed, to
buckets of the word; words that are frequent in a sample are spread over all buckets by their contexts. Texts are not shuffled. A first pass
sends counts. A bucket then keeps the cells of two customers and more (a cell of one has one table whatever is drawn) and sums for the
rest. Buckets share a context's customers and tables by an exchange: each sends its parts to the context's home, which answers with
the sums. Between exchanges, once a round, a bucket takes the other buckets' tables of a context as they were. A second pass sends the pairs
with the documents that they stand in; buckets answer with each document's part of its score, which are summed. Words are compared by
48 bits of their hashes. Nothing is capped; the driver gets sums, and a row for each of the frequent words, which are fewer than 2 * HOT_SHARE.

Defined results: a null text is empty (one token, its end). Repeated rows count as often as they stand. Without training rows
every token is unknown. Only doc_id and text are read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_batch, arrow_rows, discarded, even_keys, hash_of, lean, mix64, packed, raw_text, stored, stored_at, unpacked, word_hashes

BURN_IN, SAMPLES = 4, 4  # of Dense
#: Exchanges with sweeps behind each; the last round's sweeps are the samples.
ROUNDS, SWEEPS = 2, 3
DISCOUNT, STRENGTH = 0.7, 5.0
#: Tokens and documents of a block at most, and characters of the corpus per bucket of pairs.
BLOCK_TOKENS, BLOCK_DOCS, BUCKET_CHARS = 2_000_000, 1 << 16, 16_000_000
#: Buckets at most: blocks send, and buckets exchange, a bounded number of messages each, and a bucket grows with corpora beyond 64 GB.
MOST_BUCKETS = 4_096
#: A word is spread over all buckets if it is more than one in HOT_SHARE tokens of a sample of about HOT_SAMPLE documents.
HOT_SHARE, HOT_SAMPLE = 4096, 2000
_word_id = lambda h: h >> np.uint64(16)
END, START = (_word_id(np.array([hash_of(w)], np.int64).view(np.uint64))[0] for w in (b"\0<end of text>\0", b"\0<start of text>\0"))


def tokens(text: str | None) -> np.ndarray:
    """The ids of a text's words and its end."""
    return np.append(_word_id(word_hashes(raw_text(text))), END)


def _drawn(seeds: np.ndarray, first: np.ndarray, block: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How many of block customers, from number first on, draw below p."""
    out = np.zeros(len(block), np.int64)
    ends = np.cumsum(block)
    at = 0
    while at < len(block):  # as many draws at once as fit the memory, one dish at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, "right")))
        own = np.repeat(np.arange(at, to), block[at:to])
        number = first[own] + np.arange(len(own)) - np.repeat(ends[at:to] - block[at:to] - (ends[at - 1] if at else 0), block[at:to])
        draw = (mix64(seeds[own] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53
        out[at:to] = np.bincount(own[draw < p[own]] - at, minlength=to - at)
        at = to
    return out


def reseated(customers: np.ndarray, open_: np.ndarray, discount: float, rng: np.random.Generator | np.ndarray) -> np.ndarray:
    """Tables per dish after seating its customers in turn, by blocks.

    open_: per dish, the weight of a new table, (strength + discount * other tables) * parent's probability, but for the part
    that this dish's own tables add. Customer i joins a table with weight i - discount * tables, or opens one with open_.
    rng: a generator, or a seed per dish whose hashes are the draws.
    """
    tables = (customers > 0).astype(np.int64)
    seated, live = tables.copy(), np.nonzero(customers > 1)[0]
    while len(live):
        n, t = seated[live], tables[live]
        block = np.minimum(np.maximum(1, n // 20), customers[live] - n)
        p = open_[live] / np.maximum(open_[live] + n - discount * t, 1e-300)
        tables[live] += rng.binomial(block, np.clip(p, 0, 1)) if isinstance(rng, np.random.Generator) else _drawn(rng[live], n, block, p)
        seated[live] += block
        live = live[seated[live] < customers[live]]
    return tables


class Dense:
    """The contexts' restaurants and their parent over one small table: what the distributed sweeps do, on one machine."""

    def __init__(self, context: np.ndarray, dish: np.ndarray, count: np.ndarray, n_contexts: int, n_dishes: int):
        self.context, self.dish, self.count = context, dish, count.astype(np.int64)
        self.n_contexts, self.n_dishes = n_contexts, n_dishes
        self.totals = np.bincount(context, self.count, n_contexts)

    def predictive(self, sweeps: int = BURN_IN + SAMPLES, burn_in: int = BURN_IN, discount: float = DISCOUNT, strength: float = STRENGTH, seed: int = 11) -> np.ndarray:
        """P(dish | context), averaged over the sweeps after burn_in."""
        rng = np.random.default_rng(seed)
        tables = np.minimum(self.count, 1)
        base = 1.0 / self.n_dishes
        top = np.bincount(self.dish, tables, self.n_dishes).astype(np.int64)
        top_tables = np.minimum(top, 1)
        parent = np.full(self.n_dishes, base)
        out = np.zeros((self.n_contexts, self.n_dishes))
        for sweep in range(sweeps):
            own = np.bincount(self.context, tables, self.n_contexts)
            tables = reseated(self.count, (strength + discount * own[self.context]) * parent[self.dish], discount, rng)
            top = np.bincount(self.dish, tables, self.n_dishes).astype(np.int64)
            top_tables = reseated(top, np.full(self.n_dishes, (strength + discount * top_tables.sum()) * base), discount, rng)
            parent = (top - discount * top_tables + (strength + discount * top_tables.sum()) * base) / (strength + top.sum())
            if sweep >= burn_in:
                own = np.bincount(self.context, tables, self.n_contexts)
                p = ((strength + discount * own)[:, None] * parent) / (strength + self.totals)[:, None]
                p[self.context, self.dish] += (self.count - discount * tables) / (strength + self.totals[self.context])
                out += p
        return out / max(1, sweeps - burn_in)


def thin(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of all and no wider than the largest, so that they compress well."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def thick(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.int64).ravel()


PAIRS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("lengths", "ws", "wn", "us", "ui", "ns", "docs", "learns", "sums")]])
PAIRS_DDL = "bucket bigint, block bigint, ids array<bigint>, lengths binary, ws binary, wn binary, us binary, ui binary, ns binary, docs binary, learns binary, sums binary"


class Blocks:
    """Collects a task's documents into blocks, and packs each block's pairs by bucket: with training counts, or with the documents."""

    def __init__(self, hot: np.ndarray, buckets: np.ndarray, part: int, block_tokens: int, counts: bool):
        self.hot, self.buckets, self.n_buckets, self.room, self.counts, self.block = hot, buckets, len(buckets), block_tokens, counts, part << 32
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.learns: list[bool] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None, learns: bool) -> Iterator[pa.RecordBatch]:
        self.ids.append(doc_id)
        self.texts.append(tokens(text))
        self.learns.append(bool(learns))
        self.held += len(self.texts[-1])
        if self.held >= self.room or len(self.ids) == BLOCK_DOCS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x) for x in self.texts], np.int64)
        learns = np.array(self.learns, np.uint8)
        every = np.concatenate([*self.texts, [START]])
        self.texts = []
        vocabulary, place = np.unique(every, return_inverse=True)
        del every
        start, begin, size = int(place[-1]), np.cumsum(lengths) - lengths, len(vocabulary)
        word = place[:-1].astype(np.int64)
        context = np.concatenate(([0], word[:-1]))
        context[begin] = start
        del place
        doc = np.repeat(np.arange(len(lengths)), lengths)
        word *= size
        word += context
        del context
        if size < 1 << 23:
            word <<= 16
            word |= doc
            word.sort()
            pair, doc = word >> 16, (word & 0xFFFF).astype(np.uint16)
        else:
            order = np.lexsort((doc, word))
            pair, doc = word[order], doc[order].astype(np.uint16)
        del word
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        times, (word, context) = np.diff(np.append(first, len(pair))), np.divmod(pair[first], size)
        del pair, first
        route, is_hot = mix64(vocabulary)[word], np.isin(vocabulary, self.hot)[word]
        route[is_hot] = mix64(route[is_hot] + mix64(vocabulary[context[is_hot]]) * np.uint64(0x9E3779B97F4A7C15))
        bucket = (((route >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)).astype(np.int64)
        order, each = np.argsort(bucket, kind="stable"), np.argsort(np.repeat(bucket, times), kind="stable")
        word, context, times, doc = word[order], context[order], times[order], doc[each]
        ends = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        del route, is_hot, bucket, order, each
        stops = np.concatenate(([0], np.cumsum(times)))
        rows = [] if self.counts else [(int(self.buckets[self.block % self.n_buckets]), self.block, self.ids, lengths.tobytes(), *[None] * 8)]
        for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            cut, inside = slice(ends[b], ends[b + 1]), slice(stops[ends[b]], stops[ends[b + 1]])
            own = word[cut]
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            others, ui = np.unique(context[cut], return_inverse=True)
            packed_pairs = (packed(vocabulary[own[begins]]), thin(np.diff(np.append(begins, len(own)))), packed(vocabulary[others]), thin(ui))
            if self.counts:
                ns = np.add.reduceat(learns[doc[inside]].astype(np.int64), stops[ends[b] : ends[b + 1]] - stops[ends[b]])
                rows.append((int(self.buckets[b]), self.block, None, None, *packed_pairs, thin(ns), None, None, None))
            else:
                rows.append((int(self.buckets[b]), self.block, None, None, *packed_pairs, thin(times[cut]), doc[inside].tobytes(), learns.tobytes(), None))
        yield arrow_batch(PAIRS, list(zip(*rows, strict=True)))
        self.clear()
        self.block += 1


def _sent(docs: DataFrame, hot: np.ndarray, buckets: np.ndarray, block_tokens: int, counts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(hot, buckets, TaskContext.get().partitionId(), block_tokens, counts)
        for batch in batches:
            for doc_id, text, learns in arrow_rows(batch, "doc_id", "text", "learns"):
                yield from blocks.add(doc_id, text, learns)
        if blocks.ids:
            yield from blocks.flush()

    return docs.mapInArrow(lean(run), PAIRS_DDL).repartition(len(buckets), "bucket")


def _merged(rows: pd.DataFrame, words: np.ndarray | None = None, contexts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All words and contexts of a bucket's rows, sorted, and per pair of each row the places of its word and context among them."""
    ws, us = [unpacked(x) for x in rows["ws"]], [unpacked(x) for x in rows["us"]]
    words = np.unique(np.concatenate(ws)) if words is None else words
    contexts = np.unique(np.concatenate(us)) if contexts is None else contexts
    word = [np.repeat(np.searchsorted(words, w), thick(n)) for w, n in zip(ws, rows["wn"], strict=True)]
    context = [np.searchsorted(contexts, u)[thick(i)] for u, i in zip(us, rows["ui"], strict=True)]
    return words, contexts, np.concatenate(word), np.concatenate(context), [len(w) for w in word]


def _totals(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, the sum of n for each, and the place of each code among them."""
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    starts = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    place = np.empty(len(code), np.int64)
    place[order] = np.cumsum(starts) - 1
    return ranked[starts], np.bincount(place, n, int(starts.sum())).astype(np.int64), place


#: Of a bucket: words with customers (n), tables of cells of one (s); contexts with customers (cu) and cells (zu), here and then in all buckets; cells
#: of two and more with tables; and the samples: the words' tables (top), the parent's (tt), the contexts' tables (tu), one after the other.
STATE = ["wk", "n", "s", "uk", "cu", "su", "cw", "ci", "c", "t", "tsum", "tt", "tops", "tts", "tus"]
STATE_DDL = "bucket bigint, " + ", ".join(f"{n} binary" for n in STATE)


def _framed(bucket: int, state: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([(bucket, *(packed(state[n]) if n in ("wk", "uk") else thin(state[n]) for n in STATE))], columns=["bucket", *STATE])


def _opened(row: pd.Series) -> dict[str, np.ndarray]:
    return {n: unpacked(row[n]) if n in ("wk", "uk") else thick(row[n]) for n in STATE}


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """The first state of a bucket: every cell has one table."""
    words, contexts, word, context, _ = _merged(rows)
    code, c, _ = _totals(word * len(contexts) + context, np.concatenate([thick(x) for x in rows["ns"]]))
    word, context = np.divmod(code, len(contexts))
    many, one, none = c > 1, c == 1, np.zeros(0, np.int64)
    sums = lambda at, n, size: np.bincount(at, n, size).astype(np.int64)
    state = {
        "wk": words, "n": sums(word, c, len(words)), "s": sums(word, one, len(words)), "uk": contexts, "cu": sums(context, c, len(contexts)), "su": sums(context, one, len(contexts)),
        "cw": word[many], "ci": context[many], "c": c[many], "t": np.ones(int(many.sum()), np.int64), "tsum": np.zeros(int(many.sum()), np.int64),
        "tt": np.minimum(sums(word, c, len(words)), 1), "tops": none, "tts": none, "tus": none,
    }
    return _framed(int(rows["bucket"].iloc[0]), state)


def _exchanged(state: DataFrame, values: Callable[[dict[str, np.ndarray]], np.ndarray], homes: np.ndarray, n_values: int) -> DataFrame:
    """(bucket, place, sums): for a bucket's contexts in order, the sums over all buckets of n_values numbers each (values: a row per number)."""
    schema = pa.schema([("home", pa.int64()), ("place", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("parts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _opened(row)
                parts = values(own)
                home = ((own["uk"] >> np.uint64(16)) * np.uint64(len(homes))) >> np.uint64(32)
                ends = np.searchsorted(home, np.arange(len(homes) + 1, dtype=np.uint64))
                filled = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                if filled:
                    sent = [(int(homes[h]), h, row["bucket"], packed(own["uk"][ends[h] : ends[h + 1]]), thin(parts[:, ends[h] : ends[h + 1]].ravel())) for h in filled]
                    yield arrow_batch(schema, list(zip(*sent, strict=True)))

    def sum_up(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x) for x in rows["keys"]]
        parts = np.concatenate([thick(x).reshape(n_values, -1) for x in rows["parts"]], axis=1)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(place, p).astype(np.int64)[place] for p in parts])
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"bucket": rows["bucket"], "place": rows["place"], "sums": [thin(x.ravel()) for x in np.split(sums, cuts, axis=1)]})

    sent = state.mapInArrow(lean(send), "home bigint, place bigint, bucket bigint, keys binary, parts binary").repartition(len(homes), "home")
    return sent.groupBy("home").applyInPandas(sum_up, "bucket bigint, place bigint, sums binary")


def _sums(rows: pd.DataFrame, n_values: int) -> np.ndarray:
    each = [thick(x).reshape(n_values, -1) for x in rows.sort_values("place")["sums"]]
    return np.concatenate([np.zeros((n_values, 0), np.int64), *each], axis=1)


def _hot_words(docs: DataFrame, learns: str) -> np.ndarray:
    """Words that are more than one in HOT_SHARE tokens of a sample: at most HOT_SHARE, whatever the corpus."""
    n = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < F.lit(int(min(1.0, HOT_SAMPLE / max(1, n)) * (1 << 30)))).select("text")
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [tokens(text) for (text,) in arrow_rows(batch, "text")]
            if each:
                word, times = np.unique(np.concatenate(each), return_counts=True)
                yield arrow_batch(schema, [word.view(np.int64), times])

    counts = sample.mapInArrow(lean(run), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = {r.word for r in counts.where(F.col("n") * HOT_SHARE > F.lit(total)).select("word").collect()}
    return np.array(sorted(found | {int(END)}), np.uint64)


def _top(state: dict[str, np.ndarray]) -> np.ndarray:
    """The parent's customers per word: the tables of its cells."""
    return state["s"] + np.bincount(state["cw"], state["t"], len(state["wk"])).astype(np.int64)


def _world(state: DataFrame, hot: np.ndarray, n_values: int, values: Callable[[dict[str, np.ndarray]], np.ndarray]) -> tuple[dict[int, list[int]], list[int]]:
    """Of numbers per word (values: a row each): the sums of each frequent word, and those of all others together."""
    schema = pa.schema([("word", pa.int64()), ("parts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _opened(row)
                parts, is_hot = values(own), np.isin(own["wk"], hot)
                rows = [(int(w), p.tolist()) for w, p in zip(own["wk"][is_hot].view(np.int64), parts[:, is_hot].T, strict=True)]
                rows.append((None, parts[:, ~is_hot].sum(1).tolist()))
                yield arrow_batch(schema, list(zip(*rows, strict=True)))

    found = state.mapInArrow(lean(run), "word bigint, parts array<bigint>").groupBy("word").agg(*[F.sum(F.get("parts", F.lit(i))).alias(f"v{i}") for i in range(n_values)]).collect()
    each = {r.word: [int(r[f"v{i}"]) for i in range(n_values)] for r in found}
    others = each.pop(None, [0] * n_values)
    return each, others


def scored(
    docs: DataFrame, learns: str, block_chars: int = 7 * BLOCK_TOKENS, bucket_chars: int = BUCKET_CHARS, discount: float = DISCOUNT, strength: float = STRENGTH,
) -> DataFrame:
    """SCORE_DDL and train_tokens for every row of docs. learns: SQL condition on doc_id that names the training rows. block_chars: about
    seven a token.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("learns", F.coalesce(F.expr(learns), F.lit(False)))
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_buckets, block_tokens = max(1, min(MOST_BUCKETS, -(-size // bucket_chars))), max(1, block_chars // 7)
    buckets = even_keys(n_buckets, n_buckets)  # one to a partition
    hot = _hot_words(docs, learns)
    state, path = stored_at(_sent(docs, hot, buckets, block_tokens, True).groupBy("bucket").applyInPandas(_counted, STATE_DDL), "lm-state")
    frequent, others = _world(state, hot, 2, lambda own: np.stack((own["n"], np.minimum(own["n"], 1))))
    total, distinct = others[0] + sum(v[0] for v in frequent.values()), others[1] + sum(v[0] > 0 for v in frequent.values())
    hot_n = np.array([frequent.get(int(w), [0])[0] for w in hot.view(np.int64)], np.int64)
    base = 1.0 / (distinct + 1)

    def hot_tables_of(tops: np.ndarray, others: float, turn: int) -> np.ndarray:
        """The parent's tables of the frequent words, drawn until their own number stands among what opens a table."""
        tables = np.minimum(tops, 1)
        for again in range(3):
            opens = (strength + discount * (others + tables.sum())) * base
            tables = reseated(tops, np.full(len(tops), opens), discount, mix64(hot + np.uint64(1000 + 10 * turn + again)))
        return tables

    def parent_of(state: DataFrame) -> tuple[np.ndarray, float, float]:
        """The frequent words' tables in all contexts, all words' together, and the parent's tables (those of frequent words as one bucket drew them)."""
        each, rest = _world(state, hot, 2, lambda own: np.stack((_top(own), own["tt"])))
        tops = np.array([each.get(int(w), [0, 0])[0] for w in hot.view(np.int64)], np.int64)
        return tops, float(rest[0] + tops.sum()), float(rest[1] + hot_tables_of(tops, rest[1], 0).sum())

    def sampler(round_: int, tops: np.ndarray, all_top: float, all_tables: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        """A round's sweeps over a bucket, given what the others held when it began."""

        def sample(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            own = _opened(mine.iloc[0])
            elsewhere_u = _sums(found, 1)[0] - own["su"] - np.bincount(own["ci"], own["t"], len(own["uk"])).astype(np.int64)
            at = np.searchsorted(hot, own["wk"])
            is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == own["wk"])
            elsewhere_w = np.where(is_hot, tops[np.minimum(at, len(hot) - 1)] - _top(own), 0)
            seeds, word_seeds = mix64(mix64(own["uk"])[own["ci"]] * np.uint64(0x9E3779B97F4A7C15) + own["wk"][own["cw"]]), mix64(own["wk"])
            samples: dict[str, list[np.ndarray]] = {"tops": [], "tts": [], "tus": []}
            tsum, began = np.zeros(len(own["c"]), np.int64), (max(1, _top(own).sum()), max(1, own["tt"].sum()))
            for k in range(SWEEPS):
                turn = np.uint64(1 + round_ * SWEEPS + k)
                # all buckets' tables are taken to have grown as this one's since the round began
                now_top, now_tables = all_top * (_top(own).sum() / began[0]), all_tables * (own["tt"].sum() / began[1])
                opens = (strength + discount * now_tables) * base
                parent = (elsewhere_w + _top(own) - discount * own["tt"] + opens) / (strength + now_top)
                tables_u = elsewhere_u + own["su"] + np.bincount(own["ci"], own["t"], len(own["uk"]))
                own["t"] = reseated(own["c"], (strength + discount * tables_u[own["ci"]]) * parent[own["cw"]], discount, mix64(seeds + turn))
                own["tt"] = reseated(elsewhere_w + _top(own), np.full(len(own["wk"]), opens), discount, mix64(word_seeds + turn))
                tsum += own["t"]
                samples["tops"].append(_top(own))
                samples["tts"].append(own["tt"])
                samples["tus"].append(own["su"] + np.bincount(own["ci"], own["t"], len(own["uk"])).astype(np.int64))
            if round_ == ROUNDS - 1:
                own |= {n: np.concatenate(x) for n, x in samples.items()} | {"tsum": tsum}
            return _framed(int(mine["bucket"].iloc[0]), own)

        return sample

    for round_ in range(ROUNDS):
        contexts_of = lambda own: (own["su"] + np.bincount(own["ci"], own["t"], len(own["uk"])).astype(np.int64))[None, :]
        replies = _exchanged(state, contexts_of, buckets, 1)
        last, (state, path) = path, stored_at(state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(sampler(round_, *parent_of(state)), STATE_DDL), "lm-state")
        discarded(spark, last)

    # what all buckets hold of each context and frequent word, per sample
    each, rest = _world(state, hot, 2 * SWEEPS, lambda own: np.concatenate((own["tops"].reshape(SWEEPS, -1), own["tts"].reshape(SWEEPS, -1))))
    hot_tops = np.array([each.get(int(w), [0] * 2 * SWEEPS)[:SWEEPS] for w in hot.view(np.int64)], np.int64).reshape(-1, SWEEPS)
    rest = np.array(rest, np.int64)
    hot_tables = np.stack([hot_tables_of(hot_tops[:, k], rest[SWEEPS + k], 1 + k) for k in range(SWEEPS)], 1)
    seats = strength + rest[:SWEEPS] + hot_tops.sum(0)
    opens = (strength + discount * (rest[SWEEPS:] + hot_tables.sum(0))) * base
    replies = _exchanged(state, lambda own: np.concatenate((own["cu"][None, :], own["tus"].reshape(SWEEPS, -1))), buckets, 1 + SWEEPS)

    def settle(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own, sums = _opened(mine.iloc[0]), _sums(found, 1 + SWEEPS)
        none = np.zeros(0, np.int64)
        return _framed(int(mine["bucket"].iloc[0]), own | {"cu": sums[0], "tus": sums[1:].ravel(), "t": none, "su": none, "tt": none})

    final = stored(state.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(settle, STATE_DDL), "lm-final")
    discarded(spark, path)

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        mine = rows["ws"].notna()
        out = list(rows[~mine].itertuples(index=False, name=None))
        rows = rows[mine]
        if len(rows):
            own = _opened(model.iloc[0])
            words, contexts, word, context, sizes = _merged(rows, own["wk"], own["uk"])
            cuts = np.cumsum(sizes)[:-1]
            times, docs_of, learned = [thick(x) for x in rows["ns"]], [np.frombuffer(x, np.uint16) for x in rows["docs"]], [np.frombuffer(x, np.uint8) for x in rows["learns"]]
            n = np.concatenate([np.add.reduceat(flags[d].astype(np.int64), np.cumsum(m) - m) for m, d, flags in zip(times, docs_of, learned, strict=True)])
            distinct_codes, c, place = _totals(word * len(contexts) + context, n)
            del context, n
            tables = np.minimum(c, 1) * SWEEPS
            cells = own["cw"] * len(contexts) + own["ci"]
            tables[np.searchsorted(distinct_codes, cells)] = own["tsum"]
            at = np.searchsorted(hot, words)
            is_hot, at = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == words), np.minimum(at, len(hot) - 1)
            n_word = np.where(is_hot, hot_n[at], own["n"])
            top = np.where(is_hot[:, None], hot_tops[at], own["tops"].reshape(SWEEPS, -1).T)
            under = np.where(is_hot[:, None], hot_tables[at], own["tts"].reshape(SWEEPS, -1).T)
            parent = (top - discount * under + opens) / seats
            shared = strength + discount * own["tus"].reshape(SWEEPS, -1).T
            word_of, context_of = np.divmod(distinct_codes, len(contexts))
            mixed = sum(shared[context_of, k] * parent[word_of, k] for k in range(SWEEPS))
            p = np.log10((SWEEPS * c - discount * tables + mixed) / (SWEEPS * (strength + own["cu"][context_of])))
            plain, known = np.log10((n_word + 0.5) / (total + 0.5 * (distinct + 1))), n_word > 0
            for (bucket, block), m, d, flags, at_word, at_pair in zip(rows[["bucket", "block"]].itertuples(index=False), times, docs_of, learned, np.split(word, cuts), np.split(place, cuts), strict=True):
                add = lambda x, m=m, d=d, flags=flags: np.bincount(d, np.repeat(x, m), len(flags))
                sums = np.stack((add(p[at_pair]), add(plain[at_word]), add(known[at_word].astype(float))))
                out.append((bucket, block, *[None] * 9, sums.tobytes()))
        return pd.DataFrame(out, columns=PAIRS.names)

    parts = _sent(docs, hot, buckets, block_tokens, False).groupBy("bucket").cogroup(final.groupBy("bucket")).applyInPandas(score, PAIRS_DDL)

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["ids"].notna()
        own = rows[mine].iloc[0]
        lengths = np.frombuffer(own["lengths"], np.int64)
        sums = sum((np.frombuffer(x).reshape(3, -1) for x in rows[~mine].sort_values("bucket")["sums"]), np.zeros((3, len(lengths))))
        ids = pd.array([None if pd.isna(x) else int(x) for x in own["ids"]], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": lengths, "n_known": sums[2].round().astype(np.int64), "base_score": sums[1], "score": sums[0]})

    return parts.groupBy("block").applyInPandas(add_up, SCORE_DDL).withColumn("train_tokens", F.lit(int(total)).cast("long"))


SCORE_DDL = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
