"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are the words of a text, lower-cased and stripped of what is not a letter at their ends. Two tags (clean, toxic) form
a chain over the whole text; features are the token, its ending and
beginnings, and the tokens before and after, hashed. Token labels come from document
labels: words, or beginnings of words, far more frequent (by documents) in toxic than in clean training rows are tagged toxic where they occur in a toxic
document, and clean elsewhere. Forward-backward gives each token's marginal: the messages of a text are carried from stretch to
stretch of STRETCH tokens by the stretches' transfer matrices, so all stretches of all texts run side by side and none is a border. A document's largest marginal and expected number of
toxic tokens go through a logistic calibration fitted on the training rows' labels; tokens with a marginal of at least 0.5 are
the offending spans (offsets in code points).

The model is fitted on a bounded sample: about PER_LABEL rows of each label, chosen by a hash of the id, and at most STRETCHES
stretches of them, with the features that they have in their whole texts. Potentials are cut at 30, far beyond what a fit gives. Defined results: null, empty and wordless texts get the score of a document without a toxic token. Without rows of
both labels the score is 0 for all. Repeated rows get equal scores; labels that are null or whose document is missing teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import RunningSums, arrow_batch, arrow_rows, hash64, lean, mix64, release, sample_by_group, segment_end, stored, word_bounds
from .language_id import ddl_of

STRETCH = 64
DIMS = 1 << 16
PER_LABEL = 2000
STRETCHES = 6000
#: A word becomes a label for tokens from this many toxic documents of the sample, and this log-odds, on.
LEXICON_DOCS, LEXICON_ODDS = 5, 2.0
#: Lengths of the beginnings of a word that are features and may be labels, too: invented compounds share them.
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.3

_edges = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_word = re.compile(r"[^\x20\x09-\x0D]+")
_ascii_marks = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalpha())
_marks = np.zeros(256, bool)
_marks[list(_ascii_marks)] = True
#: How many marks are stripped from either end of a token for its features.
STRIPPED = 6


def normal(word: bytes) -> str:
    w = word.lower().strip(_ascii_marks)
    return w.decode() if w.isalpha() else _edges.sub("", w.decode("utf-8", "replace").lower())


def stems(w: str) -> list[str]:
    """What may mark a word as toxic: itself and its beginnings, marked by a star."""
    return [w, *(w[:k] + "*" for k in BEGINNINGS if len(w) >= k)]


def features(text: str | None) -> np.ndarray:
    """Per token of a whole text, its places as the token before, as the token after, and its own (whole, ending, beginnings).

    Beginnings and the ending are counted in bytes; a beginning longer than the token has the place of none.
    """
    return _features(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8))


def _features(raw: np.ndarray) -> np.ndarray:
    if (cut := segment_end(raw)) is not None:
        return np.concatenate([_features(raw[:cut]), _features(raw[cut:])])
    start, end = word_bounds(raw)
    for _ in range(STRIPPED):
        end = end - ((end > start) & _marks[raw[end - 1]])
        start = start + ((end > start) & _marks[raw[np.minimum(start, len(raw) - 1)]])
    sums = RunningSums(raw)
    whole = sums.between(start, end)
    parts = [whole, whole, whole, sums.between(np.maximum(start, end - 3), end)]
    parts += [np.where(start + k <= end, sums.between(start, np.minimum(start + k, end)), np.uint64(0)) for k in BEGINNINGS]
    out = np.empty((len(start), len(parts)), np.int32)
    for kind, h in enumerate(parts):
        out[:, kind] = mix64(h + np.uint64(kind)) % np.uint64(DIMS)
    return out


def unaries(places: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Toxic minus clean potential of each token of one text."""
    return weights[beside(places)].sum(1) + bias


def beside(places: np.ndarray) -> np.ndarray:
    """The places of each token's features, with those of its neighbours in the whole text; place DIMS stands for none."""
    out = places.copy()
    out[1:, 0], out[:-1, 1] = places[:-1, 0], places[1:, 1]
    out[:1, 0] = out[-1:, 1] = DIMS
    return out


def forward_backward(unary: np.ndarray, valid: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches as rows: marginals of the toxic tag, log partition, and pair marginals summed per tag pair.

    Messages are kept as the log-ratio of the two tags plus a common part, so each step is a few vector operations.
    """
    rows, length = unary.shape
    s = np.zeros((length, rows, 2))
    s[:, :, 1] = unary.T
    alpha, beta = np.zeros_like(s), np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, length):
        step = np.logaddexp(alpha[t - 1][:, :1] + trans[0], alpha[t - 1][:, 1:] + trans[1]) + s[t]
        alpha[t] = np.where(valid[:, t, None], step, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        own = s[t + 1] + beta[t + 1]
        step = np.logaddexp(own[:, :1] + trans[:, 0], own[:, 1:] + trans[:, 1])
        beta[t] = np.where(valid[:, t + 1, None], step, beta[t + 1])
    z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
    marginal = 1 / (1 + np.exp(np.clip(alpha[:, :, 0] + beta[:, :, 0] - alpha[:, :, 1] - beta[:, :, 1], -60, 60)))
    pairs = np.zeros((2, 2))
    if length > 1:
        right = s[1:] + beta[1:]
        for a in range(2):
            for b in range(2):
                p = np.exp(np.clip(alpha[:-1, :, a] + trans[a, b] + right[:, :, b] - z, -700, 0))
                pairs[a, b] = (p * valid.T[1:]).sum()
    return marginal.T * valid, z, pairs


def fit_crf(stretches: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights per feature place, bias and transitions by gradient ascent (Adam) on the penalised likelihood.

    stretches: per token the places of its features, and tags.
    """
    weights, bias, trans = np.zeros(DIMS + 1), -2.0, np.zeros((2, 2))
    if not stretches:
        return weights, bias, trans
    n, length = len(stretches), max(len(y) for _, y in stretches)
    places, tags, valid = np.zeros((n, length, stretches[0][0].shape[1]), np.int32), np.zeros((n, length)), np.zeros((n, length), bool)
    for i, (x, y) in enumerate(stretches):
        places[i, : len(y)], tags[i, : len(y)], valid[i, : len(y)] = x, y, True
    seen = np.zeros((2, 2))
    both = valid[:, 1:] & valid[:, :-1]
    for a in range(2):
        for b in range(2):
            seen[a, b] = (both & (tags[:, :-1] == a) & (tags[:, 1:] == b)).sum()
    # a column per kind of feature, one at a time: the driver's memory stays small
    used = np.unique(places[valid])
    columns = [np.searchsorted(used, places[:, :, j][valid]).astype(np.int32) for j in range(places.shape[2])]
    del places
    own, total = np.zeros(len(used)), max(1, tags.sum())
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (own, np.zeros(1), trans)]
    for step in range(1, rounds + 1):
        unary = np.zeros((n, length))
        unary[valid] = sum((own[at] for at in columns), np.full(len(columns[0]), bias))
        marginal, _, pairs = forward_backward(unary, valid, trans)
        error = (tags - marginal)[valid]
        grads = [sum(np.bincount(at, error, len(used)) for at in columns) / total - decay * own, np.array([error.sum() / total]), (seen - pairs) / total - decay * trans]
        moves = []
        for (m, v), g in zip(state, grads, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        own, bias, trans = own + moves[0], bias + float(moves[1][0]), trans + moves[2]
    weights[used] = own
    return weights, bias, trans


def calibrated(largest: np.ndarray, expected: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """A row per document: 1, largest marginal, log of 1 + expected toxic tokens, and their log share of all tokens."""
    return np.stack([np.ones_like(largest), largest, np.log1p(expected), np.log((expected + 0.05) / (n_tokens + 20))], 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: np.ndarray  # of calibrated()

    def probability(self, largest: np.ndarray, expected: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        x = calibrated(largest, expected, n_tokens) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Tagger:
    """Marginals of whole texts."""

    def __init__(self, model: Model):
        self.model = model

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array per text."""
        scores = [unaries(features(text), self.model.weights, self.model.bias) for text in texts]
        return whole_chains(scores, self.model.trans)


def whole_chains(unaries: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """The marginals of each text's whole chain. The stretches of all texts run together: first for what a stretch does to a message,
    then, text by text in step, for the messages at the stretches' borders, then for those within."""
    lengths = np.array([len(u) for u in unaries], np.int64)
    if not lengths.sum():
        return [np.zeros(0) for _ in unaries]
    flat, ends, pieces = np.concatenate(unaries), np.cumsum(lengths), -(-lengths // STRETCH)
    last = np.cumsum(pieces)
    number = np.arange(last[-1]) - np.repeat(last - pieces, pieces)  # of a stretch in its text
    begin = np.repeat(ends - lengths, pieces) + number * STRETCH
    at = begin[:, None] + np.arange(STRETCH)
    valid = at < np.repeat(ends, pieces)[:, None]
    unary = np.where(valid, flat[np.minimum(at, len(flat) - 1)], 0.0)
    transfer = _transfers(unary, valid, number == 0, trans)
    fore, aft = np.ones((len(number), 2)), np.ones((len(number), 2))  # messages into each stretch from either side
    order = np.argsort(-pieces, kind="stable")
    for k in range(1, int(pieces.max())):
        live = order[: np.searchsorted(-pieces[order], -k, "left")]  # texts of more than k stretches
        here = (last - pieces)[live] + k
        fore[here] = np.einsum("ni,nij->nj", fore[here - 1], transfer[here - 1])
        fore[here] /= fore[here].sum(1, keepdims=True)
        back = last[live] - 1 - k
        aft[back] = np.einsum("nij,nj->ni", transfer[back + 1], aft[back + 1])
        aft[back] /= aft[back].sum(1, keepdims=True)
    ratio = lambda m: np.log(np.maximum(m[:, 1], 1e-300) / np.maximum(m[:, 0], 1e-300))
    out = np.zeros(len(flat))
    out[at[valid]] = chain(unary, valid, trans, np.where(number == 0, np.nan, ratio(fore)), ratio(aft))[valid]
    return np.split(out, ends[:-1])


def _transfers(unary: np.ndarray, valid: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Per stretch the matrix by which a forward message (clean, toxic) leaves it, up to a factor; a text's first token has no step before it."""
    m, grow = np.exp(trans), np.exp(np.clip(unary, -30, 30))
    out = np.tile(np.eye(2), (len(unary), 1, 1))
    for t in range(unary.shape[1]):
        step = out @ m
        if t == 0:
            step[first] = out[first]
        step[:, :, 1] *= grow[:, t, None]
        out = np.where(valid[:, t, None, None], step / step.sum((1, 2), keepdims=True), out)
    return out


def chain(unary: np.ndarray, valid: np.ndarray, trans: np.ndarray, fore_in: np.ndarray | None = None, aft_in: np.ndarray | None = None) -> np.ndarray:
    """The marginals of forward_backward() alone, on log-ratios of the two tags: one number per token and direction.

    fore_in and aft_in: the messages that reach each row from the left (nan: none, the row begins its text) and from the right.
    """
    a, b = trans[0], trans[1]
    step = lambda x: np.log((np.exp(a[1]) + np.exp(b[1] + x)) / (np.exp(a[0]) + np.exp(b[0] + x)))
    back = lambda x: np.log((np.exp(b[0]) + np.exp(b[1] + x)) / (np.exp(a[0]) + np.exp(a[1] + x)))
    u = np.ascontiguousarray(np.clip(unary, -30, 30).T)
    ok = np.ascontiguousarray(valid.T)
    fore, aft = np.zeros_like(u), np.zeros_like(u)
    fore[0] = u[0]
    if fore_in is not None:
        inner = ~np.isnan(fore_in)
        fore[0, inner] += step(fore_in[inner])
    for t in range(1, len(u)):
        fore[t] = np.where(ok[t], u[t] + step(fore[t - 1]), 0.0)
    if aft_in is not None:
        aft[-1] = np.where(ok[-1], aft_in, 0.0)
    for t in range(len(u) - 2, -1, -1):
        aft[t] = np.where(ok[t + 1], back(u[t + 1] + aft[t + 1]), 0.0)
    return (1 / (1 + np.exp(-(fore + aft)))).T


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. The sample is drawn from the labels, so only its few ids meet the texts."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = stored(sample_by_group(rows, "toxic", per_label, F.col("doc_id")), "toxicity-ids")
    chosen = stored(docs.where("text is not null").select("doc_id", "text").join(drawn, "doc_id"), "toxicity-sample")
    sizes = dict(chosen.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model(np.zeros(DIMS + 1), -2.0, np.zeros((2, 2)), np.array([-50.0, 0.0, 0.0, 0.0]))
    word_schema = pa.schema([("word", pa.string()), ("toxic", pa.int32())])

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in arrow_rows(batch, "text", "toxic"):
                own = {x for w in {normal(w) for w in set(text.encode("utf-8", "surrogatepass").split())} - {""} for x in stems(w)}
                yield arrow_batch(word_schema, [list(own), [toxic] * len(own)])

    by_word = chosen.mapInArrow(lean(distinct_words), "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("good") + 0.5) / (sizes[0] + 1))
    # at most as many words as the bounded sample's toxic documents hold LEXICON_DOCS times
    lexicon = {r[0] for r in by_word.where((F.col("bad") >= LEXICON_DOCS) & (odds >= LEXICON_ODDS)).select("word").collect()}
    schema = pa.schema([("key", pa.int64()), ("places", pa.binary()), ("tags", pa.binary())])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, toxic in arrow_rows(batch, "doc_id", "text", "toxic"):
                words, places = text.encode("utf-8", "surrogatepass").split(), beside(features(text))
                for a in range(0, len(words), STRETCH):
                    own = words[a : a + STRETCH]
                    hit = [not lexicon.isdisjoint(stems(normal(w))) for w in own]
                    key = hash64(f"{doc_id}:{a}".encode())
                    if any(hit) or key % 16 == 0:
                        rows.append((key, places[a : a + STRETCH].tobytes(), bytes(h and toxic for h in hit)))
            if rows:
                yield arrow_batch(schema, list(zip(*rows, strict=True)))

    picked = chosen.mapInArrow(lean(stretches), "key bigint, places binary, tags binary").orderBy("key", "places").limit(STRETCHES).collect()
    train = []
    for _, places, tags in picked:
        y = np.frombuffer(bytes(tags), np.uint8).astype(float)
        train.append((np.frombuffer(bytes(places), np.int32).reshape(len(y), -1), y))
    del picked
    weights, bias, trans = fit_crf(train)
    del train
    release()
    model = Model(weights.astype(np.float32), bias, trans, np.zeros(4))
    seen = measured(chosen.select("text", "toxic"), model).select("toxic", "largest", "expected", "n_tokens").collect()
    y = np.array([r[0] for r in seen], float)
    x = calibrated(*np.array([r[1:] for r in seen], float).T)
    model.calibration = logistic(x, y, true_rates(rows))
    return model


def true_rates(rows: DataFrame) -> float:
    """The share of toxic rows among all labelled ones; the sample holds about as many of either."""
    return float(rows.agg(F.avg("toxic")).first()[0])


def logistic(x: np.ndarray, y: np.ndarray, rate: float, rounds: int = 30, decay: float = 1e-2) -> np.ndarray:
    """Newton's method; rows are weighted so that toxic ones have their true share."""
    own = y.mean()
    w = np.where(y == 1, rate / own, (1 - rate) / (1 - own))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - decay * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, largest, expected, n_tokens and spans to all columns of docs (own columns of these names are replaced)."""
    mine = ("score", "largest", "expected", "n_tokens", "spans")
    rows = docs.select(*[c for c in docs.columns if c not in mine])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                found = tagger.marginals(texts)
                largest, expected = np.array([m.max() if len(m) else 0.0 for m in found]), np.array([m.sum() for m in found])
                lengths = np.array([len(m) for m in found], float)
                spans = []
                for text, m in zip(texts, found, strict=True):
                    if len(m) and m.max() >= 0.5:
                        spans.append([{"start": w.start(), "end": w.end(), "marginal": float(p)} for w, p in zip(_word.finditer(text), m, strict=True) if p >= 0.5])
                    else:
                        spans.append([])
                own = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(model.probability(largest, expected, lengths)), pa.array(largest), pa.array(expected), pa.array(lengths.astype(np.int64)), pa.array(spans, span)], names=[*part.schema.names, *mine])

    return rows.mapInArrow(lean(run), f"{ddl_of(rows)}, score double, largest double, expected double, n_tokens bigint, spans array<struct<start:bigint,end:bigint,marginal:double>>")
