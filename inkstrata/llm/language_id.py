"""Language identification by nearest centroids over character n-grams.

A text's vector counts its lower-cased letter 1- to 3-grams (every run of other characters is one space), hashed to DIMS
places, damped by log, weighted by inverse document frequency and scaled to length 1. Each language has up to CLUSTERS centroids
from spherical k-means; a text gets the language of the centroid with the highest cosine, which is its score. A text farther
from that centroid than REJECT times the radius seen in training (in cosine: below its floor) is marked rejected.

The model is fitted on a bounded sample, about PER_LANG labelled rows of each language, chosen by a hash of the id.
Defined results: a null text and a text without a letter are ``und`` with score 0, not rejected by distance. Rows with a null language
teach nothing. Without any row to learn from, every text is ``und``. Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_batch, arrow_rows, lean, sample_by_group, stored

DIMS = 1 << 13
PER_LANG = 400
CLUSTERS = 3
#: A centroid's floor is this share of the least cosine of its own sample members.
REJECT = 0.5
UND = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter; built once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, 32)
    code = np.concatenate(([32], code[letter | np.concatenate(([True], letter[:-1]))], [32])).astype(np.uint64)
    total = np.zeros(DIMS)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        if len(code) < n:
            break
        gram = (gram[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)) if n > 1 else code * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount(((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.int64), minlength=DIMS)
    return total


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def vector(self, total: np.ndarray) -> np.ndarray:
        v = np.log1p(total) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        total = counts(text)
        if total is None or not self.langs:
            return UND, 0.0, False
        cosine = self.centroids @ self.vector(total)
        best = int(np.argmax(cosine))
        return self.langs[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.floors[best])


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an emptied cluster goes."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        sums = [x[own == i].sum(0) for i in range(len(centres)) if (own == i).any()]
        centres = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums])
    return centres


def inverse_frequency(n_texts: int, found_in: np.ndarray) -> np.ndarray:
    return np.log((1 + n_texts) / (1 + found_in)) + 1


def centroids_of(x: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of one language's vectors, and their floors."""
    centres = k_means(x, clusters)
    near, cosine = np.argmax(x @ centres.T, 1), np.max(x @ centres.T, 1)
    return centres, np.array([REJECT * float(cosine[near == i].min()) if (near == i).any() else 0.0 for i in range(len(centres))])


SAMPLE_DDL = "lang string, places binary, totals binary"


def fit(labelled: DataFrame, per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> Model:
    """labelled: doc_id, text, lang. The sample's n-gram counts are a written table of sparse rows; each language is clustered by one task over
    its about per_lang rows. The places' document frequencies and at most clusters centroids a language reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # rows without an id are drawn by their text
    chosen = sample_by_group(rows, "lang", per_lang, F.coalesce(F.col("doc_id").cast("string"), F.md5("text")))
    schema = pa.schema([("lang", pa.string()), ("places", pa.binary()), ("totals", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in arrow_rows(batch, "lang", "text"):
                if (total := counts(text)) is not None:
                    places = np.nonzero(total)[0]
                    rows.append((lang, places.astype(np.uint16).tobytes(), total[places].astype(np.float32).tobytes()))
            if rows:
                yield arrow_batch(schema, list(zip(*rows, strict=True)))

    sample = stored(chosen.select("lang", "text").mapInArrow(lean(count), SAMPLE_DDL), "language-sample")
    frequency = pa.schema([("n_texts", pa.int64()), ("found_in", pa.list_(pa.int64()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for (places,) in arrow_rows(batch, "places"):
                n += 1
                seen[np.frombuffer(places, np.uint16)] += 1
        if n:
            yield arrow_batch(frequency, [[n], [seen]])

    parts = sample.select("places").coalesce(8).mapInArrow(lean(found), "n_texts bigint, found_in array<bigint>").collect()
    if not parts:
        return Model([], np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0))
    idf = inverse_frequency(sum(r[0] for r in parts), np.sum([r[1] for r in parts], 0))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        model, rows = Model([], idf, np.zeros((0, DIMS)), np.zeros(0)), rows.sort_values(["places", "totals"], kind="stable")
        x = np.zeros((len(rows), DIMS), np.float32)
        for own, places, values in zip(x, rows["places"], rows["totals"], strict=True):
            own[np.frombuffer(places, np.uint16)] = np.frombuffer(values, np.float32)
            own[:] = model.vector(own)
        centres, floors = centroids_of(x, clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "number": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "floor": floors})

    made = sorted(sample.groupBy("lang").applyInPandas(cluster, "lang string, number int, centre binary, floor double").collect())
    centres = np.array([np.frombuffer(bytes(r.centre), np.float32) for r in made], np.float32).reshape(-1, DIMS)
    return Model([r.lang for r in made], idf.astype(np.float32), centres, np.array([r.floor for r in made]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected to all columns of docs (own columns of these names are replaced)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text) for (text,) in arrow_rows(batch, "text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    rows = docs.select(*names)
    return rows.mapInArrow(lean(run), f"{ddl_of(rows)}, lang_pred string, score double, rejected boolean")


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
