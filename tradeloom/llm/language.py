"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its letter bigrams and trigrams, hashed into a
fixed number of places and scaled to length one. Each language has a few
centroids, found by clustering its training vectors by cosine; a text takes the
language of the nearest one. A text that lies farther from it than any training
text of that language did, by some slack, is rejected, unless it has so few
n-grams that its distance says nothing.

The classifier is fitted on about ``SAMPLE`` training texts of each language,
drawn by hash; that is its only bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.shared import slices

PLACES = 2048
SAMPLE = 1000
CENTROIDS = 4
UNDETERMINED = "und"
PIECE = 1 << 20
ROWS = 1024
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd, for multiplicative hashing


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(point).isalpha() for point in range(0x110000)])


def gram_counts(text: str) -> np.ndarray:
    """Counts per place of the bigrams and trigrams of a text's lower-cased words; all zero without a letter."""
    total, tail = np.zeros(PLACES, np.int64), np.zeros(1, np.uint32)
    for start in range(0, len(text), PIECE):
        points = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_letters()[points], points, 0)
        points = np.concatenate([tail, points])
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        total += _hashed(points)
        # The last two points begin the next piece; the gram between them is taken back from it.
        tail = points[-2:]
        if len(tail) == 2:
            total -= _hashed(tail)
    if len(tail) == 2:
        total += _hashed(tail)
    if tail[-1]:
        total += _hashed(np.append(tail, np.uint32(0))) - _hashed(tail)
    return total


def _hashed(points: np.ndarray) -> np.ndarray:
    """Counts of the two- and three-point runs of an array; runs of a lone letterless point do not occur."""
    shift = np.uint32(32 - PLACES.bit_length() + 1)
    parts = [points[k : len(points) - 2 + k] * MULTIPLIERS[k] for k in range(3)] if len(points) > 2 else []
    pairs = points[:-1] * MULTIPLIERS[0] ^ points[1:] * MULTIPLIERS[1]
    counts = np.bincount(pairs >> shift, minlength=PLACES)
    if parts:
        counts = counts + np.bincount((parts[0] ^ parts[1] ^ parts[2]) >> shift, minlength=PLACES)
    return counts


@dataclass
class Languages:
    """``centroids`` of unit length, the index of each one's language, and each language's farthest training distance."""

    names: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts) * self.weights
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(length > 0, length, 1)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language index, cosine) of the nearest centroid."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return self.owner[best], np.clip(cosines[np.arange(len(best)), best], 0, 1)


def _clusters(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return centres


def fit_counts(counts: np.ndarray, langs: list[str], *, centroids: int = CENTROIDS, seed: int = 4) -> Languages:
    """Classifier from gram counts and languages of training texts."""
    rng = np.random.default_rng(seed)
    names, own = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    model = Languages(names.tolist(), weights, np.zeros((0, PLACES)), np.zeros(0, int), np.ones(len(names)))
    rows = model.vectors(counts)
    found = [_clusters(rows[own == i], centroids, rng) for i in range(len(names))]
    model.centroids = np.concatenate(found) if found else model.centroids
    model.owner = np.repeat(np.arange(len(names)), [len(x) for x in found])
    for i, centres in enumerate(found):
        model.radius[i] = 1 - (rows[own == i] @ centres.T).max(axis=1).min()
    return model


def fit(training: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Languages:
    """Classifier from rows with a language and a letter in the text; rows without either teach nothing.

    About ``sample`` texts of each language are drawn by a hash of their key and
    text, all if there are no more; sparse counts of these reach the driver.
    """
    rows = training.select(
        F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).where("lang IS NOT NULL")
    sizes = {row.lang: row["count"] for row in rows.groupBy("lang").count().collect()}
    if not sizes:
        return fit_counts(np.zeros((0, PLACES)), [])
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "key", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [gram_counts(value or "") for value in batch.column("text").to_pylist()]
            places = [np.flatnonzero(one).astype(np.int16) for one in found]
            counts = [one[at].astype(np.int32) for one, at in zip(found, places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(places, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.int32()))],
                names=["lang", "places", "counts"],
            )

    taught = drawn.mapInArrow(run, "lang string, places array<smallint>, counts array<int>").where("size(places) > 0")
    rows = taught.toArrow()
    held = sorted(zip(*(rows.column(name).to_pylist() for name in ("lang", "places", "counts")), strict=True))
    counts = np.zeros((len(held), PLACES))
    for at, (_, places, values) in enumerate(held):
        counts[at, places] = values
    return fit_counts(counts, [name for name, _, _ in held])


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes and rows."""
    for batch in slices(batches, column):
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def judge(
    model: Languages, texts: list[str | None], slack: float, least_grams: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text."""
    counts = np.stack([gram_counts(text or "") for text in texts])
    some = counts.any(axis=1) & bool(model.names)
    names, scores, lost = np.full(len(counts), UNDETERMINED, object), np.zeros(len(counts)), ~some
    if some.any():
        own, cosines = model.nearest(counts[some])
        names[some], scores[some] = np.array(model.names, object)[own], cosines
        known = (counts[some] > 0).sum(axis=1) >= least_grams
        lost[some] = known & (1 - cosines > model.radius[own] * slack)
    return names, scores, lost


def predict(
    df: DataFrame, model: Languages, *, key: str = "doc_id", text: str = "text", slack: float = 1.1, least_grams: int = 20
) -> DataFrame:
    """(key, lang, score, rejected) of every row.

    ``score`` is the cosine to the nearest centroid, 0 to 1. Texts that are null
    or have no letter are ``und`` with score 0 and rejected; so are all texts if
    nothing was learned. Ties go to the first centroid. Repeated rows and null
    keys are kept, other columns ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, "text"):
            names, scores, lost = judge(shared.value, batch.column("text").to_pylist(), slack, least_grams)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(names, pa.string()), pa.array(scores), pa.array(lost)],
                names=["key", "lang", "score", "rejected"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    found = rows.mapInArrow(run, f"key {kind}, lang string, score double, rejected boolean")
    return found.withColumnRenamed("key", key)



def accepted(df: DataFrame, model: Languages, *, text: str = "text", slack: float = 1.1, least_grams: int = 20) -> DataFrame:
    """The rows of ``df`` whose language is not rejected, all columns unchanged, in one pass without a join."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, text):
            lost = judge(shared.value, batch.column(text).to_pylist(), slack, least_grams)[2]
            yield batch.filter(pa.array(~lost))

    return df.mapInArrow(run, df.schema)
