"""Quality scores by a regularised quadratic discriminant of document statistics.

Statistics of a text are transformed to be closer to normal. Each class has its
own mean and covariance; covariances are shrunk towards the pooled one and
towards a multiple of the identity. A text's score is the logistic of the
difference of the classes' log densities, from Mahalanobis distances computed
with the Cholesky factors that the model keeps. Means and covariances are sums
over all labelled rows, made by Spark.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.shared import slices, utf8
from tradeloom.plans.workspace import stored

CONTINUED = bytes(range(0x80, 0xC0))
WIDE = bytes(range(0x80, 0x100))
UPPER = string.ascii_uppercase.encode()
LOWER = string.ascii_lowercase.encode()
DIGITS = string.digits.encode()
STOPS = b".,;:"
CALLS = b"!?"
MARKS = b"#*$%&|<>~^=+_\\{}[]@/"
# Parts that a share takes to be without the feature, besides those of the text.
CHARACTERS, WORDS, LINES = 40, 10, 4
NAMES = (
    "words", "word_length", "upper", "digits", "stops", "calls", "marks", "distinct", "repeated", "lines", "wide", "ends"
)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text; of an empty text all are zero."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)

    def count(characters: bytes, of: bytes = text) -> int:
        return len(of) - len(of.translate(None, characters))

    n, size = len(words), sum(map(len, words))
    letters = count(UPPER + LOWER + WIDE)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = sum(map(eq, words, words[1:]))

    def share(part: int, whole: int, least: int = CHARACTERS) -> float:
        # The root of a share spreads small shares, as a log does, and is defined at zero. In a text of few
        # parts a share says little, so it is taken of somewhat more of them.
        return (part / (whole + least)) ** 0.5

    return [
        float(np.log1p(n)),
        float(np.log1p((size - count(CONTINUED)) / n)),
        share(count(UPPER), letters),
        share(count(DIGITS), size),
        share(count(STOPS), size),
        share(count(CALLS), size),
        share(count(MARKS), size),
        float(np.log1p(len(set(words))) / np.log1p(n)),
        share(repeated, n, WORDS),
        share(len(lines) - len(set(lines)), len(lines), LINES),
        share(count(WIDE), size),
        share(sum(1 for word in words if word[-1:] in (b".", b",")), n, WORDS),
    ]


def document_statistics(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) of every row, from whole texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [statistics(value or b"") for value in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.float64()))], names=["key", "stats"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.selectExpr(f"`{key}` AS key", f"CAST(`{text}` AS string) AS text")
    return rows.mapInArrow(run, f"key {kind}, stats array<double>")


@dataclass
class Discriminant:
    """Per class the log prior, the mean and the Cholesky factor of the shrunk covariance."""

    priors: list[float]
    means: list[np.ndarray]
    factors: list[np.ndarray]
    share: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(self.means) < 2:
            return np.full(len(rows), self.share)
        logs = []
        for prior, mean, factor in zip(self.priors, self.means, self.factors, strict=True):
            scaled = np.linalg.solve(factor, (rows - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (scaled * scaled).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, *, pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Discriminant from all rows of (label 0 or 1, stats array<double>).

    Counts, sums and products are summed by Spark; the driver gets them once per
    class and pair of statistics. With one class only, every score is 1 or 0;
    without rows it is 0.5.
    """
    size = len(NAMES)
    pairs = F.expr(
        f"flatten(transform(sequence(0, {size - 1}), i -> transform(sequence(i, {size - 1}), j -> named_struct('i', i, 'j', j, 'v', stats[i] * stats[j]))))"
    )
    alone = F.expr("transform(stats, (x, i) -> named_struct('i', i, 'j', -1, 'v', x))")
    rows = labelled.where("label IN (0, 1)")
    counts = {row.label: row["count"] for row in rows.groupBy("label").count().collect()}
    sums = (
        rows.select("label", F.explode(F.concat(alone, pairs)).alias("p")).groupBy("label", "p.i", "p.j").agg(F.sum("p.v").alias("v")).collect()
    )
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Discriminant([], [], [], share)
    means, spreads = [], []
    for label in (0, 1):
        mean, product = np.zeros(size), np.zeros((size, size))
        for row in (r for r in sums if r.label == label):
            if row.j < 0:
                mean[row.i] = row.v / counts[label]
            else:
                product[row.i, row.j] = product[row.j, row.i] = row.v / counts[label]
        means.append(mean)
        spreads.append(product - np.outer(mean, mean))
    common = sum(counts[label] / total * spreads[label] for label in (0, 1))
    scale = np.diag(np.diag(common) + 1e-6)
    factors = [
        np.linalg.cholesky((1 - ridge) * ((1 - pooled) * spread + pooled * common) + ridge * scale + 1e-9 * np.eye(size))
        for spread in spreads
    ]
    return Discriminant([float(np.log(counts[label] / total)) for label in (0, 1)], means, factors, share)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(key, score double) of every row of (key, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.scores(rows))], names=["key", "score"])

    kind = stats.schema["key"].dataType.simpleString()
    return stats.select("key", "stats").mapInArrow(run, f"key {kind}, score double")


def fit_documents(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label") -> Discriminant:
    """Discriminant from (key, label) rows whose key is in ``df``; only statistics are joined, no texts.

    Labels other than 0 and 1, and null keys, teach nothing; a key labelled more
    than once counts as the smaller label.
    """
    return fit(_labelled(document_statistics(df, key=key, text=text), labels, key, label))


def _labelled(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    known = labels.where(f"`{label}` IN (0, 1)").groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
    return stored(stats.join(known, "key").select("label", "stats"), "labelled")


def classify(
    df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label", least: float = 0.3
) -> DataFrame:
    """(key, score, kept) of every row, learning as ``fit_documents`` does.

    Empty and null texts are scored like any other. ``kept`` is score >=
    ``least``. Repeated rows and null keys are kept; an empty table gives no rows.
    """
    stats = stored(document_statistics(df, key=key, text=text), "statistics")
    model = fit(_labelled(stats, labels, key, label))
    return score(stats, model).select(F.col("key").alias(key), "score", (F.col("score") >= least).alias("kept"))


def accepted(df: DataFrame, model: Discriminant, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``df`` with a score of at least ``least``, all columns unchanged, in one pass without a join."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if batch.num_rows:
                stats = np.array([statistics(value or b"") for value in utf8(batch.column(text))])
                yield batch.filter(pa.array(shared.value.scores(stats) >= least))

    return df.mapInArrow(run, df.schema)
