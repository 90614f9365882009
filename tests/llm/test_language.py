from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tradeloom.llm import language
from tradeloom.llm.queries import QUERIES


def plain_counts(text: str) -> np.ndarray:
    points, shift = [0], 32 - language.PLACES.bit_length() + 1
    for char in text.lower():
        point = ord(char) if char.isalpha() else 0
        if point or points[-1]:
            points.append(point)
    if points[-1]:
        points.append(0)
    counts, m = np.zeros(language.PLACES, np.int64), [int(x) for x in language.MULTIPLIERS]
    for k in (2, 3):
        for at in range(len(points) - k + 1):
            value = 0
            for point, factor in zip(points[at : at + k], m, strict=False):
                value ^= point * factor & 0xFFFFFFFF
            counts[value >> shift] += 1
    return counts


def test_grams_equal_plain_python(monkeypatch):
    rng = random.Random(2)
    texts = ["", " ", "a", "ab", "A b", "...", "été 12 über", "ab\n\ncd!", "日本 x😀y"]
    texts += ["".join(rng.choices("abcé ñ.1\n", k=rng.randint(0, 60))) for _ in range(60)]
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(language, "PIECE", piece)
        for text in texts:
            want = plain_counts(text) if any(c.isalpha() for c in text) else np.zeros(language.PLACES)
            assert (language.gram_counts(text) == want).all(), (piece, text)


def test_odd_rows(spark):
    rng = random.Random(6)

    def made(letters):
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(40))

    rows = [(i, made("abcde"), "xx") for i in range(40)] + [(100 + i, made("vwxyz"), "yy") for i in range(40)]
    rows += [(200, made("abcde"), None), (201, None, "xx"), (202, "", "xx"), (203, "12 - 3", "yy"), (None, made("vwxyz"), None)]
    rows += [(204, made("àáâãä"), None), (205, made("vwxyz") * 500, None), (200, "eca bad", None)]
    df = spark.createDataFrame([(*row, 0.5) for row in rows], "doc_id bigint, text string, lang string, score double")
    model = language.fit(df)
    got = {(r.doc_id, r.lang, r.rejected) for r in language.predict(df, model).where("doc_id >= 200 OR doc_id IS NULL").collect()}
    assert {(200, "xx", False), (201, "und", True), (202, "und", True), (203, "und", True), (None, "yy", False)} < got
    assert (205, "yy") in {row[:2] for row in got}
    assert any(doc_id == 204 and rejected for doc_id, _, rejected in got)
    assert language.predict(df.limit(0), model).count() == 0
    nothing = language.fit(df.where(F.lit(False)))
    assert {r.lang for r in language.predict(df, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark, medium):
    truth = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = QUERIES["op4_language_id"](spark, medium).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == truth.count() and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.truth for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows)
