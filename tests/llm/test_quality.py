from __future__ import annotations

import random

import numpy as np
import pytest

from tradeloom.llm import quality
from tradeloom.llm.queries import QUERIES


def test_scores_equal_plain_densities(spark):
    rng = np.random.default_rng(1)
    size = len(quality.NAMES)
    rows = [(int(i % 3 > 0), (rng.standard_normal(size) * (1 + i % 3) + i % 3).tolist()) for i in range(600)]
    df = spark.createDataFrame([*rows, (7, [1.0] * size), (None, [1.0] * size)], "label int, stats array<double>")
    model = quality.fit(df)
    points = rng.standard_normal((50, size)) * 2
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    spreads = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    common = sum((y == c).mean() * spreads[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        shrunk = 0.98 * (0.9 * spreads[c] + 0.1 * common) + 0.02 * np.diag(np.diag(common) + 1e-6) + 1e-9 * np.eye(size)
        diff = points - x[y == c].mean(axis=0)
        far = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(shrunk), diff)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * far)
    assert model.scores(points) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_odd_rows(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choices(["some", "plain", "words", "here."], k=40)) for _ in range(40)]
    bad = [" ".join(rng.choices(["SOME", "###", "$$$", "HERE!!"], k=40)) for _ in range(40)]
    texts = [*good, *bad, None, "", " \n", "plain words " * 30_000, good[0], good[0]]
    rows = [(i, text, "x", 0) for i, text in enumerate(texts)] + [(None, good[1], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string, label int")
    known = [(i, int(i < 40)) for i in range(80)] + [(None, 1), (3, None), (5, 9), (9999, 1), (4, 1)]
    labels = spark.createDataFrame(known, "doc_id bigint, label int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.kept == (r.doc_id < 40) for r in got if r.doc_id is not None and r.doc_id < 80)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert quality.classify(df.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(df, labels.where("label = 1")).collect()} == {1.0}


def test_held_out_accuracy(spark, medium):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = QUERIES["op7_quality"](spark, medium).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    poor = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.05 * len(poor)
