from __future__ import annotations

import random
import re
from collections import Counter

from tradeloom.llm import hosts
from tradeloom.llm.hosts import host_rates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def test_measures_equal_plain_python(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 30, "é|ü\nz\n\nz\n z", "a\x0bb\x1cc\x85d"]
    for _ in range(120):
        words = rng.choices(["a", "bé", "c#", "d", "|", "e\n", "f\n"], k=rng.randint(0, 80))
        texts.append(" ".join(words))
    texts.append("long text with words " * 4000)
    rows = [(i, text, "h", 0, 0) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate int, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in hosts.verdicts(df).collect()}
    assert got == {i: plain(text) for i, text in enumerate(texts)}


def test_hosts_are_shrunk_and_joined_back(spark):
    good, bad = "a clean text of rather many different words that says one thing only once", "short text"
    rows = [(i, bad, "bad") for i in range(60)] + [(100 + i, good, "good") for i in range(200)]
    rows += [(300, good, "bad"), (301, bad, "tiny"), (302, good, "tiny"), (303, good, None), (303, good, None), (None, good, "good")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = hosts.verdicts(df).collect()
    assert len(got) == len(rows)
    kept = {(r.doc_id, r.kept) for r in got}
    assert (300, False) in kept and (302, True) in kept and (301, False) in kept and (303, True) in kept and (None, True) in kept
    rate = {r.doc_id: r.rate for r in got}
    assert 0.9 < rate[300] < 61 / 61 and rate[301] < 0.5 and 0 < rate[100] < 0.05
    assert hosts.verdicts(df.limit(0)).count() == 0


def test_rates_without_spread(spark):
    judged = spark.createDataFrame([("a", False), ("b", False), (None, False)], "host string, failed boolean")
    assert {(r.host, r.rate) for r in host_rates(judged).collect()} == {("a", 0.0), ("b", 0.0), (None, 0.0)}
