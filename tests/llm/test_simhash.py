from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tradeloom.llm import simhash
from tradeloom.llm.components import components
from tradeloom.llm.queries import QUERIES


def plain_fingerprint(text: str | None, shingle: int = 3) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [word for word in words.split(" ") if word]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashed = [xxhash.xxh64_intdigest(part.encode(), 42) for part in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashed) > len(hashed))


def plain_components(rows: dict[int, int], distance: int) -> dict[int, int]:
    ids = sorted(rows)
    label = {i: i for i in ids}
    prints = np.array([rows[i] for i in ids], np.uint64)
    changed = True
    while changed:
        changed = False
        for at, i in enumerate(ids):
            near = [ids[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= distance)]
            least = min(label[j] for j in near)
            for j in near:
                if label[j] != least:
                    label[j], changed = least, True
    return label


@pytest.mark.parametrize("node_rows", [1 << 16, 40])
def test_links_equal_brute_force(spark, node_rows):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 1 << 63]
    rows = {}
    for i in range(900):
        value = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            value ^= 1 << rng.randrange(64)
        rows[i] = value
    values = spark.createDataFrame(
        [(v - 2**64 if v >= 2**63 else v,) for v in set(rows.values())], "value bigint"
    )
    found = {r.node: r.component for r in components(simhash.near_links(values, 3, node_rows=node_rows)).collect()}
    want = plain_components(rows, 3)
    signed = {i: v - 2**64 if v >= 2**63 else v for i, v in rows.items()}
    by_class, by_want = {}, {}
    for i, v in signed.items():
        by_class.setdefault(found.get(v, v), set()).add(i)
        by_want.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_want.values()))


def test_dense_ball(spark):
    values = [(1 << i) | (1 << j) for i in range(40) for j in range(i, 40)]
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    links = simhash.near_links(df, 3, node_rows=100)
    assert {r.component for r in components(links).collect()} == {1}


def test_odd_rows(spark):
    rows = [(5, None), (7, ""), (9, " \n "), (4, "one"), (3, "ONE"), (8, "é two"), (8, "é two"), (None, "null key"), (2, "a b c " * 5000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, fingerprint int, component string")
    got = simhash.groups(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.component or 0) for r in got) == [
        (False, 0, 0), (True, 2, 2), (True, 3, 3), (True, 4, 3), (True, 5, 5), (True, 7, 5), (True, 8, 8), (True, 8, 8), (True, 9, 5)
    ]
    assert simhash.groups(df.limit(0)).count() == 0
    kept = simhash.representatives(df.withColumn("kept", F.lit(0)))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect())[:2] == [(0, "null key"), (2, "a b c " * 5000)]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 8] and "kept" in kept.columns


def test_query_equals_brute_force(spark, small):
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    prints = {i: plain_fingerprint(text) for i, text in rows.items()}
    want = plain_components(prints, 3)
    got = QUERIES["op2_simhash"](spark, small).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", want[i]) for i in rows
    } and len(got) == len(rows)
