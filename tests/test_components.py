from __future__ import annotations

import random

import pytest

from tradeloom.plans.components import components


def plain(edges) -> dict[int, int]:
    top: dict[int, int] = {}

    def find(node: int) -> int:
        while top.setdefault(node, node) != node:
            node = top[node]
        return node

    for a, b in edges:
        a, b = find(a), find(b)
        top[min(a, b)] = max(a, b)
    return {node: find(node) for node in top}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    kinds = {
        0: [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        1: [(i, i + 1) for i in range(300)] + [(1000, 1000)],
        2: [(7, rng.randrange(500)) for _ in range(400)] + [(600, 601)],
        3: [],
    }
    edges = kinds[seed]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == plain(edges)
