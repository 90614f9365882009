"""Connected components of links, by rounds of re-hanging links on the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.plans.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a bigint, b bigint).

    Each round hangs the larger neighbours of a node, then the smaller ones, on
    its smallest neighbour, until the links are stars. Only minima per node are
    grouped, so a hub is never gathered in one place. Every round is stored in
    the shared folder; the driver sees two numbers per round. Links of a node
    with itself count as the node alone; null ends are ignored; no links, no rows.
    """
    nodes = links.where("a IS NOT NULL AND b IS NOT NULL")
    star = stored(nodes.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct(), "links")
    size = _signature(star)
    while size[0]:
        both = star.selectExpr("u AS x", "v AS y").union(star.selectExpr("v AS x", "u AS y"))
        lowest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(lowest, "x").selectExpr("y AS u", "m AS v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").selectExpr("v AS u", "m AS v")
        star = stored(small.union(lowest.selectExpr("u", "m AS v")).distinct(), "links")
        before, size = size, _signature(star)
        if size == before:
            break
    hung = star.selectExpr("u AS node", "v AS component").union(star.selectExpr("v AS node", "v AS component"))
    return hung.union(nodes.where("a = b").selectExpr("a AS node", "a AS component")).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _signature(star: DataFrame) -> tuple[int, int]:
    row = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
