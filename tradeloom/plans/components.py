"""Sets of nodes that hang together, found without gathering any of them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.plans.workspace import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a bigint, b bigint): the greatest node of the set, so that one side names it.

    Every node points at a node of its set that is no smaller. A round lets the roots on
    the two ends of an edge meet, and then halves all paths by pointing at the pointer's pointer,
    so the rounds follow the logarithm of a set's diameter. Both steps are joins on
    a key and maxima per key, which are combined before the shuffle.
    """
    links = stored(edges.select("a", "b").distinct(), "edges")
    nodes = links.selectExpr("a AS node").union(links.selectExpr("b AS node")).distinct()
    roots = stored(nodes.selectExpr("node", "node AS root"), "roots")
    while True:
        left, right = roots.selectExpr("node AS a", "root AS x"), roots.selectExpr("node AS b", "root AS y")
        seen = links.join(left, "a").join(right, "b").filter("x <> y")
        raised = seen.selectExpr("least(x, y) AS node", "greatest(x, y) AS up").groupBy("node").agg(F.max("up").alias("up"))
        hooked = stored(raised, "hooks")
        if hooked.isEmpty():
            dropped(links, hooked)
            return roots.selectExpr("node", "root AS component")
        # Follow the hooks of roots to their ends; hooks only go up, so there are no circles.
        while True:
            further = hooked.alias("h").join(hooked.alias("n"), F.expr("h.up = n.node"), "left")
            step = stored(further.selectExpr("h.node", "coalesce(n.up, h.up) AS up", "n.up IS NOT NULL AS moved"), "hooks")
            moved = step.filter("moved").limit(1).count()
            dropped(hooked)
            hooked = step.select("node", "up")
            if not moved:
                break
        above = roots.alias("r").join(hooked.alias("h"), F.expr("r.root = h.node"), "left")
        risen = stored(above.selectExpr("r.node", "coalesce(h.up, r.root) AS root"), "roots")
        dropped(roots, step)
        roots = risen
