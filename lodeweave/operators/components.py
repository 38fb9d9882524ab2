"""Connected components by distributed union-find.

Each task builds the forest of its own edges. Roots that meet in a node of several forests become
the edges of the next, smaller graph, whose tasks are fewer; forests are merged level by level
until the graph is empty or fits one bounded task. A graph that stays large although its levels
are used up is finished by alternating star contraction, which only needs joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut, parallelism, ship

#: Edges that one task may hold (some 200 bytes each), and forests merged into one per level.
TASK_EDGES, FAN = 500_000, 8


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges (a, b) of one task: node and its root, the least node of its tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([find(x) for x in part])], names=["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component for all ends of the edges (a, b: strings); the label is the least node.

    Edges with a NULL end are ignored; repeated edges and loops are allowed; no edges, no rows.
    """
    ship(edges.sparkSession)
    spark = edges.sparkSession
    left = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a is not null and b is not null").distinct()
    levels, tasks = [], parallelism(spark)
    while True:
        trees = left.mapInArrow(forest, "node string, root string")
        # a node is in one tree of each task at most: its set of roots is bounded by the tasks
        level = cut(trees.groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", F.array_min("roots").alias("root"), "roots"))
        levels.append(level.select("node", "root"))
        links = level.filter("size(roots) > 1").select(F.col("root").alias("a"), F.explode("roots").alias("b")).filter("a <> b").distinct()
        count = links.count()
        if count == 0:
            break
        if count <= task_edges:
            levels.append(links.repartition(1).mapInArrow(forest, "node string, root string"))
            break
        if tasks == 1:
            levels.append(_stars(links))
            break
        tasks = max(1, tasks // FAN)
        left = links.repartition(tasks)
    return reduce(_through, reversed(levels[:-1]), levels[-1]).select("node", F.col("root").alias("component"))


def _through(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Roots of the lower level replaced by theirs of the upper one."""
    up = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return lower.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _stars(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star contraction."""
    current = cut(edges)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), F.col("a"), "m")
        after = cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        if after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        current = after
