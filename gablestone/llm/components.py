"""Connected components of a table of links, by alternating stars and local union-find.

Each task first unites its own links, which leaves a forest of what it was given; then
every node is tied to the smallest of its neighbours, in turns with every larger and with
every smaller neighbour, until nothing changes. Minima are aggregated before the shuffle,
and a node with very many links is a skewed join side that Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestone.llm.common import Scratch

#: Links that a task's union-find holds at once.
LOCAL_LINKS = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def forest() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LOCAL_LINKS:
            yield forest()
            parent.clear()
    yield forest()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node."""
    edges = scratch.keep(links.where("a != b").mapInArrow(_unite, "a long, b long"))
    while True:
        # Large star: larger neighbours go to the smallest node around.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.where("a != b").distinct())
        # It is done when every node has one link, to a node without links to smaller ones.
        if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
