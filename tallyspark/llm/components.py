"""Connected components of links, as rounds of grouped minima over stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage

LINKS_PER_TASK = 500_000


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, root): every node of a link with the least node it is connected to.

    First each task contracts the links of one range of nodes, which removes long chains. Then rounds follow: the larger
    neighbours of every node are linked to its least neighbour, then the smaller ones likewise; both keep components and
    shorten paths, and the rounds end when all links point at roots. No neighbourhood is collected: a node's minimum is an
    aggregate that combines before the shuffle.
    """
    a, b = F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
    raw = stage(links.filter(F.col(left) != F.col(right)).select(a, b).distinct(), "links")
    tasks = raw.count() // LINKS_PER_TASK + 1
    edges = stage(raw.repartitionByRange(tasks, "a").coalesce(tasks).mapInArrow(_contract, raw.schema).distinct(), "links")
    while not _pointing_at_roots(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = stage(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(least.filter("root != a").select("a", F.col("root").alias("b"))).distinct(),
            "large",
        )
        down = large.groupBy("a").agg(F.min("b").alias("root"))
        edges = stage(
            large.join(down, "a").filter("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(down.select("a", F.col("root").alias("b"))).distinct(),
            "small",
        )
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _pointing_at_roots(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node without one."""
    ups = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    crossed = edges.join(ups.select(F.col("a").alias("b")), "b", "left_semi")
    return ups.filter("links > 1").isEmpty() and crossed.isEmpty()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: each node with the least node it reaches by them."""
    up: dict = {}

    def root(node):
        top = node
        while (above := up.get(top, top)) != top:
            top = above
        while node != top:
            up[node], node = top, up[node]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, two = root(a), root(b)
            up.setdefault(a, a)
            up.setdefault(b, b)
            if one != two:
                up[max(one, two)] = min(one, two)
    nodes = [n for n in up if root(n) != n]
    if nodes:
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind.field(0).type), pa.array([root(n) for n in nodes], kind.field(1).type)], ["a", "b"]
        )
