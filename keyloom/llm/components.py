"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, remove, written

#: More rounds than graphs of any feasible size take; reaching it is an error, never a partial result.
MOST_ROUNDS = 60
#: As many links as this, or fewer, are joined by one task, whose forest then holds 400,000 nodes at most.
AT_ONCE = 200_000


class Forest:
    """The trees that the links met in one task make, so that few links leave the task."""

    #: Nodes that a task holds before it begins anew.
    MOST = 500_000

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def _find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def add(self, u: int, v: int) -> bool:
        """Whether the link joins two trees."""
        if len(self.parent) > self.MOST:
            self.parent = {}
        a, b = self._find(u), self._find(v)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def joined(self, u: int, v: int) -> bool:
        return self._find(u) == self._find(v)

    def root(self, u: int) -> int:
        return self._find(u)

    def stars(self) -> list[tuple[int, int]]:
        """Each node with its tree's least node; the forest is empty after it."""
        out = [(x, root) for x in list(self.parent) if (root := self._find(x)) != x]
        self.parent = {}
        return out


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars on the least node of each tree."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        found = forest.stars()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        if len(forest.parent) + 2 * batch.num_rows > Forest.MOST:
            yield out()
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            forest.add(u, v)
    yield out()


def _star(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """Link neighbours to the least neighbour: those above the node (large) or those below it and itself (small).

    Nodes with more neighbours than half an average partition has rows are at most as many as there are
    partitions, times four; their least neighbours are broadcast, so that no task gets all their links.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    many = max(count // (2 * n_partitions(edges.sparkSession)), 100)
    frequent = least.where(F.col("n") > many).select("u", "m")
    marked = pairs.join(F.broadcast(frequent), "u", "left")
    others = marked.where("m IS NULL").select("u", "v").join(least.where(F.col("n") <= many).select("u", "m"), "u")
    joined = marked.where("m IS NOT NULL").select("u", "v", "m").unionByName(others.select("u", "v", "m"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def _stars(links: DataFrame) -> DataFrame:
    """``node, component`` of links that are all to a component's least node."""
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def connected_components(edges: DataFrame, *, at_once: int = AT_ONCE) -> tuple[DataFrame, list[str]]:
    """``node, component`` for each node in ``edges`` (longs ``u, v``), and scratch paths to remove later.

    ``component`` is the least node that can be reached. Pairs may repeat and be in any order; nodes
    are compared as numbers. Each round is written to the shared folder, which ends its lineage. A
    node with very many neighbours is spread over tasks; rounds go on until ``at_once`` links or fewer are left, if
    that many are ever left, and one task joins those.
    """
    spark = edges.sparkSession
    own = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    tidy = own.mapInArrow(_contracted, "u long, v long").distinct()
    now, path = written(tidy, "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        count = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == tuple(count) or not count[0]:
            return _stars(now), [path]
        state = tuple(count)
        last = count[0] <= at_once
        after, next_path = written(now.coalesce(1).mapInArrow(_contracted, "u long, v long") if last else _star(_star(now, True, count[0]), False, count[0]), "edges")
        remove(spark, path)
        now, path = after, next_path
        if last:
            return _stars(now), [path]
    raise RuntimeError("components did not settle")
