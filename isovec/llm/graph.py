"""Connected components of links by distributed union-find.

Each partition first joins its own links with a union-find and keeps one star a
tree. Then large-star and small-star rounds hook every node to the least node
that it sees until nothing changes; a round's links are written to the shared
folder, so that lineage stays short and lost executors cost one round at most,
and those of the round before are deleted. Neither links nor components ever
reach the driver, which sees a count and a checksum a round.

The root of a giant component is one join key. Only one row of it stands on the
joins' other side, so that its rows can be split over tasks, as Spark's skew
join does; minima by node are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialise, scratch_path

#: Links joined at a time in one task: the bound of its union-find.
FOREST = 500_000


class UnionFind:
    """Roots are the least members."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, kind = UnionFind(), None

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(own.parent) if (r := own.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own.union(x, y)
        if len(own.parent) > FOREST:
            yield stars()
            own = UnionFind()
    if own.parent:
        yield stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, label: str = "links") -> DataFrame:
    """From links (two columns of one kind, long or binary) to ``node``, ``root``: the
    least node of its component, for every node that is not a root itself. Nulls link nothing."""
    spark = links.sparkSession
    ship(spark)
    a, b = links.columns
    clean = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    path = scratch_path(spark, label)
    edges = materialise(clean.mapInArrow(_forest, clean.schema).distinct(), label, path)  # a > b
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))).where("a <> b").distinct()
        old, path = path, scratch_path(spark, label)
        edges = materialise(small, label, path)
        discard(spark, old)
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
