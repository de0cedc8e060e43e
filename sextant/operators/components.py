"""Connected components of an edge table in a logarithmic number of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Vertices that a task holds at once.
HELD = 2_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition as stars around each component's smallest id, in blocks of bounded size."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def found() -> pa.RecordBatch:
        pairs = [(r, x) for r, x in ((find(x), x) for x in parent) if r != x]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield found()
            parent.clear()
    yield found()


def rounds(edges: DataFrame) -> Iterator[DataFrame]:
    """Edge tables (a < b) of the same components, each nearer to one star a component; the last one is such stars.

    Large stars hang the larger neighbours of every vertex on its smallest neighbour, small stars the smaller ones: paths halve each round.
    """

    def in_stars(e: DataFrame) -> DataFrame:
        return written(e.mapInArrow(_stars, "a long, b long"), "edges")

    edges = in_stars(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b"))
    while True:
        yield edges
        ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("hangs")).union(edges.select("b", F.lit(1)))
        if ends.groupBy("id").agg(F.min("hangs").alias("lo"), F.sum("hangs").alias("n")).where("n > 1 or (n = 1 and lo = 0)").isEmpty():
            return
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("a"))
        large = written(both.where("w > v").join(least, "v").select("a", F.col("w").alias("b")).distinct(), "large-stars")
        lower = large.groupBy("b").agg(F.min("a").alias("least"))
        small = large.join(lower, "b").select("least", F.explode(F.array("a", "b")).alias("end")).where("least != end")
        edges = in_stars(small.distinct().toDF("a", "b"))


def connected(edges: DataFrame, name: str = "component") -> DataFrame:
    """``edges(a, b)`` of long ids to (id, ``name``), the smallest id connected; ids without an edge to another are left out."""
    for stars in rounds(edges):
        found = stars
    return found.select(F.col("b").alias("id"), F.col("a").alias(name)).union(found.select("a", "a").distinct())
