"""Same-fact clusters as an ordered replay: a pair joins two clusters only if their representatives are alike too.

The result depends on the order in which pairs are met, so a component of the loose pairs is one sequence.  Its pairs stream through a task in that
order; the task holds the parents and anchor sets of that component's items, never its pairs.  Components are the items of one story
in one tab and language, chained by windows of 36 hours; a story so large that its items don't fit a task would have to be cut by time first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import ACROSS, COMMON, INSIDE, frequent_anchors, similar_pairs
from .components import connected
from .storage import written


def alike(a: frozenset, b: frozenset, least: float) -> bool:
    common = len(a & b)
    return common >= COMMON and common >= least * (len(a) + len(b) - common)


class Replay:
    """Union-find whose roots stand for their clusters: of two roots the one of the earlier item of the pair stays."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.sets: dict[int, frozenset] = {}

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def meet(self, a: int, b: int, set_a: list, set_b: list, least: float) -> None:
        for x, s in ((a, set_a), (b, set_b)):
            if self.parent.setdefault(x, x) == x and x not in self.sets:
                self.sets[x] = frozenset(s)
        a, b = self.find(a), self.find(b)
        if a != b and alike(self.sets[a], self.sets[b], least):
            self.parent[b] = a

    def clusters(self) -> list[tuple[int, int]]:
        """(item, smallest item of its cluster)."""
        smallest: dict[int, int] = {}
        for x in self.parent:
            root = self.find(x)
            smallest[root] = min(x, smallest.get(root, x))
        return [(x, smallest[self.find(x)]) for x in self.parent]


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(r: Replay) -> pa.RecordBatch:
        found = r.clusters()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["id", "cluster"])

    component, replay = None, Replay()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "a", "b", "inside", "set_a", "set_b")]
        for c, a, b, inside, set_a, set_b in zip(*columns, strict=True):
            if c != component:
                yield out(replay)
                component, replay = c, Replay()
            replay.meet(a, b, set_a, set_b, INSIDE if inside else ACROSS)
    yield out(replay)


def guarded_clusters(items: DataFrame) -> DataFrame:
    """``items(id, tab, lang, domain, ts, anchors)`` to (id, cluster); items come in the order of their ids.

    Pairs are met anchor by anchor, in the order in which anchors first appear in a block, then by the two items.
    """
    placed = items.select("id", "tab", "lang", F.posexplode("anchors").alias("pos", "anchor"))
    cut = frequent_anchors(placed.select("id", "tab", "lang", "anchor")).select("tab", "lang", "anchor")
    kept = written(placed.join(cut, ["tab", "lang", "anchor"], "left_anti"), "kept-anchors")
    firsts = kept.groupBy("tab", "lang", "anchor").agg(F.min(F.struct("id", "pos")).alias("first"))
    sets = written(kept.join(firsts, ["tab", "lang", "anchor"]).groupBy("id").agg(F.collect_list(F.struct("first", F.xxhash64("anchor").alias("h"))).alias("own")), "anchor-sets")
    pairs = written(similar_pairs(items).select("a", "b", "inside"), "pairs")
    found = connected(pairs)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").join(found.withColumnRenamed("id", "a"), "a")
    met = F.array_min(F.array_intersect("own_a", "own_b"))["first"]
    hashes = lambda c: F.transform(f"own_{c}", lambda x: x["h"])
    rows = full.select("component", met.alias("met"), "a", "b", "inside", hashes("a").alias("set_a"), hashes("b").alias("set_b"))
    ordered = rows.repartition("component").sortWithinPartitions("component", "met", "a", "b")
    clusters = ordered.mapInArrow(_replayed, "id long, cluster long")
    return items.select("id").join(clusters, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
