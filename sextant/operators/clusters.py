"""Same-fact clusters: items that share enough anchors inside a time window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .storage import written

#: Least Jaccard across and inside a domain, least common anchors, window, share that makes an anchor too common, least block for that cut.
ACROSS, INSIDE, COMMON, HOURS, FREQUENT, SMALL = 0.34, 0.60, 2, 36, 0.15, 20
#: Items of one anchor in one task.
SPLIT = 2000
#: Span of ids whose members of one cluster are digested together.
KEYED = 10_000


def frequent_anchors(exploded: DataFrame) -> DataFrame:
    """Anchors of over 15 % of a block's items, in blocks of 20 items and more."""
    sizes = exploded.groupBy("tab", "lang").agg(F.countDistinct("id").alias("block"))
    n = exploded.groupBy("tab", "lang", "anchor").agg(F.count("*").alias("n"))
    return n.join(sizes, ["tab", "lang"]).where((F.col("block") >= SMALL) & (F.col("n") > FREQUENT * F.col("block")))


def kept_anchors(items: DataFrame) -> DataFrame:
    """One row an item and anchor, without the anchors that are too common in their block."""
    exploded = written(items.select("id", "tab", "lang", "domain", "ts", F.explode("anchors").alias("anchor")), "anchors")
    return written(exploded.join(frequent_anchors(exploded).select("tab", "lang", "anchor"), ["tab", "lang", "anchor"], "left_anti"), "kept-anchors")


def similar_pairs(items: DataFrame, across: float = ACROSS, inside: float = INSIDE, hours: int = HOURS) -> DataFrame:
    """``items(id, tab, lang, domain, ts, anchors)`` to (a, b, common, jaccard, inside) of pairs that tell the same fact."""
    return pairs_of(kept_anchors(items), across, inside, hours)


def pairs_of(kept: DataFrame, across: float = ACROSS, inside: float = INSIDE, hours: int = HOURS, fresh: DataFrame | None = None) -> DataFrame:
    """Pairs of :func:`kept_anchors` rows, by an exact set-similarity join; with ``fresh(id)`` only those that hold one of these at least.

    An item's anchors are put in order from the rarest.  Two sets as alike as asked have their rarest common anchor near both heads: only so many anchors of an item are
    looked up that those left out couldn't make up the least similarity alone, so an anchor that many items hold is seldom looked up.  Items meet by such an
    anchor and a time bucket of the window's width; each item stands in its own bucket and its neighbours, which loses no pair.  A pair counts
    where it meets by its rarest common anchor, so once.  Items of an anchor with more than ``SPLIT`` are dealt over several tasks.
    """
    least = min(across, inside)
    counts = kept.groupBy("tab", "lang", "anchor").agg(F.count("*").alias("n"))
    sets = kept.join(counts, ["tab", "lang", "anchor"]).groupBy("id", "tab", "lang", "domain", "ts").agg(F.sort_array(F.collect_set(F.struct("n", "anchor"))).alias("own"))
    size = F.size("own")
    heads = size - F.greatest(F.ceil(least * size - 1e-9), F.lit(COMMON)).cast("int") + 1
    bucket = F.floor(F.unix_timestamp("ts") / (hours * 3600))
    looked_up = written(sets.where(size >= COMMON).withColumn("bucket", bucket).withColumn("x", F.explode(F.slice("own", F.lit(1), heads))), "looked-up-anchors")
    parts = F.expr(f"1 + x.n div {SPLIT}")
    if fresh is not None:
        looked_up = written(looked_up.join(fresh.select("id", F.lit(True).alias("fresh")), "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))), "marked-anchors")
    left = (looked_up.where("fresh") if fresh is not None else looked_up).withColumn("part", F.pmod(F.xxhash64("id"), parts))
    right = looked_up.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    a, b = left.alias("a"), right.alias("b")
    meet = F.expr("a.tab = b.tab and a.lang = b.lang and a.x = b.x and a.bucket = b.bucket and a.part = b.part and " + ("a.id < b.id" if fresh is None else "a.id != b.id and (not b.fresh or a.id < b.id)"))
    near = F.abs(F.unix_timestamp("a.ts") - F.unix_timestamp("b.ts")) <= hours * 3600
    n_a, n_b = F.size("a.own"), F.size("b.own")
    sizes = (n_a >= least * n_b - 1e-9) & (n_b >= least * n_a - 1e-9)
    met = a.join(b, meet & near & sizes).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), (F.col("a.domain") == F.col("b.domain")).alias("inside"), F.array_intersect("a.own", "b.own").alias("both"), F.col("a.x").alias("x"), (n_a + n_b).alias("total"))
    pairs = met.where(F.get("both", 0) == F.col("x")).select("a", "b", F.size("both").cast("long").alias("common"), "total", "inside")
    jaccard = F.col("common") / (F.col("total") - F.col("common"))
    return pairs.withColumn("jaccard", jaccard).where((F.col("common") >= COMMON) & (F.col("jaccard") >= F.when(F.col("inside"), inside).otherwise(across))).select("a", "b", "common", "jaccard", "inside")


def clustered(items: DataFrame, across: float = ACROSS, inside: float = INSIDE, hours: int = HOURS) -> DataFrame:
    """(id, cluster): items without a pair are clusters of their own.

    Items of one block, domain, time and anchor set are one item here, whatever their number: they have the same pairs, and pairs
    among themselves if they keep anchors enough.
    """
    kept = kept_anchors(items)
    sets = kept.groupBy("id", "tab", "lang", "domain", "ts").agg(F.sort_array(F.collect_set("anchor")).alias("kept")).where(F.size("kept") >= COMMON)
    same = written(sets.groupBy("tab", "lang", "domain", "ts", "kept").agg(F.min("id").alias("leader")), "leaders")
    alike = [sets[c].eqNullSafe(same[c]) for c in ("tab", "lang", "domain", "ts", "kept")]
    led = written(sets.join(same, alike).select("id", "leader"), "led")
    leaders = same.select(F.col("leader").alias("id"), "tab", "lang", "domain", "ts", F.explode("kept").alias("anchor"))
    found = connected(pairs_of(leaders, across, inside, hours), "cluster").withColumnRenamed("id", "leader")
    placed = led.join(found, "leader", "left").select("id", F.coalesce("cluster", "leader").alias("cluster"))
    return items.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def with_fresh(stored: DataFrame, fresh: DataFrame, across: float = ACROSS, inside: float = INSIDE, hours: int = HOURS) -> DataFrame:
    """(id, cluster) of all items, from ``stored(id, tab, lang, domain, ts, anchors, cluster)`` and new ``fresh`` ones, as :func:`clustered` has it over both.

    Only pairs with a new item are looked for; their links and the stored clusters make the components.  What is too common in a block can change with the new items; in
    blocks where it does, stored clusters no longer hold, and their items count as new.
    """
    items = stored.drop("cluster").unionByName(fresh.select(stored.drop("cluster").columns))
    exploded = lambda rows: rows.select("id", "tab", "lang", F.explode("anchors").alias("anchor"))
    before = frequent_anchors(exploded(stored)).select("tab", "lang", "anchor", F.lit(1).alias("was"))
    now = frequent_anchors(exploded(items)).select("tab", "lang", "anchor", F.lit(1).alias("is"))
    turned = written(before.join(now, ["tab", "lang", "anchor"], "full").where("was is null or is is null").select("tab", "lang").distinct(), "turned-blocks")
    again = stored.join(turned, ["tab", "lang"], "left_semi").select("id")
    held = stored.join(turned, ["tab", "lang"], "left_anti").where("id != cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
    pairs = pairs_of(kept_anchors(items), across, inside, hours, fresh=written(fresh.select("id").union(again), "fresh-items"))
    found = connected(pairs.select("a", "b").union(held), "cluster")
    return items.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def summaries(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members, domains, time span and a key of the members: a digest of the digests of their sorted ids, part by part of ``KEYED`` ids, so that no task holds the whole list."""
    joined = items.join(clusters, "id")
    parts = joined.groupBy("cluster", F.expr(f"id div {KEYED}").alias("part")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("id").cast("long"))).cast("array<string>"), ","), 256).alias("digest"), F.count("*").alias("n"), F.collect_set("domain").alias("domains"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n_items"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ",").alias("digests"))
    domains = parts.select("cluster", F.explode("domains").alias("domain")).groupBy("cluster").agg(F.countDistinct("domain").alias("n_domains"))
    # a null domain counts for none
    return whole.join(domains, "cluster", "left").select("cluster", "n_items", F.coalesce("n_domains", F.lit(0).cast("long")).alias("n_domains"), "first_ts", "last_ts", F.substring(F.sha2("digests", 256), 1, 20).alias("cluster_key"))


def mid_rank_percentile(items: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds the batch size and the percentile (less + equal / 2) / n * 100; one item alone has 50.

    Ranks are taken over the different values of a batch, counted first, so a large batch doesn't meet in one task; the items find theirs by a join.
    """
    keys = [*by, value]
    counts = items.groupBy(*(F.col(c).alias(f"rank_{k}") for k, c in enumerate(keys))).agg(F.count("*").alias("rank_n"))
    part = Window.partitionBy(*(f"rank_{k}" for k in range(len(by))))
    less = F.coalesce(F.sum("rank_n").over(part.orderBy(f"rank_{len(by)}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("rank_n").over(part)
    ranks = counts.select(*(f"rank_{k}" for k in range(len(keys))), n.alias("batch"), ((less + 0.5 * F.col("rank_n")) / n * 100).alias("percentile"))
    met = reduce(lambda a, b: a & b, (items[c].eqNullSafe(ranks[f"rank_{k}"]) for k, c in enumerate(keys)))
    return items.join(ranks, met).select(*(items[c] for c in items.columns), "batch", "percentile")
