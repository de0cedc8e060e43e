"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

1. Each text gives its set of word shingles, a digest of the set and a SuperMinHash signature: every element walks a random
   permutation of the signature's places, and the r-th step offers r plus a random fraction; once all places hold less than r + 1 no
   later step can change them, so the walk stops early.  The signature is cut into bands.
2. Texts of one set are one node, whatever their number, so groups of copies meet once.
3. Nodes that share a band are candidates.  Each bucket is a star: its members are compared with the one that meets most others, never all with all.
4. Buckets of three and more whose members then lie in several components have their remaining pairs compared: across components only, and
   only where exact bounds on the intersection allow a link (:func:`residual_pairs`).
5. Links count if they hold on the full sets; components come from union-find inside partitions, then rounds of stars.

With 36 bands of 5 rows a pair of similarity 0.8 shares no band with probability 6e-7; one above that less.

Edge cases: null, empty and wordless texts have no shingles and link with nothing; fewer words than a shingle are one
shingle; equal texts are linked; rows that share a doc_id are linked by their texts only, and a row is kept if its id is its
component's; a row with a null doc_id belongs to its copies' component, and is never kept unless it has no words or no row with an id shares its
set; an empty table gives no rows; other columns are ignored; very long texts go through in blocks of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.components import connected as components

from .shared import materialise
from .shingles import GOLDEN, blocks, mix, shingle_sets

BANDS = 36
ROWS = 5
SHINGLE = 5
PERCENT = 80
#: Least 64-bit words of the bitmap that stands for a set in a mixed bucket, and its least bits for each shingle: what is in one set only seldom meets a bit of the other.
WORDS = 32
SPREAD = 8
#: Members of a block, and bytes of their bitmaps; two blocks are compared at once.
SPLIT = 1000
SPLIT_BYTES = 1 << 23
#: 64-bit words that are compared at once.
AT_ONCE = 1 << 21
#: Steps that are worked out from their history; beyond these a text's permutations are kept as a table.
CHAINED = 8


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of a non-empty set of 64-bit hashes: ``step << 32 | fraction`` at each of ``m`` places."""
    low = np.uint64(0xFFFFFFFF)
    shift = np.uint64(32)
    found = np.full(m, np.iinfo(np.uint64).max)
    steps = np.arange(1, m + 1, dtype=np.uint64) * GOLDEN
    picks: list[np.ndarray] = []
    table = None
    for j in range(m):
        z = mix(elements + steps[j])
        pick = j + (((z & low) * np.uint64(m - j)) >> shift).astype(np.int64)
        if j < CHAINED:
            place = pick
            for i in range(j - 1, -1, -1):
                place = np.where(picks[i] == place, i, place)
            picks.append(pick)
        else:
            rows = np.arange(len(elements))
            if table is None:
                table = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                for i, p in enumerate(picks):
                    table[rows, p], table[:, i] = table[:, i].copy(), table[rows, p]
            place = table[rows, pick]
            table[rows, pick] = table[:, j]
        np.minimum.at(found, place, (z >> shift) | (np.uint64(j) << shift))
        if found.max() < np.uint64(j + 1) << shift:
            break
    return found


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signature.reshape(bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
    for k in range(rows):
        key = mix(key * GOLDEN + cut[:, k])
    return key.view(np.int64)


SIGNATURES = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, block in blocks(batch.column("text").to_pylist()):
            sets = shingle_sets(block, k)
            keys = [band_keys(super_minhash(x, bands * rows), bands, rows) if len(x) else None for x in sets]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(block)) for c in ("doc_id", "text_key")), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "digest", "bands"])


def _texts_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows (node, digest, text) those whose text has the node's set."""
    for batch in batches:
        own = batch.column("digest").to_pylist()
        right = []
        for first, block in blocks(batch.column("text").to_pylist()):
            right += [len(x) > 0 and hashlib.blake2b(x.tobytes(), digest_size=16).digest() == own[i] for i, x in enumerate(shingle_sets(block, k), first)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text")], ["node", "text"]).filter(pa.array(right, pa.bool_()))


def _sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, block in blocks(batch.column("text").to_pylist()):
            sets = [x.view(np.int64) for x in shingle_sets(block, k)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, len(block)), lists], ["node", "hashes"])


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, hashes, alone): how many hashes aren't alone, and a bitmap of these."""
    for batch in batches:
        sizes, bitmaps = [], []
        for hashes, alone in zip(batch.column("hashes"), batch.column("alone"), strict=True):
            own = np.setdiff1d(hashes.values.to_numpy(), alone.values.to_numpy() if alone.is_valid else [], assume_unique=True)
            bits = np.zeros(max(64 * WORDS, 1 << (SPREAD * len(own)).bit_length()), np.uint8)
            bits[own.view(np.uint64) & np.uint64(len(bits) - 1)] = 1
            sizes.append(len(own))
            bitmaps.append(np.packbits(bits).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.list_(pa.int64()))], ["node", "s", "bitmap"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Size of the intersection of each pair's full sets, and whether it links them."""
    last, lead = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, texts = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a").to_pylist()
        found = []
        for first, block in blocks(batch.column("text_b").to_pylist()):
            for i, other in enumerate(shingle_sets(block, k), first):
                if a[i] != last:
                    last, lead = a[i], shingle_sets([texts[i].encode("utf-8", "surrogatepass")], k)[0]
                common = len(np.intersect1d(lead, other, assume_unique=True))
                union = len(lead) + len(other) - common
                found.append((common, 100 * common >= percent * union))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_())], ["a", "b", "common", "linked"])


def may_link(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of two blocks that lie in two components and that no bound rules out."""
    at = lambda name: (x[name][:, None], y[name][None, :])
    n, s, common = at("n"), at("s"), at("common")
    least, total = np.minimum(*s), n[0] + n[1]
    inside, outside = np.minimum(least, np.minimum(*common)), np.minimum(least, np.minimum(n[0] - common[0], n[1] - common[1]))
    open_ = np.not_equal(*at("component")) & (100 * least >= percent * np.maximum(*n)) & ((100 + percent) * np.minimum(least, inside + outside) >= percent * total)
    i, j = np.nonzero(open_)
    several = [z["s"] - np.bitwise_count(z["bitmap"]).sum(1, dtype=np.int64) for z in (x, y)]
    step = max(1, AT_ONCE // x["bitmap"].shape[1])
    both = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(x["bitmap"][i[k : k + step]] & y["bitmap"][j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step))])
    most = np.minimum(several[0][i], several[1][j]) + both
    fits = (100 + percent) * most >= percent * (x["n"][i] + y["n"][j])
    return i[fits], j[fits]


def folded(bitmap: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of hashes modulo its bits as one of ``n`` words."""
    while len(bitmap) > n:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


def alike(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Two blocks as parts with bitmaps of one size."""
    sizes = [np.array([len(b) for b in z["bitmap"]]) for z in (x, y)]
    for a in np.unique(sizes[0]):
        for b in np.unique(sizes[1]):
            parts = [{c: v[own] for c, v in z.items()} for z, own in ((x, sizes[0] == a), (y, sizes[1] == b))]
            yield tuple(part | {"bitmap": np.stack([folded(m, min(a, b)) for m in part["bitmap"]])} for part in parts)


BLOCK = ("lead", "lo", "hi", "part", "node", "component", "n", "common", "s")


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (lead, lo, hi), each such block bounded, to the pairs of a block that may be linked."""

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in BLOCK}
        bitmaps = np.empty(batch.num_rows, object)
        for k, x in enumerate(batch.column("bitmap")):
            bitmaps[k] = x.values.to_numpy().view(np.uint64)
        return own | {"bitmap": bitmaps}

    def pairs(block: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        one = block["part"] == block["lo"][0]
        other = one if block["lo"][0] == block["hi"][0] else ~one
        y = {c: v[other] for c, v in block.items()}
        for first in range(0, int(one.sum()), 64):
            for u, v in alike({c: v[one][first : first + 64] for c, v in block.items()}, y):
                i, j = may_link(u, v, percent)
                a, b = np.minimum(u["node"][i], v["node"][j]), np.maximum(u["node"][i], v["node"][j])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        held = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = (held["lead"][1:] != held["lead"][:-1]) | (held["lo"][1:] != held["lo"][:-1]) | (held["hi"][1:] != held["hi"][:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from pairs({c: v[a:b] for c, v in held.items()})
        held = {c: v[cuts[-1] :] for c, v in held.items()}
    if held is not None:
        yield from pairs(held)


def residual_pairs(placed: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """``placed(key, lead, node, n, common, component)`` and ``bodies(node, text)`` to the pairs (a, b) of buckets that lie in two components and may be linked.

    The buckets of one lead are compared as one, so that a pair meets once for each lead it shares.  All bounds are exact.  A shingle that stands in one node
    of these alone is common to no pair; a node with too many of them has no link.  Of the others, what the two bitmaps show to be in one
    set only is not common; nor can two nodes have more in common than the smaller of their parts inside the lead plus the smaller of
    their parts outside.  Bitmaps grow with the sets, so the bound is as near for long texts as for short ones.  Members of a lead are split into blocks of about
    ``SPLIT`` rows and ``SPLIT_BYTES``; each pair of blocks is compared in one task.
    """
    several = lambda rows, by, *more: rows.groupBy(by).agg(F.min("component").alias("first"), F.max("component").alias("last"), *more).where("first < last").drop("first", "last")
    mixed = materialise(placed.join(several(placed, "key"), "key").select("lead", "node", "n", "common", "component").distinct(), "mixed-buckets")
    sets = materialise(bodies.join(mixed.select("node").distinct(), "node", "left_semi").mapInArrow(lambda it: _sets_of(it, k), "node long, hashes array<long>"), "mixed-sets")
    once = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
    alone = once.groupBy("node").agg(F.collect_list("h").alias("alone"))
    outlines = sets.join(alone, "node", "left").select("node", "hashes", "alone").mapInArrow(_outline, "node long, s long, bitmap array<long>")
    open_ = materialise(mixed.join(outlines, "node").where(f"100 * s >= {percent} * n"), "open-buckets")
    parts = F.greatest(F.expr(f"1 + count(*) div {SPLIT}"), F.expr(f"1 + sum(8L * size(bitmap)) div {SPLIT_BYTES}"))
    left = open_.join(several(open_, "lead", parts.alias("parts")), "lead").withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    dealt = left.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    blocks_ = dealt.select(*BLOCK, "bitmap").repartition("lead", "lo", "hi").sortWithinPartitions("lead", "lo", "hi")
    return blocks_.mapInArrow(lambda it: _block_pairs(it, percent), "a long, b long").where("a < b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_shingles, component_id, kept, class_no, text_key), one row a document.

    ``class_no`` numbers the classes (null without words); ``text_key`` is a hash of the text, which tells rows apart that share an id.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    signed = materialise(texts.mapInArrow(lambda it: _sign(it, shingle, bands, rows), SIGNATURES), "signatures")

    with_id = signed.where("digest is not null and doc_id is not null")
    sets = with_id.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # all further steps read the members of shared buckets only
    shared = materialise(keys.join(buckets, "key").select("key", "node", "n", "members"), "shared-buckets")
    # the member that meets most others leads: near the middle of its group, it links most and bounds best
    meets = shared.groupBy("node").agg(F.sum("members").alias("meets"))
    leads = shared.join(meets, "node").groupBy("key").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("lead"))
    members = materialise(shared.join(leads, "key"), "members")

    chosen = members.select(F.col("node")).distinct().join(nodes.select("node", "digest", "first_id"), "node")
    joined = texts.join(chosen, texts["doc_id"] == chosen["first_id"]).select("node", "digest", "text")
    bodies = materialise(joined.mapInArrow(lambda it: _texts_of(it, shingle), "node long, text string").dropDuplicates(["node"]), "candidate-texts")

    def compared(pairs: DataFrame) -> DataFrame:
        right = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        full = right.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return materialise(full.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _compare(it, shingle, percent), "a long, b long, common long, linked boolean"), "compared")

    stars = compared(members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    links = stars.where("linked").select("a", "b")
    found = components(links)

    met = stars.select(F.col("a").alias("lead"), F.col("b").alias("node"), "common")
    large = members.where("members > 2 and node != lead").join(met, ["lead", "node"])
    placed = large.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "lead", "node", "n", "common", F.coalesce("component", "node").alias("component"))
    rest = residual_pairs(placed, bodies, shingle, percent)
    links = links.union(compared(rest.join(stars.select("a", "b"), ["a", "b"], "left_anti")).where("linked").select("a", "b"))

    found = components(links).withColumnRenamed("id", "node")
    classes = materialise(nodes.join(found, "node", "left").select("digest", "first_id", F.coalesce("component", "node").alias("class_no")), "classes")
    names = classes.groupBy("class_no").agg(F.min("first_id").alias("component"))
    # a row hangs on the node of its set
    placed = signed.where("digest is not null").join(classes.join(names, "class_no").select("digest", "class_no", "component"), "digest", "left")
    own = F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull())
    return placed.select("doc_id", "n_shingles", F.col("component").alias("component_id"), own.alias("kept"), "class_no", "text_key").unionByName(
        signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("class_no"), "text_key")
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents`` on four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")
