"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its token count, then its first tokens, where a token with a digit is a variable.  In a leaf
a token is constant at its place if lines with it there stand in ``min_docs`` line sets; digits and rarer tokens are variable, and lines of the
same constants at the same places are one template.  A template of mostly constant tokens that recurs across documents is dropped
from all of them, and so is a line that recurs as it stands.  The leaf's own leading tokens don't make a template alone: it has a
constant beyond them, or a digit in every variable's token.

Templates of one leaf are told apart in rounds: what is a field of one may be common only because of another, so the lines of the templates found are taken out and the
leaf is looked at again, until it gives no more.  No share of the leaf plays a part, so other lines and their number don't hide a template.

Copies of a document are one document here: a line's support is the number of different line sets it stands in, each known by
a digest of the whole set; how many copies there are doesn't matter.  A near copy has a line set of its own, so the
documents that mostly consist of lines of other sets are grouped as near-duplicate removal groups them, and a group counts once, else a
few near copies would lose all they share.  Groups of copies are left to near-duplicate removal.

Only lines in shared leaves move with their text.  A bitmap of fixed size over leaf hashes finds them in the scan, an exact join follows.

Edge cases: a null text stays null; lines without a word and lines of fewer than ``min_tokens`` tokens are never dropped and don't count;
a line that repeats inside a document counts once, as do its lines of one template; rows that share a doc_id lose the same lines; an empty table gives no rows; what stands in
``min_docs`` line sets exactly recurs; other columns stay as they are; very long texts are one row's array of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_duplicates import near_duplicates
from .quality_rules import SPACE, let, words
from .shared import materialise

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 5
#: Least share of constant tokens in a template.
SIMILAR = 0.6
#: Share of a document's characters in lines that stand in other line sets too, from which it may be a near copy.
COPIED = 0.5
#: Bits of the bitmap of shared leaves: 16 a leaf within these bounds (32 KB and 2 MB); if more leaves than that are shared, more lines pass on to the join.
BITS = (1 << 18, 1 << 24)
VARIABLE = "<*>"


def mask(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(token)


def leaf_of(tokens: Column, depth: int) -> Column:
    return F.xxhash64(F.size(tokens), *(mask(F.get(tokens, k)) for k in range(depth)))


def lines_in(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "\n")), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)


def set_of(lines: Column) -> Column:
    """Digest of a whole line set."""
    return F.xxhash64(F.sort_array(F.transform(lines, lambda x: F.xxhash64(x))))


def lines_of(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc_id, document, chars, line, leaf): each line of each document once; ``document`` stands for its line set of ``chars`` characters."""
    place = lambda x: let(words(x), lambda w: F.struct(x.alias("line"), leaf_of(w, depth).alias("leaf"), F.size(w).alias("n")))
    chars = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    both = let(lines_in(F.col("text")), lambda s: F.struct(F.transform(s, place).alias("lines"), set_of(s).alias("document"), chars(s).alias("chars")))
    # an outer explode: where only leaves are read, the filters that Spark infers for an inner one work all lines out twice more; null rows fail the filter on n
    found = docs.where("text is not null").select("doc_id", both.alias("x")).select("doc_id", "x.document", "x.chars", F.explode_outer("x.lines").alias("y"))
    return found.where(F.col("y.n") >= min_tokens).select("doc_id", "document", "chars", "y.line", "y.leaf")


def in_bitmap(leaf: Column, bitmap: list[int]) -> Column:
    at = F.pmod(leaf, F.lit(64 * len(bitmap))).cast("int")
    return F.getbit(F.get(F.lit(bitmap).cast("array<long>"), F.floor(at / 64).cast("int")), at % 64) == 1


def bitmap_of(leaves: DataFrame) -> list[int]:
    """Leaf hashes modulo the number of bits, as longs."""
    bits = min(BITS[1], max(BITS[0], 1 << (16 * leaves.count()).bit_length()))
    at = leaves.select(F.pmod("leaf", F.lit(bits)).cast("int").alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, at % 64))").alias("bits")).collect()
    found = [0] * (bits // 64)
    for r in rows:
        found[r["word"]] = r["bits"]
    return found


def copies_as_one(docs: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """``lines`` with one ``document`` for all line sets of a group of near copies."""
    held = lines.select("document", "chars", F.xxhash64("line").alias("h"), F.length("line").alias("n")).distinct()
    often = held.groupBy("h").agg(F.count("*").alias("sets")).where(F.col("sets") >= min_docs).select("h")
    copied = held.join(often, "h").groupBy("document").agg(F.sum("n").alias("n"), F.first("chars").alias("chars")).where(F.col("n") >= COPIED * F.col("chars")).select("document")
    ids = materialise(lines.select("doc_id", "document").distinct().join(copied, "document").select(F.col("doc_id").alias("copy_id")).distinct(), "copied-documents")
    if ids.isEmpty():
        return lines
    marked = docs.where(in_bitmap(F.xxhash64("doc_id"), bitmap_of(ids.select(F.xxhash64("copy_id").alias("leaf")))))
    texts = marked.join(ids, marked["doc_id"].eqNullSafe(ids["copy_id"]), "left_semi").where("text is not null").select(set_of(lines_in(F.col("text"))).alias("doc_id"), "text")
    groups = near_duplicates(texts.groupBy("doc_id").agg(F.min("text").alias("text"))).where("doc_id != component_id").select(F.col("doc_id").alias("document"), "component_id")
    return lines.join(groups, "document", "left").withColumn("document", F.coalesce("component_id", "document")).drop("component_id")


def templates(tokens: DataFrame, pairs: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(leaf, h, places, n_docs) of the lines whose template recurs, with the places of its constants.

    ``tokens(leaf, h, sets, n, words, place, t)`` has the tokens without a digit of lines in ``sets`` line sets, of ``n`` tokens, ``words`` of them without a digit;
    ``pairs(leaf, h, document)`` the line sets.
    """
    line = ["leaf", "h"]
    found = []
    while True:
        common = tokens.groupBy("leaf", "place", "t").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= min_docs).select("leaf", "place", "t")
        fixed = tokens.join(common, ["leaf", "place", "t"]).groupBy(*line).agg(F.count("*").alias("fixed"), F.max("n").alias("n"), F.max("words").alias("words"), F.max("place").alias("last"), F.bit_xor(F.xxhash64("place", "t")).alias("pattern"), F.array_sort(F.collect_list("place")).alias("places"))
        steady = (F.col("fixed") >= F.greatest(F.lit(MIN_TOKENS), SIMILAR * F.col("n"))) & ((F.col("last") >= depth) | (F.col("fixed") == F.col("words")))
        named = materialise(fixed.where(steady).select(*line, "pattern", "places"), "patterns")
        held = named.join(pairs, line).select("leaf", "pattern", "document").distinct().groupBy("leaf", "pattern").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        here = materialise(named.join(held, ["leaf", "pattern"]).select(*line, "places", "n_docs"), "templates")
        found.append(here)
        if here.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = tokens.join(here.select("leaf").distinct(), "leaf", "left_semi").join(here.select(*line), line, "left_anti")
        tokens = materialise(left, "tokens-left")


def recurring(lines: DataFrame, depth: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """((leaf, h, places, n_docs) of the lines that recur, (leaf, h, line, sets) of all lines); ``places`` is null for a line that recurs only as it stands."""
    named = lines.select("leaf", F.xxhash64("line").alias("h"), "line", "document")
    pairs = materialise(named.select("leaf", "h", "document").distinct(), "line-documents")
    sets = pairs.groupBy("leaf", "h").agg(F.count("*").alias("sets"))
    texts = named.groupBy("leaf", "h").agg(F.first("line").alias("line"))
    distinct = materialise(texts.join(sets, ["leaf", "h"]), "distinct-lines")
    # each token is looked at once, before the rows are made
    placed = lambda w: F.filter(F.transform(w, lambda t, k: F.struct(k.alias("place"), F.when(~t.rlike("[0-9]"), F.xxhash64(t)).alias("t"))), lambda x: x["t"].isNotNull())
    spelt = distinct.select("leaf", "h", "sets", let(words(F.col("line")), lambda w: F.struct(F.size(w).alias("n"), placed(w).alias("placed"))).alias("x"))
    each = spelt.select("leaf", "h", "sets", F.col("x.n").alias("n"), F.size("x.placed").alias("words"), F.explode_outer("x.placed").alias("y"))
    tokens = materialise(each.where("y is not null").select("leaf", "h", "sets", "n", "words", "y.place", "y.t"), "line-tokens")
    by_template = templates(tokens, pairs, depth, min_docs)
    whole = sets.where(F.col("sets") >= min_docs).join(by_template, ["leaf", "h"], "left_anti").select("leaf", "h", F.lit(None).cast("array<int>").alias("places"), F.col("sets").alias("n_docs"))
    return by_template.unionByName(whole), distinct


def recurring_lines(lines: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(h, line, template, n_docs): lines of shared leaves that recur, as they stand or by their template."""
    found, distinct = recurring(lines, depth, min_docs)
    template = F.array_join(F.transform(words(F.col("line")), lambda t, k: F.when(F.array_contains("places", k), t).otherwise(F.lit(VARIABLE))), " ")
    return found.join(distinct, ["leaf", "h"]).select("h", "line", F.when(F.col("places").isNull(), F.col("line")).otherwise(template).alias("template"), "n_docs")


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, name: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct column ``name`` (text, n_lines, n_dropped)."""
    lines = lines_of(docs, depth, min_tokens)
    shared = materialise(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "shared-leaves")
    near = materialise(lines.where(in_bitmap(F.col("leaf"), bitmap_of(shared))).join(shared, "leaf"), "shared-lines")
    dropped = materialise(recurring(materialise(copies_as_one(docs, near, min_docs), "line-sets"), depth, min_docs)[0].select("h").distinct(), "recurring-lines")
    per_doc = near.select("doc_id", F.xxhash64("line").alias("h")).join(dropped, "h").groupBy("doc_id").agg(F.collect_set("h").alias("line_hashes")).withColumnRenamed("doc_id", "line_doc_id")
    hashes = per_doc["line_hashes"]
    joined = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["line_doc_id"]), "left")
    cut = let(F.split(docs["text"], "\n"), lambda x: let(F.filter(x, lambda v: ~F.array_contains(hashes, F.xxhash64(v))), lambda y: F.struct(F.array_join(y, "\n").alias("text"), F.size(x).alias("n_lines"), (F.size(x) - F.size(y)).alias("n_dropped"))))
    whole = F.struct(docs["text"].alias("text"), F.coalesce(F.size(F.split(docs["text"], "\n")), F.lit(0)).alias("n_lines"), F.lit(0).alias("n_dropped"))
    return joined.select(*(docs[c] for c in docs.columns), F.when(hashes.isNotNull() & docs["text"].isNotNull(), cut).otherwise(whole).alias(name))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without recurring lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "line_dedup.text", "line_dedup.n_lines", "line_dedup.n_dropped")
