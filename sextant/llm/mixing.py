"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share by weight of all sizes, at most ``max_copies`` times its own size, what is cut off being
shared out again by weight.  The rate target / size gives each document of the source floor(rate) certain whole copies.  The fraction that is left
is sampled at fixed size with unequal probabilities: a document's inclusion leans towards long texts, as the square root of its size class (powers of two),
so that fragments are what a mix leaves out first; a class whose probability would exceed one is certain.  Documents are ranked by random
odds over inclusion odds, u / (1 - u) over p / (1 - p), and taken in that order as long as the middle of the document lies below
what the source still lacks.

A rank over a whole source would put a source in one task.  The quotient of odds is cut into ranges first; sums per
(source, range) give each range the size before it, and ranks are only taken inside a range.  Sources, their size classes and their ranges are
small tables; the sources pass through one task for their weights and levels, a row each, which bears millions of sources.

Edge cases: null or empty texts have size 0 and take 0; a null source is a source of its own, after the others;
rows that repeat an id and a text are apart but alike, ties go by random number, id and size; an empty table gives no rows; other columns are
ignored; very long texts are counted whole.  All is DataFrame code; the random number is a hash of seed, id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Rows of a source in one range, about; ranks do not depend on it.
RANGE_ROWS = 20_000
DIGITS = 13


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` to (source, source_size, target); one row a source, so small.

    Sources are cut off in the order of max_copies * size / weight.  If those before are cut off, a source's level is what is left
    over the weight that is left, and it's cut off too if its own ratio is below that.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
        F.row_number().over(by_ratio).alias("at"),
    ).withColumn("capped", max_copies * F.col("source_size") * F.col("left_weight") <= F.col("weight") * F.col("left"))
    # the level of the first source that is not cut off holds for all after it
    level = F.min_by(F.col("left") / F.col("left_weight"), F.when(~F.col("capped"), F.col("at"))).over(everything)
    target = F.when(F.col("capped"), (max_copies * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return levels.withColumn("target", target).select("source", "source_size", "target")


def class_plans(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """``classes(key, class, class_size)`` and ``targets(key, source_size, target)`` to the certain copies, what the source lacks and p of each class.

    p is level * sqrt(2 ** class), at most 1, and the sizes times p come to what is lacking.  From the largest class on, a class is certain if the
    level that those after it leave would bring it to 1.
    """
    lean = F.expr("sqrt(cast(shiftleft(1L, class) as double))")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = classes.join(targets, "key").withColumn("lean", lean).withColumn("certain", F.floor(rate + 1e-12))
    rows = rows.withColumn("lacking", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size")))
    order = Window.partitionBy("key").orderBy(F.desc("class"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("lacking") - F.coalesce(F.sum("class_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.greatest(F.lit(1.0), F.sum(F.col("lean") * F.col("class_size")).over(after)))
    rows = rows.withColumn("sure", F.col("lean") * F.col("level") >= 1)
    # the level of the largest class that is not sure holds for all below it
    level = F.max_by("level", F.when(~F.col("sure"), F.col("class"))).over(Window.partitionBy("key"))
    p = F.when(F.col("sure"), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("lean") * level))
    # the mean of p over a source's words that are neither sure nor out
    open_ = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("class_size"))
    mean = F.sum(open_ * F.col("p")).over(Window.partitionBy("key")) / F.greatest(F.lit(1), F.sum(open_).over(Window.partitionBy("key")))
    return rows.withColumn("p", p).withColumn("mean_p", F.least(F.lit(0.999), F.coalesce(mean, F.lit(0.5)))).select("key", "class", "source_size", "target", "certain", "lacking", "p", "mean_p")


def mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs(doc_id, text, source)`` to the columns ``carry`` in a struct ``row``, and (size, source_size, target, copies, taken)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    text_key = F.coalesce(F.md5("text"), F.lit(""))
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_key, text_key)), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    # a key without nulls, so that the join and the ranks share one exchange
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = materialise(docs.select(F.struct(*carry).alias("row"), "doc_id", "source", key.alias("key"), size.alias("size"), u.alias("u")), "sizes")
    rows = rows.withColumn("class", F.length(F.bin("size")) - 1)

    classes = materialise(rows.groupBy("key", "class").agg(F.first("source").alias("source"), F.sum("size").alias("class_size"), F.count("*").alias("n")), "class-sizes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, max_copies)
    plans = materialise(class_plans(classes, targets.withColumn("key", key).drop("source")), "plans")
    n_ranges = 64 + (classes.agg(F.sum("n")).first()[0] or 0) // range_rows
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    placed = rows.join(plans, ["key", "class"]).withColumn("odds", F.when(F.col("p") > 0, odds))
    # Ranges never decrease with the odds and are filled about evenly: the odds as a random number again, by the source's mean p.
    # Sure documents come first and those that can't be taken last, both in ranges of the random number itself.
    scaled = F.col("odds") * F.col("mean_p") / (1 - F.col("mean_p"))
    at = F.when(F.col("odds").isNull(), n_ranges + F.floor(F.col("u") * n_ranges)).when(F.col("odds") == 0, F.floor(F.col("u") * n_ranges) - n_ranges).otherwise(F.floor(scaled / (1 + scaled) * n_ranges))
    placed = placed.withColumn("range", at.cast("int"))
    sums = placed.groupBy("key", "range").agg(F.sum("size").alias("range_size"))
    below = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sums.select("key", "range", F.coalesce(F.sum("range_size").over(below), F.lit(0)).alias("range_base")), "range-bases")
    order = Window.partitionBy("key", "range").orderBy("odds", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("range_base") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0
    copies = F.col("certain") + F.when(F.col("odds").isNotNull() & (middle <= F.col("lacking")), 1).otherwise(0)
    found = placed.join(bases, ["key", "range"]).withColumn("copies", copies.cast("int"))
    return found.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: sources weigh 1, 2, 3, repeating, and share all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, ["doc_id", "source"]).select("row.doc_id", "size", "source_size", "target", "taken", "row.source", "copies")


OP6_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes),
levels as (
  select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0) as remains,
    sum(weight) over () - coalesce(sum(weight) over before, 0) as remains_weight, row_number() over (order by source_size / weight, source nulls last) as place
  from weighed window before as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
capped as (select *, 3 * source_size * remains_weight <= weight * remains as is_capped from levels),
level as (select arg_min(remains / remains_weight, place) as height from capped where not is_capped),
targets as (select source, source_size, case when is_capped then (3 * source_size)::double else weight * (select height from level) end as target from capped),
classes as (select source, length(bin(size)) - 1 as class, sum(size)::bigint as class_size from sized group by all),
lacks as (
  select c.*, t.source_size, t.target, sqrt((1::bigint << class::int)::double) as lean,
    floor(case when t.source_size > 0 then t.target / t.source_size else 0 end + 1e-12) as certain,
    greatest(0, t.target - floor(case when t.source_size > 0 then t.target / t.source_size else 0 end + 1e-12) * t.source_size) as lacking
  from classes c join targets t on c.source is not distinct from t.source),
class_levels as (
  select *, (lacking - coalesce(sum(class_size) over (partition by source order by class desc rows between unbounded preceding and 1 preceding), 0))
    / greatest(1, sum(lean * class_size) over (partition by source order by class desc rows between current row and unbounded following)) as own_level
  from lacks),
sure as (select *, lean * own_level >= 1 as is_sure from class_levels),
plans as (
  select *, case when is_sure then 1 else greatest(0, lean * max_by(own_level, case when not is_sure then class end) over (partition by source)) end as p
  from sure),
odds as (
  select d.*, r.source_size, r.target, r.certain, r.lacking, case when r.p > 0 then (d.u / (1 - d.u)) * ((1 - r.p) / r.p) end as odds
  from sized d join plans r on d.source is not distinct from r.source and length(bin(d.size)) - 1 = r.class),
ranked as (
  select *, coalesce(sum(size) over (partition by source order by odds nulls last, u, doc_id, size rows between unbounded preceding and 1 preceding), 0) + size / 2.0 as middle
  from odds)
select doc_id, size, source_size, target, (certain + case when odds is not null and middle <= lacking then 1 else 0 end)::int as copies,
  (size * (certain + case when odds is not null and middle <= lacking then 1 else 0 end))::bigint as taken, source
from ranked
"""
