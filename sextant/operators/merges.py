"""Merges of incoming rows with stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import institution_key


def insert_if_absent(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(id, source, key)`` rows of ``fresh`` that are new: by id, then by key against rows of other sources.

    A null key never matches, nor does a row of the same source; of a key that several sources bring, the one whose row has the smallest id came
    first and keeps all its rows.
    """
    new = fresh.join(stored.select("id"), "id", "left_anti")
    # at most two sources a key decide whether another source holds it
    held = stored.where("key is not null").groupBy("key").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    firsts = new.where("key is not null").join(held, "key", "left").where("lo is null or (lo = source and hi = source)").groupBy("key").agg(F.min_by("source", "id").alias("first_source"))
    other = (F.col("lo") != F.col("source")) | (F.col("hi") != F.col("source"))
    rows = new.join(held, "key", "left").where(~F.coalesce(other, F.lit(False))).join(firsts, "key", "left")
    return rows.where("key is null or source = first_source").select("id", "source", "key")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, derived: list[str], now: Column) -> DataFrame:
    """``stored`` with ``fresh`` rows of the same columns: a new key's row comes whole, a known one takes the ``derived`` columns only; both get the time ``updated_at``.  A column ``inserted`` tells them apart."""
    facts = [c for c in stored.columns if c not in (key, "updated_at", *derived)]
    f = fresh.select(key, *(F.col(c).alias(f"new_{c}") for c in (*facts, *derived)), F.lit(True).alias("is_fresh"))
    j = stored.withColumn("is_known", F.lit(True)).join(f, key, "full_outer")
    known, seen = F.col("is_known").isNotNull(), F.col("is_fresh").isNotNull()
    one = lambda c: F.when(known & ~seen if c in derived else known, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)
    at = F.when(seen, now).otherwise(F.col("updated_at")).alias("updated_at")
    return j.select(*(at if c == "updated_at" else F.col(c) if c == key else one(c) for c in stored.columns), (~known).alias("inserted"))


def changed(pairs: dict[str, str]) -> Column:
    """True if any new column differs from its old one, null being a value."""
    return reduce(lambda a, b: a | b, (~F.col(old).eqNullSafe(F.col(new)) for old, new in pairs.items()))


def fill_missing(rows: DataFrame, fields: dict[str, tuple[str, str]], record: str) -> DataFrame:
    """Each field as its old value, else the found one, and the names of those filled added to the array ``record``."""
    names = F.array_compact(F.array(*(F.when(F.col(old).isNull() & F.col(new).isNotNull(), F.lit(name)) for name, (old, new) in fields.items())))
    return rows.withColumns({name: F.coalesce(old, new) for name, (old, new) in fields.items()} | {record: F.array_union(record, names)})


def canonical_acronyms(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows(id, org)`` with the canonical acronym: of the candidates (the whole, then its parts between dashes) the first that the dictionary knows, else the longest."""
    known = names.select(institution_key(F.col("name")).alias("candidate_key"), institution_key(F.col("acronym")).alias("known")).union(names.select(institution_key(F.col("acronym")), institution_key(F.col("acronym")))).distinct()
    org = F.coalesce("org", F.lit(""))
    parts = F.filter(F.transform(F.split(org, "\\s*[-–—]\\s+"), lambda x: F.trim(x)), lambda x: x != "")
    each = rows.select("id", F.posexplode(F.array_distinct(F.concat(F.array(org), parts))).alias("place", "candidate")).withColumn("candidate_key", institution_key(F.col("candidate")))
    met = each.join(known, "candidate_key", "left")
    longest = F.max_by("candidate_key", F.struct(F.length("candidate"), -F.col("place")))
    return met.groupBy("id").agg(F.coalesce(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("place"))), longest).alias("acronym"))


#: Columns of the decision state.
STATE = ("url", "track", "enrolled", "discarded", "stage", "stage_at", "enrolled_at", "discarded_at", "owner", "note")


def harvest_flags(stored: DataFrame, captures: DataFrame, now: str) -> DataFrame:
    """The whole state after ``captures(url, track, enrolled, discarded, place)``: a full outer merge, with a column ``changed``.

    Captures of one address merge by or, under the first track that they name.  An address without a capture stays as it is; a new one is stored if a flag is set.
    A change makes the row a person's, and a time moves only with its own flag.
    """
    at, none = F.lit(now).cast("timestamp"), F.lit(None).cast("timestamp")
    named = F.when(F.col("track") != "", F.struct("place", "track"))
    c = captures.groupBy("url").agg(F.bool_or("enrolled").alias("c_enrolled"), F.bool_or("discarded").alias("c_discarded"), F.coalesce(F.min(named)["track"], F.lit("")).alias("c_track"))
    j = stored.withColumn("known", F.lit(True)).join(c, "url", "full_outer").where("known or c_enrolled or c_discarded")
    new, seen = F.col("known").isNull(), F.col("c_enrolled").isNotNull()
    differs = lambda flag: seen & (new | (F.col(flag) != F.col(f"c_{flag}")))
    changed = differs("enrolled") | differs("discarded")
    moved = lambda flag: F.when(new, F.when(F.col(f"c_{flag}"), at).otherwise(none)).when(differs(flag), at).otherwise(F.col(f"{flag}_at")).alias(f"{flag}_at")
    now_is = lambda flag: F.when(seen, F.col(f"c_{flag}")).otherwise(F.col(flag)).alias(flag)
    blank = lambda name: F.coalesce(name, F.lit("")).alias(name)
    track = F.when(changed & (F.col("c_track") != ""), F.col("c_track")).otherwise(F.coalesce("track", F.lit(""))).alias("track")
    owner = F.when(changed, "humano").otherwise(F.col("owner")).alias("owner")
    return j.select("url", track, now_is("enrolled"), now_is("discarded"), blank("stage"), "stage_at", moved("enrolled"), moved("discarded"), owner, blank("note"), changed.alias("changed"))


def harvest_stage(stored: DataFrame, fields: DataFrame, now: str) -> DataFrame:
    """``fields(url, new_stage)`` over enrolled rows; the day moves with the stage."""
    moved = F.col("enrolled") & F.col("new_stage").isNotNull() & (F.col("new_stage") != F.col("stage"))
    j = stored.join(fields, "url", "left").withColumn("moved", F.coalesce(moved, F.lit(False)))
    return j.withColumn("stage", F.when(F.col("moved"), F.col("new_stage")).otherwise(F.col("stage"))).withColumn("stage_at", F.when(F.col("moved"), F.lit(now).cast("timestamp")).otherwise(F.col("stage_at"))).drop("new_stage")


def robot_write(stored: DataFrame, writes: DataFrame, now: str) -> DataFrame:
    """The whole state after a robot's ``writes(url, track, says, place)``, with columns ``changed`` and ``diverges``.

    A person's decision stays: a robot that says otherwise is noted once and reported.  Other rows take what was said last; a new address is stored if the robot enrols it.
    """
    at, none = F.lit(now).cast("timestamp"), F.lit(None).cast("timestamp")
    w = writes.groupBy("url").agg(F.max_by("says", "place").alias("says"), F.bool_or("says").alias("ever"), F.bool_and("says").alias("always"), F.coalesce(F.max(F.when(F.col("track") != "", F.struct("place", "track")))["track"], F.lit("")).alias("w_track"))
    j = stored.withColumn("known", F.lit(True)).join(w, "url", "full_outer").where("known or ever")
    new, written_to = F.col("known").isNull(), F.col("says").isNotNull()
    otherwise = written_to & F.when(F.col("enrolled"), ~F.col("always")).otherwise(F.col("ever"))
    human = F.col("owner") == "humano"
    diverges = F.coalesce(human & otherwise, F.lit(False))
    takes = F.coalesce(new | (~human & otherwise), F.lit(False))
    word = lambda c: F.when(c, "inscrito").otherwise("não inscrito")
    remark = F.concat(F.lit("robô diz "), word(~F.col("enrolled")), F.lit(f" em {now}; fica "), word(F.col("enrolled")))
    held = F.coalesce("note", F.lit(""))
    noted = diverges & ~F.contains(held, remark)
    note = F.when(noted, F.when(held == "", remark).otherwise(F.concat(held, F.lit(" | "), remark))).otherwise(held)
    return j.select(
        "url",
        F.when(takes & (F.col("w_track") != ""), F.col("w_track")).otherwise(F.coalesce("track", F.lit(""))).alias("track"),
        F.when(takes, F.col("says")).otherwise(F.col("enrolled")).alias("enrolled"),
        F.coalesce("discarded", F.lit(False)).alias("discarded"),
        F.coalesce("stage", F.lit("")).alias("stage"),
        "stage_at",
        F.when(takes, at).otherwise(F.col("enrolled_at")).alias("enrolled_at"),
        F.when(new, none).otherwise(F.col("discarded_at")).alias("discarded_at"),
        F.when(takes, "robo").otherwise(F.col("owner")).alias("owner"),
        note.alias("note"),
        (takes | noted).alias("changed"),
        diverges.alias("diverges"),
    )


def rename_stages(stored: DataFrame, names: dict[str, str]) -> DataFrame:
    stage = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("stage")), F.col("stage"))
    return stored.withColumn("stage", stage)


def state_refresh(stored: DataFrame, captures: DataFrame, fields: DataFrame, now: str, names: dict[str, str], first_stage: str) -> DataFrame:
    """Stages renamed, flags and stages harvested, then the first stage for enrolled rows without one, dated if undated; ``changed`` tells which rows differ from those stored."""
    flags = harvest_flags(rename_stages(stored, names), captures, now)
    staged = harvest_stage(flags, fields, now)
    first = F.col("enrolled") & (F.col("stage") == "")
    dated = F.when(first, F.coalesce("stage_at", F.lit(now).cast("timestamp"))).otherwise(F.col("stage_at"))
    renamed = stored.select("url", F.col("stage").isin(list(names)).alias("renamed"))
    j = staged.join(renamed, "url", "left").withColumn("changed", F.col("changed") | F.col("moved") | first | F.coalesce("renamed", F.lit(False)))
    return j.withColumn("stage_at", dated).withColumn("stage", F.when(first, first_stage).otherwise(F.col("stage"))).select(*STATE, "changed")


def may_run(last: Column, now: Column, gap_seconds: Column) -> Column:
    elapsed = F.unix_timestamp(now) - F.unix_timestamp(last)
    return F.coalesce(~((elapsed >= 0) & (elapsed < gap_seconds)), F.lit(True))
