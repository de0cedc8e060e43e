"""Queries that merge what has come in with what is stored: postings, decision state, run marks and progress."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, scoring, text
from ..operators import merges
from ..operators.snapshots import Snapshots
from ..operators.storage import new_dir, written
from ..registry import query
from ..streaming.ledger import backfill, ledger, read_table
from .notice_queries import AREA_WEIGHTS, EVALUATED, UF, evaluated, notices
from .posting_queries import SCORED, judged
from .proxies import NEWS, POSTINGS, news, postings
from .state_queries import STATE, state

STATE_NOW = "2024-02-01 10:00:00"

# ---- postings


@query(
    f"""with {POSTINGS}, k as (select id, published, source_no % 4 as source, case when area is not null then concat_ws('|', uf, area, date_trunc('week', published)::date::varchar) end as key from postings),
old as (select * from k where published < date '1994-01-01'), fresh as (select * from k where id not in (select id from old)),
open as (select * from fresh f where key is null or not exists (select 1 from old o where o.key = f.key and o.source != f.source)),
firsts as (select *, arg_min(source, id) over (partition by key) as first_source from open)
select id, source, key from firsts where key is null or source = first_source"""
)
def u01_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New by id, and by canonical key against other sources, in the store and among the new rows themselves."""
    p = postings(spark, sf_dir)
    key = F.when(F.col("area").isNotNull(), F.concat_ws("|", "uf", "area", F.to_date(F.date_trunc("week", "published")).cast("string")))
    rows = p.select("id", (F.col("source_no") % 4).alias("source"), key.alias("key"), "published")
    return merges.insert_if_absent(rows.where("published < date '1994-01-01'"), rows)


#: Columns that each run works out anew.
DERIVED = ("cluster_id", "n_publishers", "n_items", "raw_signal", "batch", "batch_size", "percentile", "repercussion", "profile_bump", "profile_matches", "score", "anchors", "regime")
MIDDLE = "2024-01-16"


@query(
    f"""with {NEWS} select id, title, domain, {', '.join(f"((id * 7 + {k} * 11) % 100)::int as {c}" for k, c in enumerate(DERIVED))}, case when ts < timestamp '{MIDDLE}' then '2024-01-01' else '{STATE_NOW}' end as first_seen,
  '{STATE_NOW}' as updated_at, ts >= timestamp '{MIDDLE}' as inserted from news"""
)
def u02_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items are inserted; stored ones keep their facts and when they were first seen, and take the thirteen derived columns."""
    n = news(spark, sf_dir)
    k = F.col("id")
    stored = n.where(F.col("ts") < F.lit(MIDDLE).cast("timestamp")).select("id", "title", "domain", *(((k * 3 + i) % 100).cast("int").alias(c) for i, c in enumerate(DERIVED)), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-01").alias("updated_at"))
    known = F.col("ts") < F.lit(MIDDLE).cast("timestamp")
    fresh = n.select("id", F.when(known, F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(known, "other").otherwise(F.col("domain")).alias("domain"), *(((k * 7 + i * 11) % 100).cast("int").alias(c) for i, c in enumerate(DERIVED)), F.lit(STATE_NOW).alias("first_seen"), F.lit(STATE_NOW).alias("updated_at"))
    return merges.upsert(stored, fresh, "id", list(DERIVED), F.lit(STATE_NOW))


STORED = f"""{EVALUATED}, stored as (select *, case when id % 4 = 0 then null else 'Design' end as old_area, case when id % 6 = 0 then null else 'RJ' end as old_uf,
  case when id % 7 = 0 then 'area' when id % 7 = 1 then 'vagas' end as by_model, (id % 60)::int as old_score, case when id % 8 = 0 then null else 9 end as old_vacancies from v)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    by_model = F.when(k % 7 == 0, F.array(F.lit("area"))).when(k % 7 == 1, F.array(F.lit("vagas"))).otherwise(F.array().cast("array<string>"))
    n = notices(spark, sf_dir).withColumn("campos_llm", by_model).withColumn("old_score", (k % 60).cast("int"))
    return n.withColumn("old_area", F.when(k % 4 != 0, "Design")).withColumn("old_uf", F.when(k % 6 != 0, "RJ")).withColumn("old_vacancies", F.when(k % 8 != 0, 9))


@query(
    f"""with {STORED}, r as (select *, case when ambiguous and coalesce(by_model, '') != 'area' then null else old_area end as new_area,
  case when ambiguous and coalesce(by_model, '') != 'vagas' then null else old_vacancies end as new_vacancies, coalesce(old_uf, {UF}) as new_uf from stored),
s as (select *, (case when new_area = 'Design' then 30 else 0 end + 10)::int as new_score from r)
select id, new_area as area, new_vacancies as vacancies, new_uf as uf, new_score as score from s
where new_area is distinct from old_area or new_vacancies is distinct from old_vacancies or new_uf is distinct from old_uf or new_score is distinct from old_score"""
)
def u04_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields computed anew: ambiguous notices lose theirs but what a model gave, a missing state is filled, the score follows; changed rows only."""
    s = evaluated(stored(spark, sf_dir).withColumnsRenamed({"old_area": "was_area"})).withColumnRenamed("was_area", "old_area")
    own = lambda name, old: F.when(F.col("ambiguous") & ~F.array_contains("campos_llm", name), None).otherwise(F.col(old))
    r = s.withColumn("new_area", own("area", "old_area")).withColumn("new_vacancies", own("vagas", "old_vacancies")).withColumn("new_uf", F.coalesce("old_uf", extract.state_in_text(F.col("text"))))
    weight = F.coalesce(extract.looked_up(F.col("new_area"), {k: str(v) for k, v in AREA_WEIGHTS.items()}).cast("int"), F.lit(0))
    r = r.withColumn("new_score", (F.least(F.lit(scoring.AREA_CAP), weight) + scoring.ELIGIBILITY_POINTS["indeterminada"]).cast("int"))
    changed = merges.changed({f"old_{c}": f"new_{c}" for c in ("area", "vacancies", "uf", "score")})
    return r.where(changed).select("id", *(F.col(f"new_{c}").alias(c) for c in ("area", "vacancies", "uf", "score")))


@query(
    f"""with {STORED}, x as (select *, case when id % 2 = 0 then 'UX/IHC' end as found_area, case when id % 3 = 0 then 4 end as found_vacancies from stored)
select id, coalesce(old_area, found_area) as area, coalesce(old_vacancies, found_vacancies) as vacancies,
  case when (old_area is null and found_area is not null) or (old_vacancies is null and found_vacancies is not null) then (case coalesce(old_area, found_area) when 'Design' then 30 when 'UX/IHC' then 35 else 0 end + 10)::int else old_score end as score,
  concat_ws(',', by_model, case when old_area is null and found_area is not null and coalesce(by_model, '') != 'area' then 'area' end,
    case when old_vacancies is null and found_vacancies is not null and coalesce(by_model, '') != 'vagas' then 'vagas' end) as by_model from x"""
)
def u05_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields only where there is none; their names are recorded, and a row that took one is scored anew."""
    k = F.col("id")
    x = stored(spark, sf_dir).withColumn("found_area", F.when(k % 2 == 0, "UX/IHC")).withColumn("found_vacancies", F.when(k % 3 == 0, 4))
    filled = merges.fill_missing(x, {"area": ("old_area", "found_area"), "vagas": ("old_vacancies", "found_vacancies")}, "campos_llm")
    weight = F.when(F.col("area") == "Design", 30).when(F.col("area") == "UX/IHC", 35).otherwise(0)
    took = (F.col("old_area").isNull() & F.col("found_area").isNotNull()) | (F.col("old_vacancies").isNull() & F.col("found_vacancies").isNotNull())
    score = F.when(took, weight + 10).otherwise(F.col("old_score"))
    return filled.select("id", "area", F.col("vagas").alias("vacancies"), score.alias("score"), F.array_join("campos_llm", ",").alias("by_model"))


QUEUE = f"""{SCORED}, q as (select *, row_number() over (order by score desc, id) as place from judged where final != 'fora' and (final = 'indeterminada' or score >= 80))"""


@query(f"with {QUEUE} select id, place <= 20 as notified, case when place <= 20 then timestamp '{STATE_NOW}' end as notified_at from q")
def u11_mark_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 are sent and marked, the others stay pending."""
    q = judged(spark, sf_dir).where("final != 'fora' and (final = 'indeterminada' or score >= 80)").select("id", "score")
    sent = q.orderBy(F.desc("score"), "id").limit(20).select("id", F.lit(STATE_NOW).cast("timestamp").alias("notified_at"))
    return q.join(F.broadcast(sent), "id", "left").select("id", F.col("notified_at").isNotNull().alias("notified"), "notified_at")


@query(f"with {QUEUE} select id from q where place > 20")
def u05x_not_yet_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is pending less what has been sent."""
    q = u11_mark_notified(spark, sf_dir)
    return q.select("id").join(q.where("notified").select("id"), "id", "left_anti")


@query(f"with {SCORED}, p as (select source_no, count(*) as total from judged where final != 'fora' group by source_no) select source_no, case when source_no < 4 then 7 else total end as total, source_no >= 4 as closed_now from p")
def u11_backlog_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog is closed once a source: sources with a mark keep it, the others get one with their pending rows."""
    pending = judged(spark, sf_dir).where("final != 'fora'").groupBy("source_no").agg(F.count("*").alias("total"))
    marks = spark.range(4).select(F.col("id").cast("int").alias("source_no"), F.lit(7).cast("long").alias("marked"))
    return pending.join(marks, "source_no", "left").select("source_no", F.coalesce("marked", "total").alias("total"), F.col("marked").isNull().alias("closed_now"))


@query("select distinct source from documents")
def u06x_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()


# ---- lookups


@query(f"with {POSTINGS}, d as (select org, arg_min(id, (published, id)) as id, arg_min(coalesce(area, kind), (published, id)) as label, arg_min(track, (published, id)) as track from postings group by org) select c_custkey as row_no, d.id, coalesce(d.label, 'fora do radar') as label, coalesce(d.track, '') as track from customer left join d on d.org = c_name")
def j10_queue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first posting at an address gives a queue row its id, label and track; what isn't found is named so."""
    p = postings(spark, sf_dir)
    dim = p.groupBy("org").agg(F.min_by(F.struct("id", F.coalesce("area", "kind").alias("label"), "track"), F.struct("published", "id")).alias("x"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("row_no"), F.col("c_name").alias("org"))
    return c.join(dim, "org", "left").select("row_no", "x.id", F.coalesce("x.label", F.lit("fora do radar")).alias("label"), F.coalesce("x.track", F.lit("")).alias("track"))


CANON = ("Universidade Federal do Pará", "UFPA - Universidade Federal do Pará", "Fundação Universidade do Acre – UFAC", "Instituto Novo - Campus Um", "", "ufpa")


@query("select o_orderkey as id, (['ufpa', 'ufpa', 'ufac', 'instituto novo campus um', '', 'ufpa'])[o_orderkey % 6 + 1] as acronym from orders")
def j03_canonical_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole name, then its parts between dashes, in a dictionary of names and acronyms; else the longest candidate."""
    names = spark.createDataFrame([("Universidade Federal do Pará", "UFPA"), ("Universidade Federal do Acre", "UFAC")], "name string, acronym string")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, CANON)), (F.col("o_orderkey") % 6).cast("int")).alias("org"))
    return merges.canonical_acronyms(o, names)


# ---- decision state: customers have a stored row, conversations capture flags, and either may lack the other

BASE = f"""{STATE}, base as (select url, case when url % 2 = 0 then 'docente' else 'mercado' end as track, url % 3 = 0 or url % 7 = 1 as enrolled, url % 5 = 0 as discarded, case when url % 4 = 0 then 'antigo' when url % 4 = 1 then 'enviada' else '' end as stage,
  case when url % 4 = 1 then timestamp '2024-01-05 00:00:00' end as stage_at, case when url % 3 = 0 or url % 7 = 1 then timestamp '2024-01-02 00:00:00' end as enrolled_at, case when url % 5 = 0 then timestamp '2024-01-03 00:00:00' end as discarded_at,
  case when url % 9 = 1 then 'humano' else 'robo' end as owner, case when url % 4 = 3 then 'visto' else '' end as note from (select distinct o_custkey as url from orders)),
flags as (select url, bool_or(voice = 'humano' and turn % 3 = 0) as enrolled, bool_or(text like '%?%' and turn > 2) as discarded,
  coalesce(arg_min(case voice when 'humano' then 'docente' else 'mercado' end, (turn, case voice when 'humano' then 'docente' else 'mercado' end)) filter (voice in ('humano', 'robo')), '') as track from state group by url)"""


def base_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("url")).distinct()
    at = lambda c, d, name: F.when(c, F.lit(d).cast("timestamp")).alias(name)
    enrolled = (u % 3 == 0) | (u % 7 == 1)
    return s.select(
        "url",
        F.when(u % 2 == 0, "docente").otherwise("mercado").alias("track"),
        enrolled.alias("enrolled"),
        (u % 5 == 0).alias("discarded"),
        F.when(u % 4 == 0, "antigo").when(u % 4 == 1, "enviada").otherwise("").alias("stage"),
        at(u % 4 == 1, "2024-01-05", "stage_at"),
        at(enrolled, "2024-01-02", "enrolled_at"),
        at(u % 5 == 0, "2024-01-03", "discarded_at"),
        F.when(u % 9 == 1, "humano").otherwise("robo").alias("owner"),
        F.when(u % 4 == 3, "visto").otherwise("").alias("note"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.when(F.col("voice") == "humano", "docente").when(F.col("voice") == "robo", "mercado").otherwise("")
    return state(spark, sf_dir).select("url", track.alias("track"), ((F.col("voice") == "humano") & (F.col("turn") % 3 == 0)).alias("enrolled"), (F.col("text").contains("?") & (F.col("turn") > 2)).alias("discarded"), F.col("turn").alias("place"))


HARVESTED = f"""{BASE}, met as (select coalesce(b.url, f.url) as url, b.url is null as fresh, f.url is not null as seen, b.* exclude (url), f.enrolled as f_enrolled, f.discarded as f_discarded, f.track as f_track,
    f.url is not null and (b.url is null or b.enrolled != f.enrolled or b.discarded != f.discarded) as changed
  from base b full join flags f on b.url = f.url where b.url is not null or f.enrolled or f.discarded),
harvested as (select url, case when changed and f_track != '' then f_track else coalesce(track, '') end as track, coalesce(f_enrolled, enrolled) as enrolled, coalesce(f_discarded, discarded) as discarded, coalesce(stage, '') as stage, stage_at,
    case when fresh and not f_enrolled then null when fresh or (seen and enrolled != f_enrolled) then timestamp '{STATE_NOW}' else enrolled_at end as enrolled_at,
    case when fresh and not f_discarded then null when fresh or (seen and discarded != f_discarded) then timestamp '{STATE_NOW}' else discarded_at end as discarded_at,
    case when changed then 'humano' else owner end as owner, coalesce(note, '') as note, changed
  from met)"""


@query(f"with {HARVESTED} select * from harvested")
def u06_harvest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures merge by or into the whole state; a new address is inserted if a flag is set; a time moves only with its own flag, and a change makes the row a person's."""
    return merges.harvest_flags(base_state(spark, sf_dir), captures(spark, sf_dir), STATE_NOW)


FIELDS = "fields as (select url, case when max(turn) % 2 = 0 then 'entrevista' else 'enviada' end as new_stage from state group by url)"


def new_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).groupBy("url").agg(F.when(F.max("turn") % 2 == 0, "entrevista").otherwise("enviada").alias("new_stage"))


@query(f"with {BASE}, {FIELDS} select b.url, new_stage as stage, case when new_stage != b.stage then timestamp '{STATE_NOW}' else b.stage_at end as stage_at from base b join fields using (url) where b.enrolled and new_stage != b.stage")
def u07_harvest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of enrolled addresses only; the stage's day moves with the stage."""
    return merges.harvest_stage(base_state(spark, sf_dir), new_stages(spark, sf_dir), STATE_NOW).where("moved").select("url", "stage", "stage_at")


REFRESHED = f"""{HARVESTED}, {FIELDS}, renamed as (select h.*, case h.stage when 'antigo' then 'aguardando' else h.stage end as s1 from harvested h),
staged as (select r.*, case when enrolled and f.new_stage is not null then f.new_stage else s1 end as s2 from renamed r left join fields f using (url)),
refreshed as (select url, track, enrolled, discarded, case when enrolled and s2 = '' then 'enviada' else s2 end as stage,
    case when s2 != s1 then timestamp '{STATE_NOW}' when enrolled and s2 = '' then coalesce(stage_at, timestamp '{STATE_NOW}') else stage_at end as stage_at, enrolled_at, discarded_at, owner, note,
    changed or stage = 'antigo' or s2 != s1 or (enrolled and s2 = '') as changed from staged)"""


@query(f"with {REFRESHED} select * from refreshed")
def u12_state_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages renamed, flags harvested, fields harvested, then the first stage for enrolled rows without one, dated if undated."""
    return merges.state_refresh(base_state(spark, sf_dir), captures(spark, sf_dir), new_stages(spark, sf_dir), STATE_NOW, {"antigo": "aguardando"}, "enviada")


@query(f"with {REFRESHED} select url, track, enrolled, discarded, stage, stage_at, enrolled_at, discarded_at, owner, note, 1::bigint as version from refreshed")
def u12x_published_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored state is a published snapshot, the refresh that changed it the next; a refresh that changes nothing publishes none."""
    kept = Snapshots(spark, new_dir(spark, "state"))
    stored = kept.commit(base_state(spark, sf_dir), None)
    took, stages = captures(spark, sf_dir), new_stages(spark, sf_dir)
    for _ in range(2):
        rows = merges.state_refresh(kept.read(stored).select(*merges.STATE), took, stages, STATE_NOW, {"antigo": "aguardando"}, "enviada")
        stored = kept.refresh(rows, "changed", stored)
    return kept.read().select(*merges.STATE, F.lit(stored).cast("long").alias("version"))


@query(
    f"""with {BASE}, w as (select o_orderkey as place, o_custkey * 2 as url, case o_orderstatus when 'O' then 'docente' when 'F' then 'mercado' else '' end as track, o_orderpriority < '3' as says from orders),
said as (select url, arg_max(says, place) as says, bool_or(says) as ever, bool_and(says) as always, coalesce(arg_max(track, place) filter (track != ''), '') as w_track from w group by url),
met as (select coalesce(b.url, s.url) as url, b.url is null as fresh, b.* exclude (url), s.* exclude (url), b.owner = 'humano' as human,
    s.url is not null and b.url is not null and case when b.enrolled then not s.always else s.ever end as other from base b full join said s on b.url = s.url where b.url is not null or s.ever),
judged as (select *, coalesce(human and other, false) as diverges, fresh or coalesce(not human and other, false) as takes,
    'robô diz ' || case when enrolled then 'não inscrito' else 'inscrito' end || ' em {STATE_NOW}; fica ' || case when enrolled then 'inscrito' else 'não inscrito' end as remark from met)
select url, case when takes and w_track != '' then w_track else coalesce(track, '') end as track, case when takes then says else enrolled end as enrolled, coalesce(discarded, false) as discarded, coalesce(stage, '') as stage, stage_at,
  case when takes then timestamp '{STATE_NOW}' else enrolled_at end as enrolled_at, discarded_at, case when takes then 'robo' else owner end as owner,
  case when diverges then case when note = '' then remark else note || ' | ' || remark end else coalesce(note, '') end as note, takes or diverges as changed, diverges from judged"""
)
def u08_robot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's decision wins and a robot that differs is noted once and reported; a robot may add an address that it enrols; all other rows stay."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    track = F.when(F.col("o_orderstatus") == "O", "docente").when(F.col("o_orderstatus") == "F", "mercado").otherwise("")
    writes = o.select((F.col("o_custkey") * 2).alias("url"), track.alias("track"), (F.col("o_orderpriority") < "3").alias("says"), F.col("o_orderkey").alias("place"))
    return merges.robot_write(base_state(spark, sf_dir), writes, STATE_NOW)


@query(f"with {BASE}, shown as (select url * 2 as place, case when url % 6 = 0 then '' else url::varchar end as address from (select distinct url from state)) select place, case when address = '' then null else coalesce(b.enrolled, false) end as enrolled, case when address = '' then null when b.enrolled then b.owner else '' end as owner from shown left join base b on b.url::varchar = address")
def j13_restored_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags in the order shown: a blank address stays blank, an unknown one is false."""
    u = F.col("url")
    shown = state(spark, sf_dir).select("url").distinct().select((u * 2).alias("place"), F.when(u % 6 != 0, u).alias("url"))
    j = shown.join(base_state(spark, sf_dir), "url", "left")
    there = u.isNotNull()
    return j.select("place", F.when(there, F.coalesce("enrolled", F.lit(False))).alias("enrolled"), F.when(there, F.when(F.col("enrolled"), F.col("owner")).otherwise("")).alias("owner"))


@query(f"with {BASE} select s.url * 2 as place, case when b.enrolled then coalesce(b.stage, '') else '' end as stage, case when b.enrolled then coalesce(b.stage_at::date::varchar, '') else '' end as stage_day, case when b.enrolled then coalesce(b.enrolled_at::date::varchar, '') else '' end as enrolled_day, coalesce(b.track, '') as track, case when b.enrolled then b.owner else '' end as owner, coalesce(b.note, '') as note from (select distinct url from state) s left join base b using (url)")
def j14_restored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six fields of an application in the order shown; what an address lacks is blank."""
    shown = state(spark, sf_dir).select("url").distinct()
    j = shown.join(base_state(spark, sf_dir), "url", "left")
    blank = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    if_enrolled = lambda c, name: blank(F.when(F.col("enrolled"), c), name)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return j.select((F.col("url") * 2).alias("place"), if_enrolled(F.col("stage"), "stage"), if_enrolled(day("stage_at"), "stage_day"), if_enrolled(day("enrolled_at"), "enrolled_day"), blank(F.col("track"), "track"), if_enrolled(F.col("owner"), "owner"), blank(F.col("note"), "note"))


@query(f"with {HARVESTED}, p as (select o_custkey as url, arg_min(o_orderpriority, o_orderkey) as label from orders group by 1) select h.url, p.label, enrolled_at from harvested h left join p using (url) where h.enrolled")
def j11_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolled addresses with the first posting's label."""
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("url")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("label"))
    return u06_harvest_flags(spark, sf_dir).where("enrolled").join(p, "url", "left").select("url", "label", "enrolled_at")


@query(f"with {HARVESTED} select url, enrolled_at, row_number() over (order by enrolled_at desc, url) as place from harvested where enrolled qualify place <= 50")
def v04_applications_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest applications."""
    top = written(u06_harvest_flags(spark, sf_dir).where("enrolled").orderBy(F.desc("enrolled_at"), "url").limit(50).select("url", "enrolled_at"), "applications")
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("enrolled_at"), "url")))


@query(f"with {HARVESTED} select count_if(enrolled and enrolled_at >= timestamp '{STATE_NOW}' - interval 30 day)::bigint as enrolments, count_if(discarded)::bigint as discards from harvested")
def a25_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit(STATE_NOW).cast("timestamp") - F.expr("interval 30 days")
    return u06_harvest_flags(spark, sf_dir).agg(F.count_if(F.col("enrolled") & (F.col("enrolled_at") >= since)).alias("enrolments"), F.count_if("discarded").alias("discards"))


@query(f"with {HARVESTED} select case when url % 2 = 0 then 'docente' else 'mercado' end as track, count_if(enrolled)::bigint as enrolled, count_if(enrolled and owner = 'robo')::bigint as by_robot from harvested group by 1")
def a32_enrolled_per_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = u06_harvest_flags(spark, sf_dir).withColumn("track", F.when(F.col("url") % 2 == 0, "docente").otherwise("mercado"))
    return h.groupBy("track").agg(F.count_if("enrolled").alias("enrolled"), F.count_if(F.col("enrolled") & (F.col("owner") == "robo")).alias("by_robot"))


@query(f"with {STATE} select url, 'docente' as track, bool_or(voice = 'humano') as enrolled from state where url % 2 = 0 and url % 6 != 0 group by url union all select url, 'mercado', bool_or(voice = 'robo') from state where url % 2 = 1 group by url")
def u08x_view_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of two views with the view as a column; TRUE texts are flags and blank addresses go."""
    s = state(spark, sf_dir)
    said = lambda v: F.when(F.col("voice") == v, " true ").otherwise("FALSE")
    one = s.where("url % 2 = 0").select(F.when(F.col("url") % 6 != 0, F.col("url").cast("string")).otherwise("  ").alias("address"), F.lit("docente").alias("track"), said("humano").alias("flag"))
    two = s.where("url % 2 = 1").select(F.col("url").cast("string").alias("address"), F.lit("mercado").alias("track"), said("robo").alias("flag"))
    rows = one.unionByName(two).where(F.trim("address") != "")
    return rows.groupBy(F.col("address").cast("long").alias("url"), "track").agg(F.bool_or(F.upper(F.trim("flag")) == "TRUE").alias("enrolled"))


@query(f"with {HARVESTED} select url, date_diff('day', greatest(coalesce(enrolled_at, stage_at), coalesce(stage_at, enrolled_at))::date, date '2024-02-01')::int as waiting from harvested where enrolled")
def f41_waiting_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the later of enrolment and stage."""
    h = merges.harvest_flags(base_state(spark, sf_dir), captures(spark, sf_dir), STATE_NOW).where("enrolled")
    return h.select("url", F.datediff(F.lit("2024-02-01").cast("date"), F.to_date(F.greatest("enrolled_at", "stage_at"))).alias("waiting"))


@query("select o_orderkey as id, date_diff('day', o_orderdate::date, date '1998-08-02')::int as age, case when o_orderdate::date + 30 < date '1998-08-02' then 0 when o_orderdate::date + 30 <= date '1998-08-04' then 1 when o_orderpriority = '5-LOW' then 2 else 3 end as urgency from orders")
def f42_queue_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overdue, due in two days, small, other."""
    today, due = F.lit("1998-08-02").cast("date"), F.date_add(F.to_date("o_orderdate"), 30)
    urgency = F.when(due < today, 0).when(due <= F.date_add(today, 2), 1).when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(3)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.datediff(today, F.to_date("o_orderdate")).alias("age"), urgency.alias("urgency"))


@query("select doc_id as id, substring(sha256('https://x/' || doc_id || '|' || lower(trim(split_part(text, chr(10), 1)))), 1, 20) as key, substring(sha256('https://x/' || doc_id), 1, 12) as provisional from documents")
def f03_news_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))
    title = text.normalise_key(F.split_part("text", F.lit("\n"), F.lit(1)))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring(F.sha2(F.concat_ws("|", link, title), 256), 1, 20).alias("key"), F.substring(F.sha2(link, 256), 1, 12).alias("provisional"))


# ---- runs


@query("with m as (select o_custkey as track, max(o_orderdate) as last from orders group by 1) select track, not (epoch(timestamp '1998-07-30 04:00:00') - epoch(last) between 0 and case when track % 2 = 0 then 7199 else 28799 end) as runs from m")
def st05_minimum_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is skipped if the last one of its track is less than two (postings) or eight (news) hours ago; a mark in the future doesn't hold it."""
    m = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("track")).agg(F.max("o_orderdate").cast("timestamp").alias("last"))
    gap = F.when(F.col("track") % 2 == 0, 2).otherwise(8) * 3600
    return m.select("track", merges.may_run(F.col("last"), F.lit("1998-07-30 04:00:00").cast("timestamp"), gap).alias("runs"))


DAYS = "days as (select unnest(generate_series(date '1996-01-01', date '1996-12-31', interval 1 day))::date as day)"


@query(f"with {DAYS}, v as (select o_orderdate::date as day, count(*) as volume from orders group by 1) select day, coalesce(volume, 0)::bigint as volume, case when day(day) = 13 then 'error' else 'ok' end as outcome, 1::bigint as generation from days left join v using (day)")
def st06_resumable_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by day with a ledger: a run of another interval starts anew, one that stopped half-way is taken up at the days that are not done; days in error are recorded and don't stop it."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"))

    def work(days: DataFrame) -> DataFrame:
        n = o.join(days, "day", "left_semi").groupBy("day").agg(F.count("*").alias("volume"))
        return days.join(n, "day", "left").select("day", F.coalesce("volume", F.lit(0)).alias("volume"), F.when(F.dayofmonth("day") == 13, "sem resposta").alias("error"))

    path = new_dir(spark, "backfill")
    lo, hi = datetime.date(1996, 1, 1), datetime.date(1996, 12, 31)
    backfill(spark, path, lo, datetime.date(1996, 3, 1), work, step=61, stop_after=1)
    backfill(spark, path, lo, hi, work, step=122, stop_after=1)
    generation = backfill(spark, path, lo, hi, work, step=122)
    marks = ledger(spark, path, generation).select("day", "outcome")
    return read_table(spark, path, generation).join(marks, "day").select("day", "volume", "outcome", F.lit(generation).cast("long").alias("generation"))
