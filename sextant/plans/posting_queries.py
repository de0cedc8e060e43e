"""Queries over postings: scores, verdicts, views, de-duplication, reports and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..registry import query
from .proxies import NOW, POSTINGS, postings

NOW_SQL = f"date '{NOW}'"
VERDICT = "case degree when 'doutorado' then 'elegivel_futuro' when 'mestrado' then 'elegivel_agora' when 'especializacao' then 'elegivel_agora' when 'graduacao' then 'elegivel_agora' else 'indeterminada' end"
URGENCY = f"case when deadline is null then 7 when deadline - {NOW_SQL} < 0 then 2 when deadline - {NOW_SQL} <= 7 then 15 when deadline - {NOW_SQL} <= 15 then 12 when deadline - {NOW_SQL} <= 30 then 9 else 5 end"
RECENCY = f"case when published is null then 5 when {NOW_SQL} - published <= 3 then 30 when {NOW_SQL} - published <= 7 then 22 when {NOW_SQL} - published <= 14 then 15 when {NOW_SQL} - published <= 30 then 8 else 3 end"
SCORED = f"""{POSTINGS},
scored as (select *, {VERDICT} as verdict, ({URGENCY})::int as urgency, ({RECENCY})::int as recency, source_no = 10 as negative from postings),
judged as (select *, (case when track = 'mercado' then case when weight = 0 then 0 else least(55, weight) + recency end
    when negative then 0 else least(40, weight) + case verdict when 'elegivel_agora' then 30 when 'elegivel_futuro' then 15 else 10 end + urgency end)::int as score,
  case when track = 'mercado' then case when weight = 0 then 'fora' else 'aderente' end when negative then 'fora' else verdict end as final from scored)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("date")
    p = postings(spark, sf_dir).withColumn("verdict", scoring.eligibility(F.col("degree")))
    p = p.withColumn("urgency", scoring.urgency_points(F.col("deadline"), now)).withColumn("recency", scoring.recency_points(F.col("published"), now)).withColumn("negative", F.col("source_no") == 10)
    market = F.col("track") == "mercado"
    score = F.when(market, scoring.market_score(F.col("weight"), F.col("recency"))).otherwise(scoring.teaching_score(F.col("weight"), F.col("verdict"), F.col("urgency"), F.col("negative")))
    final = F.when(market, F.when(F.col("weight") == 0, "fora").otherwise("aderente")).when(F.col("negative"), "fora").otherwise(F.col("verdict"))
    return p.withColumn("score", score).withColumn("final", final)


@query(f"with {POSTINGS} select id, substring(sha256(concat_ws('|', lower(trim(coalesce(org, ''))), lower(trim(coalesce(area, ''))), published::varchar, id::varchar)), 1, 20) as key from postings")
def f02_posting_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("|", text.normalise_key(F.col("org")), text.normalise_key(F.col("area")), F.col("published").cast("string"), F.col("id").cast("string"))
    return postings(spark, sf_dir).select("id", F.substring(F.sha2(parts, 256), 1, 20).alias("key"))


@query(f"with {SCORED} select id, urgency from scored")
def f31_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "urgency")


@query(f"with {SCORED} select id, recency from scored")
def f32_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "recency")


@query(f"with {SCORED} select id, verdict, case when verdict = 'elegivel_agora' and area is not null then case when area in ('Design', 'UX/IHC') then 'compativel' else 'a_verificar_na_banca' end end as fit from scored")
def f33_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "verdict", scoring.area_fit(F.col("area"), F.col("verdict")).alias("fit"))


@query(f"with {SCORED} select id, track, score, final from judged")
def f34_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("id", "track", "score", "final")


@query(f"with {SCORED} select id, score, final from judged where final != 'fora' and source_no % 2 = 0 and (final = 'indeterminada' or score >= 60)")
def g14_notification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("final != 'fora' and source_no % 2 = 0 and (final = 'indeterminada' or score >= 60)").select("id", "score", "final")


@query(f"with {POSTINGS} select id, org, published from postings where published between date '1997-01-01' and date '1997-12-31'")
def g16_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).where("published between date '1997-01-01' and date '1997-12-31'").select("id", "org", "published")


@query(f"with {POSTINGS} select 'kind' as dim, kind as value, count(*) as n from postings group by kind union all select 'uf', uf, count(*) from postings group by uf union all select 'track', track, count(*) from postings group by track union all select 'degree', coalesce(degree, 'sem titulação'), count(*) from postings group by 2 union all select 'month', strftime(published, '%Y-%m'), count(*) from postings group by 2")
def a02_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five one-dimensional counts in one pass."""
    p = postings(spark, sf_dir).select("kind", "uf", "track", F.coalesce("degree", F.lit("sem titulação")).alias("degree"), F.date_format("published", "yyyy-MM").alias("month"))
    dims = ("kind", "uf", "track", "degree", "month")
    rows = p.select(F.inline(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims))))
    return rows.groupBy("dim", "value").agg(F.count("*").alias("n"))


@query(f"with {POSTINGS} select coalesce(area, 'não informado') as area, count(*) as n from postings group by 1")
def a01_count_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).groupBy(F.coalesce("area", F.lit("não informado")).alias("area")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area")


@query("select count(*) as n_days, sum(n)::bigint as volume, sum((n = 0)::int)::bigint as empty_days from (select d, count(o_orderkey) as n from (select unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 day))::date as d) left join orders on o_orderdate::date = d group by d)")
def a03_volume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("select explode(sequence(date '1995-01-01', date '2001-08-01')) as d")
    per_day = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return days.join(per_day, "d", "left").agg(F.count("*").alias("n_days"), F.sum("n").alias("volume"), F.count_if(F.col("n").isNull()).alias("empty_days"))


@query(f"with {POSTINGS} select count(distinct org) as institutes, case when count(distinct org) >= 30 then 'confirmada' when count(distinct org) >= 10 then 'parcial' else 'refutada' end as verdict from postings where track = 'docente'")
def a04_hypothesis_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("institutes")
    return postings(spark, sf_dir).where("track = 'docente'").agg(F.countDistinct("org").alias("institutes")).withColumn("verdict", F.when(n >= 30, "confirmada").when(n >= 10, "parcial").otherwise("refutada"))


@query(f"with {POSTINGS}, r as (select track, avg((degree is not null)::int) as rate from postings group by track) select track, round(rate, 6) as rate, case when rate >= 0.6 then 'alta' when rate > 0 then 'baixa' else 'nula' end as class from r")
def a05_extraction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = postings(spark, sf_dir).groupBy("track").agg(F.avg(F.col("degree").isNotNull().cast("int")).alias("rate"))
    return r.select("track", F.round("rate", 6).alias("rate"), F.when(F.col("rate") >= 0.6, "alta").when(F.col("rate") > 0, "baixa").otherwise("nula").alias("class"))


@query(f"with {SCORED} select final, track, uf, count(*) as n, grouping_id(final, track, uf)::bigint as level from judged group by cube (final, track, uf)")
def a06_verdict_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).cube("final", "track", "uf").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"with {SCORED} select final, count(*) as n, sum((score = 0)::int)::bigint as unscored, max(published) as latest from judged group by final")
def a07_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy("final").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("unscored"), F.max("published").alias("latest"))


@query(f"with {SCORED} select source_no, 'gate' as stage, count(*) as total, sum((final != 'fora')::int)::bigint as covered from judged group by source_no union all select source_no, 'degree', count(*), count(degree) from judged group by source_no")
def a08_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).select("source_no", F.inline(F.array(F.struct(F.lit("gate").alias("stage"), (F.col("final") != "fora").alias("ok")), F.struct(F.lit("degree").alias("stage"), F.col("degree").isNotNull().alias("ok")))))
    return j.groupBy("source_no", "stage").agg(F.count("*").alias("total"), F.count_if("ok").alias("covered"))


@query(f"with {POSTINGS}, n as (select uf, org, count(*) as n from postings group by 1, 2), m as (select uf, sum(n)::bigint as total, max(n) as top from n group by uf) select uf, total, top, top >= 5 and top * 100 >= 40 * total as concentrated from m")
def a19_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = postings(spark, sf_dir).groupBy("uf", "org").agg(F.count("*").alias("n"))
    return n.groupBy("uf").agg(F.sum("n").alias("total"), F.max("n").alias("top")).withColumn("concentrated", (F.col("top") >= 5) & (F.col("top") * 100 >= 40 * F.col("total")))


@query(f"with {POSTINGS} select sum((track not in ('docente', 'mercado'))::int)::bigint as orphans, count(*) as total from postings")
def a20_unknown_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).agg(F.count_if(~F.col("track").isin("docente", "mercado")).alias("orphans"), F.count("*").alias("total"))


TIER_SQL = f"""tiers as (select *, case when deadline < {NOW_SQL} then 8 when deadline is not null then case final when 'elegivel_agora' then 1 when 'indeterminada' then 2 else 3 end
  when {NOW_SQL} - published <= 60 then case final when 'elegivel_agora' then 4 when 'indeterminada' then 5 else 6 end else 7 end as tier,
  greatest(0, deadline - {NOW_SQL}) as days_left from judged where track != 'mercado')"""


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tiers: open, without a deadline, older, closed; the first two by eligibility."""
    now = F.lit(NOW).cast("date")
    by_verdict = lambda k: F.when(F.col("final") == "elegivel_agora", k).when(F.col("final") == "indeterminada", k + 1).otherwise(k + 2)
    tier = F.when(F.col("deadline") < now, 8).when(F.col("deadline").isNotNull(), by_verdict(1)).when(F.datediff(now, "published") <= 60, by_verdict(4)).otherwise(7)
    return judged(spark, sf_dir).where("track != 'mercado'").withColumn("tier", tier).withColumn("days_left", F.greatest(F.lit(0), F.datediff("deadline", now)))


@query(f"with {SCORED}, {TIER_SQL} select id, tier, tier * 100000 + least(coalesce(days_left, 999), 999) * 100 + (100 - score) as order_key from tiers where tier <= 6")
def v01_contest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("tier") * 100000 + F.least(F.coalesce("days_left", F.lit(999)), F.lit(999)) * 100 + (100 - F.col("score"))
    return tiers(spark, sf_dir).where("tier <= 6").select("id", "tier", key.alias("order_key")).orderBy("order_key", "id")


@query(f"with {SCORED}, {TIER_SQL} select tier, count(*) as n, sum((source_no = 3)::int)::bigint as discarded from tiers group by tier")
def a21_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("source_no") == 3).alias("discarded"))


MARKET_SQL = f"""market as (select *, {NOW_SQL} - published as age from judged where track = 'mercado'),
buckets as (select *, case when age is null or age > 90 then 5 when age <= 0 then 1 when age <= 7 then 2 when age <= 30 then 3 else 4 end as bucket,
  case when score >= 70 then 'forte' when score >= 51 then 'media' else 'fraca' end as match from market)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(spark, sf_dir).where("track = 'mercado'").withColumn("age", F.datediff(F.lit(NOW).cast("date"), "published"))
    return m.withColumn("bucket", scoring.market_bucket(F.col("age"))).withColumn("match", scoring.match_class(F.col("score")))


@query(f"with {SCORED}, {MARKET_SQL} select id, bucket, match, bucket * 100000 + (85 - score) * 100 + coalesce(least(greatest(age, 0), 99), 99) as order_key from buckets")
def v02_market_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("bucket") * 100000 + (85 - F.col("score")) * 100 + F.coalesce(F.least(F.greatest("age", F.lit(0)), F.lit(99)), F.lit(99))
    return market(spark, sf_dir).select("id", "bucket", "match", key.alias("order_key")).orderBy("order_key", "id")


@query(f"with {SCORED}, {MARKET_SQL} select sum((bucket <= 2)::int)::bigint as fresh, sum((bucket <= 2 and match = 'forte')::int)::bigint as fresh_strong, sum((bucket = 1 and match = 'forte')::int)::bigint as today_strong, sum((match = 'forte')::int)::bigint as strong from buckets")
def a22_market_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.col("match") == "forte"
    return market(spark, sf_dir).agg(F.count_if(F.col("bucket") <= 2).alias("fresh"), F.count_if((F.col("bucket") <= 2) & strong).alias("fresh_strong"), F.count_if((F.col("bucket") == 1) & strong).alias("today_strong"), F.count_if(strong).alias("strong"))


@query(f"with {SCORED} select id, score from judged where final != 'fora' order by score desc, published desc, id limit 20")
def t01_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("final != 'fora'").orderBy(F.desc("score"), F.desc("published"), "id").limit(20).select("id", "score")


@query(f"with {SCORED}, r as (select id, source_no, score, row_number() over (partition by source_no order by score desc, id) as place from judged where final != 'fora') select id, source_no, score, place <= 15 as sent from r")
def t04_capped_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each source are sent, the rest stay pending."""
    place = F.row_number().over(Window.partitionBy("source_no").orderBy(F.desc("score"), "id"))
    return judged(spark, sf_dir).where("final != 'fora'").select("id", "source_no", "score", (place <= 15).alias("sent"))


CANON = "case when org is not null and area is not null and published is not null then concat_ws('|', uf, area, published::varchar) end"


@query(f"with {POSTINGS}, k as (select id, source_no, {CANON} as key from postings), f as (select *, arg_min(source_no, id) over (partition by key) as first_source from k) select id, source_no, key from f where key is null or source_no = first_source")
def w08_cross_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per canonical key the rows of the source that came first; rows without a key stay."""
    key = F.when(F.col("org").isNotNull() & F.col("area").isNotNull() & F.col("published").isNotNull(), F.concat_ws("|", "uf", "area", F.col("published").cast("string")))
    p = postings(spark, sf_dir).select("id", "source_no", key.alias("key"))
    firsts = p.where("key is not null").groupBy("key").agg(F.min_by("source_no", "id").alias("first_source"))
    return p.join(firsts, "key", "left").where("key is null or source_no = first_source").select("id", "source_no", "key")


@query(f"with {POSTINGS}, r as (select *, row_number() over (partition by org, uf order by published, id) as n from postings) select id, org, uf from r where n = 1")
def w07_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("published", "id")
    return postings(spark, sf_dir).groupBy("org", "uf").agg(F.min_by("id", order).alias("id")).select("id", "org", "uf")


@query(f"with {POSTINGS}, r as (select *, row_number() over (partition by source_no order by published desc, id desc) as n from postings) select source_no, id, published from r where n = 1")
def w09_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = postings(spark, sf_dir).groupBy("source_no").agg(F.max(F.struct("published", "id")).alias("x"))
    return last.select("source_no", "x.id", "x.published")


@query(f"with {POSTINGS}, patch as (select id, case when id % 4 = 0 then null else upper(uf) || '*' end as uf, id % 4 = 0 as set_null from postings where id % 2 = 0) select p.id, case when q.set_null then null else coalesce(q.uf, p.uf) end as uf from postings p left join patch q using (id)")
def u03_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch tells a value to leave from one to set to null."""
    p = postings(spark, sf_dir)
    patch = p.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, F.concat(F.upper("uf"), F.lit("*"))).alias("new_uf"), (F.col("id") % 4 == 0).alias("set_null"))
    return p.join(patch, "id", "left").select("id", F.when(F.coalesce("set_null", F.lit(False)), None).otherwise(F.coalesce("new_uf", "uf")).alias("uf"))


@query(f"with {SCORED}, b as (select id, final as old, case when area is null then 'indeterminada' else final end as new from judged) select old || ' -> ' || new as transition, count(*) as n from b where old != new group by 1")
def a31_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("area").isNull(), "indeterminada").otherwise(F.col("final"))
    return judged(spark, sf_dir).where(F.col("final") != new).groupBy(F.concat_ws(" -> ", "final", new).alias("transition")).agg(F.count("*").alias("n"))


@query("select o_orderkey as id, l_linenumber as place, l_quantity as quantity from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus != 'P'")
def s07_explode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each position of an open contest, from nested records."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("positions"))
    nested = spark.read.parquet(f"{sf_dir}/orders.parquet").join(li, F.expr("o_orderkey = l_orderkey"))
    return nested.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("id"), F.inline("positions").alias("place", "quantity"))


@query("with t as (select o_orderkey as id, 'da filial de ' || n_name || case when o_orderkey % 3 = 0 then '' else ' e ' || 'NATION_1' end || '.' as body from orders join customer on c_custkey = o_custkey join nation on c_nationkey = n_nationkey) select id, n_name from t join nation on contains(lower(body), lower(n_name)) qualify row_number() over (partition by id order by length(n_name) desc, n_name desc) = 1")
def j02_longest_name_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dictionary name that a text holds; the nation table is 25 rows at any scale."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").join(read("customer"), F.expr("c_custkey = o_custkey")).join(F.broadcast(read("nation")), F.expr("c_nationkey = n_nationkey"))
    body = F.concat(F.lit("da filial de "), "n_name", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(" e NATION_1"), F.lit("."))
    t = o.select(F.col("o_orderkey").alias("id"), body.alias("body"))
    n = F.broadcast(read("nation").select("n_name"))
    return t.join(n, F.lower("body").contains(F.lower("n_name"))).groupBy("id").agg(F.max_by("n_name", F.struct(F.length("n_name"), "n_name")).alias("n_name"))


@query("select c_custkey, n_name, coalesce(r_name, 'fora') as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and r_regionkey != 0")
def j04_two_step_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    dims = read("nation").join(read("region").where("r_regionkey != 0"), F.expr("n_regionkey = r_regionkey"), "left")
    return read("customer").join(dims, F.expr("c_nationkey = n_nationkey"), "left").select("c_custkey", "n_name", F.coalesce("r_name", F.lit("fora")).alias("region"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j09_left_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j17_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").join(o, "c_custkey", "left_anti").select("c_custkey")
