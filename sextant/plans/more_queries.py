"""Queries of gates, lookups, audits, calendars and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import bands
from ..operators.storage import new_dir, written
from ..registry import query
from .news_queries import CLUSTERS, _band_sql, band_now, ranked_items, t06_bands
from .posting_queries import SCORED, TIER_SQL, judged, tiers
from .proxies import NEWS, NOW, POSTINGS, news, postings
from .state_queries import STATE, state

#: Names of the bands by their days.
BAND_NAMES = {"hoje": 0, "semana": 7, "quinzena": 15, "mes": 30}
BANDS = f"bands as materialized ({_band_sql()})"


@query(f"with {BANDS} select tab, band, count(*) as n from bands group by 1, 2")
def a26_shown_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t06_bands(spark, sf_dir).groupBy("tab", "band").agg(F.count("*").alias("n"))


@query(
    f"""with {BANDS}, told as (select b.id, b.tab, n.link, c.cluster from bands b join (with {NEWS} select id, domain || '/' || (id % 400) as link from news) n using (id) join (with {CLUSTERS} select id, cluster from assigned) c using (id)),
promises as (select tab, 'id' as kind, id::varchar as key from told union all select tab, 'link', link from told union all select tab, 'cluster', cluster::varchar from told)
select tab, kind, count(*) as promised, (count(*) - count(distinct key))::bigint as repeated from promises group by 1, 2"""
)
def a28_duplicate_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tab's rows over all bands, how many repeat an item, a link or a cluster that another row has promised."""
    ranked = ranked_items(spark, sf_dir)
    shown = bands.cascade(ranked, band_now()).select("id", "tab").join(ranked.select("id", "link", "cluster"), "id")
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("key")) for kind in ("id", "link", "cluster")))
    return shown.select("tab", F.inline(keys)).groupBy("tab", "kind").agg(F.count("*").alias("promised"), (F.count("*") - F.countDistinct("key")).alias("repeated"))


@query(f"with {BANDS} select id, tab, place from bands where band = 7 and place <= 5")
def t07_band_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_slice(t06_bands(spark, sf_dir), "semana", 5).select("id", "tab", "place")


def band_slice(shown: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The rows of a named band in their order, at most ``most`` a tab; an unknown name is an error."""
    if name not in BAND_NAMES:
        raise ValueError(f"unknown band {name!r}: one of {', '.join(BAND_NAMES)}")
    rows = shown.where(F.col("band") == BAND_NAMES[name])
    return rows if most is None else rows.where(F.col("place") <= most)


@query(f"with {NEWS} select id, case when ts::date = date '2024-01-30' then 'hoje ' || strftime(ts, '%H:%M') when ts::date = date '2024-01-29' then 'ontem' else strftime(ts, '%d/%m') end as shown from news")
def f43_shown_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("id", calendar.shown_date(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("shown"))


RELATIVE = "case o_orderkey % 5 when 0 then 'Hoje' when 1 then 'Ontem' when 2 then 'Há ' || (o_orderkey % 90) || ' dias' when 3 then strftime(o_orderdate, '%d/%m/%Y') else 'sem data' end"


@query(f"select o_orderkey as id, case o_orderkey % 5 when 0 then date '{NOW}' when 1 then date '{NOW}' - 1 when 2 then date '{NOW}' - (o_orderkey % 90)::int when 3 then o_orderdate::date end as d from orders")
def f18_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr(RELATIVE.replace("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), calendar.relative_date(said, F.lit(NOW).cast("date")).alias("d"))


EASTERS = "(date '1995-04-16'), (date '1996-04-07'), (date '1997-03-30'), (date '1998-04-12'), (date '1999-04-04'), (date '2000-04-23'), (date '2001-04-15')"


@query(f"with e(e) as (values {EASTERS}) select count(*) as orders, o_orderdate::date - e as days_from_easter from orders join e on year(e) = year(o_orderdate) where abs(o_orderdate::date - e) <= 60 group by 2")
def f47_easter(spark: SparkSession, sf_dir: str) -> DataFrame:
    away = F.datediff(F.to_date("o_orderdate"), calendar.easter(F.year("o_orderdate")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(away.alias("days_from_easter")).where("abs(days_from_easter) <= 60").groupBy("days_from_easter").agg(F.count("*").alias("orders"))


@query(
    f"""with e(e) as (values {EASTERS}), days as (select unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day))::date as d),
c as (select d, strftime(d, '%m-%d') in {calendar.FIXED} or d - e in {calendar.MOVABLE} as holiday from days join e on year(e) = year(d))
select d, holiday, not holiday and dayofweek(d) not in (0, 6) as business, count(o_orderkey) as orders from c left join orders on o_orderdate::date = d group by all"""
)
def j19_calendar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("orders"))
    return calendar.calendar(spark, "1995-01-01", "2001-12-31").join(n, "d", "left").select("d", "holiday", "business", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("select source, count(*) as n from documents where lower(text) like '%worthless%' or lower(text) like '%pathetic%' or lower(text) like '%idiot%' group by source")
def g17_leaked_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("worthless", "pathetic", "idiot")))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("low", F.lower("text"))
    return d.where(F.exists(words, lambda w: F.contains("low", w))).groupBy("source").agg(F.count("*").alias("n"))


@query(f"with {SCORED} select id, final from judged where weight % 2 = 1 and final != 'fora'")
def g15_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a score yet are the only ones to work on."""
    p = judged(spark, sf_dir).withColumn("stored", F.when(F.col("weight") % 2 == 0, F.col("score")))
    return p.where("stored is null and final != 'fora'").select("id", "final")


@query("select p_partkey, coalesce(nullif(split_part(p_type, ' ', 1), ''), 'none') as first_word, length(p_name)::int as n from part")
def p01_conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of unlike columns in one closed schema."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    one = p.where("p_partkey % 2 = 0").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.length("p_name").alias("n"), F.lit(1).alias("extra"))
    two = p.where("p_partkey % 2 = 1").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.length("p_name").alias("n"))
    return one.unionByName(two, allowMissingColumns=True).select("p_partkey", F.coalesce(F.nullif("first_word", F.lit("")), F.lit("none")).alias("first_word"), "n")


@query("select o_orderkey as id, case when l_orderkey is null then 'fallback' else 'detalhe' end as extraction, coalesce(l_shipdate, o_orderdate)::date as d from orders left join (select l_orderkey, min(l_shipdate) as l_shipdate from lineitem where l_quantity > 40 group by 1) on l_orderkey = o_orderkey")
def p09_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail fields override listing fields; rows without a detail are flagged."""
    detail = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(detail, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("shipped").isNull(), "fallback").otherwise("detalhe").alias("extraction"), F.to_date(F.coalesce("shipped", "o_orderdate")).alias("d"))


#: Parts of the text that the gates see, by the kind of source.
BLOB_PARTS = {0: ("org", "area", "degree"), 1: ("org", "kind"), 2: ("area", "degree", "uf"), 3: ("org", "uf", "track")}


def _blob_sql(parts: tuple[str, ...]) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"nullif(trim({c}), '')" for c in parts) + ")"


@query(f"with {POSTINGS} select id, case source_no % 4 " + " ".join(f"when {k} then {_blob_sql(v)}" for k, v in BLOB_PARTS.items()) + " end as blob from postings")
def p11_filter_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the gates see: the parts that a source of this kind has, empty ones left out."""
    blob = F.coalesce(*(F.when(F.col("source_no") % 4 == k, F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in v))) for k, v in BLOB_PARTS.items()))
    return postings(spark, sf_dir).select("id", blob.alias("blob"))


@query("select s_suppkey, coalesce(case when s_nationkey < 10 then n_name end, replace(replace(s_name, 'Supplier', 'Sup'), '#', '')) as shown, s_nationkey < 10 as mapped, s_name from supplier join nation on n_nationkey = s_nationkey")
def j12_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup, else ordered text substitutions."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(n, "s_nationkey", "left")
    fallback = F.replace(F.replace("s_name", F.lit("Supplier"), F.lit("Sup")), F.lit("#"), F.lit(""))
    return s.select("s_suppkey", F.coalesce("n_name", fallback).alias("shown"), F.col("n_name").isNotNull().alias("mapped"), "s_name")


@query("with m as (select s_nationkey < 10 as mapped, s_name from supplier) select mapped, count(*) as n, count(distinct s_name) as names from m group by mapped")
def a27_mapped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j12_display_names(spark, sf_dir).groupBy("mapped").agg(F.count("*").alias("n"), F.countDistinct("s_name").alias("names"))


@query(f"with {STATE}, t as (select url, turn, voice, case when turn % 3 = 2 then turn - 1 end as blocked_by from state), done as (select url, turn from t where voice = 'robo') select t.url, t.turn, t.blocked_by is not null and exists (select 1 from t b where b.url = t.url and b.turn = t.blocked_by) and not exists (select 1 from done d where d.url = t.url and d.turn = t.blocked_by) as blocked from t")
def j15_blocked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked only if the named blocker exists and is not done."""
    t = state(spark, sf_dir).select("url", "turn", "voice", F.when(F.col("turn") % 3 == 2, F.col("turn") - 1).alias("blocked_by"))
    b = t.select("url", F.col("turn").alias("blocked_by"), (F.col("voice") != "robo").alias("still_open"))
    return t.join(b, ["url", "blocked_by"], "left").select("url", "turn", F.coalesce("still_open", F.lit(False)).alias("blocked"))


@query("with s as (select distinct event_type from events union select 'never'), l as (select event_type, max(event_id) as last_id from events group by 1) select s.event_type, coalesce(last_id::varchar, 'nunca coletada') as status from s left join l using (event_type)")
def j20_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sources = e.select("event_type").distinct().union(spark.createDataFrame([("never",)], "event_type string"))
    last = e.groupBy("event_type").agg(F.max("event_id").alias("last_id"))
    return sources.join(last, "event_type", "left").select("event_type", F.coalesce(F.col("last_id").cast("string"), F.lit("nunca coletada")).alias("status"))


@query("select event_type, event_id, ts, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1")
def s03_latest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each source as a whole; of equal times the one appended last."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return last.select("event_type", "x.event_id", "x.ts", "x.value")


@query("select user_id, event_type, count(*) as n from events group by 1, 2")
def k01_appended_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended in a partitioned table, read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    path = new_dir(spark, "health")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        e.where(part).write.mode("append").partitionBy("event_type").parquet(path)
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"with {POSTINGS} select id, coalesce(area, '') as area, coalesce(degree, '') as degree, weight from postings")
def k02_published_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns in order, empty text for null, numbers stay numbers."""
    return written(postings(spark, sf_dir).select("id", F.coalesce("area", F.lit("")).alias("area"), F.coalesce("degree", F.lit("")).alias("degree"), "weight"), "facts")


@query(f"with {SCORED}, {TIER_SQL}, c as (select sum((tier = 1)::int) as t1, sum((tier = 2)::int) as t2, sum((tier <= 6)::int) as t6 from tiers) select case when t1 > 0 then t1 || ' elegíveis abertas' when t2 > 0 then t2 || ' a conferir' when t6 > 0 then t6 || ' abertas' else 'nada aberto' end as verdict from c")
def v03_verdict_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tiers(spark, sf_dir).agg(F.count_if(F.col("tier") == 1).alias("t1"), F.count_if(F.col("tier") == 2).alias("t2"), F.count_if(F.col("tier") <= 6).alias("t6"))
    said = lambda c, t: F.concat(F.col(c).cast("string"), F.lit(t))
    return c.select(F.when(F.col("t1") > 0, said("t1", " elegíveis abertas")).when(F.col("t2") > 0, said("t2", " a conferir")).when(F.col("t6") > 0, said("t6", " abertas")).otherwise("nada aberto").alias("verdict"))


@query(f"with {SCORED}, {TIER_SQL}, n as (select tier, count(*) as total from tiers group by tier) select tier, total, case when total > 10 then total - 10 end as beyond from n")
def t09_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("total"))
    return n.select("tier", "total", F.when(F.col("total") > 10, F.col("total") - 10).alias("beyond"))


@query("with d as (select distinct source as x from documents), k as (select 'src' || unnest(range(0, 25)) as x) select x, 'only in data' as side from d where x not in (select x from k) union all select x, 'only in dictionary' from k where x not in (select x from d)")
def u07x_two_way_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("x")).distinct()
    k = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("x"))
    return d.join(k, "x", "left_anti").select("x", F.lit("only in data").alias("side")).union(k.join(d, "x", "left_anti").select("x", F.lit("only in dictionary")))


@query(f"with {NEWS}, s as (select id, tab, theme, (id * 7919 % 997)::int as score from news), r as (select *, row_number() over (partition by tab, theme order by score desc, id) as place from s) select id, tab, theme, place::int as place from r where place <= 20")
def w06_rank_per_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = news(spark, sf_dir).select("id", "tab", "theme", (F.col("id") * 7919 % 997).cast("int").alias("score"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("tab", "theme").orderBy(F.desc("score"), "id"))).where("place <= 20").select("id", "tab", "theme", "place")


@query("select user_id, min(ts) as first_seen, count(*) as n from events group by user_id")
def w12_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))
