"""Queries over events as signals: ranks, percentiles, freshness and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators.clusters import mid_rank_percentile
from ..registry import query


@query("""
with r as (
  select event_id, event_type, value, ts::date as day,
    round(((rank() over (partition by ts::date, event_type order by value) - 1) + 0.5 * count(*) over (partition by ts::date, event_type, value))
      / count(*) over (partition by ts::date, event_type) * 100, 6) as percentile
  from events),
p as (select *, row_number() over (partition by event_type order by percentile desc, value desc, event_id) as place from r)
select event_id, event_type, day, percentile, place::int as place from p where place <= 20
""")
def w1_midrank_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    ranked = mid_rank_percentile(e, ["day", "event_type"], "value").withColumn("percentile", F.round("percentile", 6))
    best = Window.partitionBy("event_type").orderBy(F.desc("percentile"), F.desc("value"), "event_id")
    return ranked.withColumn("place", F.row_number().over(best)).where("place <= 20").select("event_id", "event_type", "day", "percentile", "place")


LAST = "timestamp '2024-01-31'"


@query("select event_id, event_type, round(2 * log10(value + 1) + 1.5 * log10((props::json->>'k')::int + 1), 4) as signal from events")
def f36_raw_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "event_type", scoring.raw_signal(F.col("value"), F.get_json_object("props", "$.k").cast("int"), F.lit(None)).alias("signal"))


@query(
    f"""with s as (select event_id, event_type, ts::date as day, round(2 * log10(value + 1), 4) as signal from events),
p as (select *, ((rank() over (partition by day, event_type order by signal) - 1) + 0.5 * count(*) over (partition by day, event_type, signal)) / count(*) over (partition by day, event_type) * 100 as pct from s)
select event_id, round(pct / 100 * 60)::int as repercussion, round(pct / 100 * 60)::int + least(40, event_id % 50)::int as score from p"""
)
def f37_repercussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the percentile before it is rounded."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.to_date("ts").alias("day"), F.round(2 * F.log10(F.col("value") + 1), 4).alias("signal"))
    p = mid_rank_percentile(e, ["day", "event_type"], "signal")
    part = F.round(F.col("percentile") / 100 * 60).cast("int")
    return p.select("event_id", part.alias("repercussion"), (part + F.least(F.lit(40), F.col("event_id") % 50).cast("int")).alias("score"))


#: The list has feeds that bring nothing, some that may go undated, and dead ones (their numbers end with 9), whose items are two months older.
VERDICTS = f"""feeds as (select unnest(range(0, 60)) as feed), dated as (select *, user_id % 50 as feed, case when user_id % 10 = 9 then ts - interval 60 day when user_id % 50 % 8 != 3 then ts end as said from events),
f as (select feed, count(event_id) as n, count(said) as dated, max(said) as last_ts from feeds left join dated using (feed) group by feed),
verdicts as (select feed, n, case when n = 0 then 'vazio' when dated = 0 then case when feed % 16 = 3 then 'sem data permitido' else 'sem data' end when last_ts < {LAST} - interval 7 day then 'velho' else 'fresco' end as verdict from f)"""


@query(f"with {VERDICTS} select feed, n, verdict from verdicts")
def a15_feed_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed of the list has a verdict: those without items and without dates too; some may go undated."""
    return feed_verdicts(spark, sf_dir).select("feed", "n", "verdict")


def feed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = spark.range(60).select(F.col("id").alias("feed"), (F.col("id") % 16 == 3).alias("undated_allowed"))
    u = F.col("user_id")
    said = F.when(u % 10 == 9, F.col("ts") - F.expr("interval 60 days")).when(u % 50 % 8 != 3, F.col("ts"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((u % 50).alias("feed"), said.alias("ts"))
    f = feeds.join(e.groupBy("feed").agg(F.count("*").alias("n"), F.count("ts").alias("dated"), F.max("ts").alias("last_ts")), "feed", "left")
    old = F.col("last_ts") < F.lit("2024-01-31").cast("timestamp") - F.expr("interval 7 days")
    undated = F.when(F.col("undated_allowed"), "sem data permitido").otherwise("sem data")
    n = F.coalesce("n", F.lit(0))
    return f.select("feed", n.alias("n"), F.when(n == 0, "vazio").when(F.col("dated") == 0, undated).when(old, "velho").otherwise("fresco").alias("verdict"))


@query(f"with {VERDICTS} select feed, verdict, verdict in ('vazio', 'velho', 'sem data') as rejected from verdicts where feed % 10 = 9")
def a33_dead_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds known to be dead: what brings items of long ago is rejected by the verdict that all feeds get, or the run is unsound."""
    return feed_verdicts(spark, sf_dir).where("feed % 10 = 9").select("feed", "verdict", F.col("verdict").isin("vazio", "velho", "sem data").alias("rejected"))


@query(f"select event_id, ts from events where ts is null or ts >= {LAST} - interval 10 day")
def g08_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit("2024-01-31").cast("timestamp") - F.expr("interval 10 days")
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("ts").isNull() | (F.col("ts") >= limit)).select("event_id", "ts")


@query("select source, round(avg((length(text) > 0)::int), 6) as has_text, round(avg((text like '%' || chr(10) || '%')::int), 6) as has_lines, round(avg((regexp_matches(text, 'https?://'))::int), 6) as has_link from documents group by source")
def a16_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(rate(F.length(t) > 0, "has_text"), rate(t.contains("\n"), "has_lines"), rate(t.rlike("https?://"), "has_link"))


@query(f"select min(ts)::date as first_seen, (min(ts) + interval 30 day)::date as complete_on, min(ts) + interval 30 day <= {LAST} as complete, greatest(0, ceil((epoch(min(ts)) + 30 * 86400 - epoch({LAST})) / 86400))::bigint as days_missing from events")
def a17_store_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp")
    first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").cast("timestamp").alias("m"))
    end = F.col("m") + F.expr("interval 30 days")
    left = F.ceil((F.unix_micros("m") / 1000000 + 30 * 86400 - F.unix_timestamp(now)) / 86400)
    return first.select(F.to_date("m").alias("first_seen"), F.to_date(end).alias("complete_on"), (end <= now).alias("complete"), F.greatest(F.lit(0), left).alias("days_missing"))


@query("with d as (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day))::date as day), n as (select ts::date as day, event_type, count(*) as n from events group by 1, 2), t as (select distinct event_type from events) select d.day, t.event_type, coalesce(n, 0)::bigint as volume, case when coalesce(n, 0) = 0 then case when dayofweek(d.day) in (0, 6) or d.day = date '2024-01-01' then 'ok' else 'critico' end when n < 50 then 'atencao' else 'ok' end as level from d cross join t left join n on n.day = d.day and n.event_type = t.event_type")
def a18_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without volume are fine on weekends and holidays only; the grid is days times event types, both small."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    grid = e.select("event_type").distinct().select("event_type", F.explode(F.expr("sequence(date '2024-01-01', date '2024-01-31')")).alias("day"))
    volume = F.coalesce("n", F.lit(0))
    rest = F.dayofweek("day").isin(1, 7) | (F.col("day") == F.lit("2024-01-01").cast("date"))
    level = F.when(volume == 0, F.when(rest, "ok").otherwise("critico")).when(volume < 50, "atencao").otherwise("ok")
    return grid.join(n, ["day", "event_type"], "left").select("day", "event_type", volume.alias("volume"), level.alias("level"))


@query("with days as (select unnest(generate_series(date '1995-01-01', date '2001-12-31', interval 1 day))::date as d), c as (select d, sum((dayofweek(d) not in (0, 6) and not (month(d) = 12 and day(d) = 25) and not (month(d) = 1 and day(d) = 1))::int) over (order by d) as n from days) select o_orderkey, (b.n - a.n + (dayofweek(o_orderdate::date) not in (0, 6) and not (month(o_orderdate) = 12 and day(o_orderdate) = 25) and not (month(o_orderdate) = 1 and day(o_orderdate) = 1))::int)::bigint as business_days from orders join (select l_orderkey, max(l_shipdate)::date as last from lineitem group by 1) on l_orderkey = o_orderkey join c a on a.d = o_orderdate::date join c b on b.d = last")
def f48_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business days of each order's span, both ends included, by two lookups in a cumulative calendar."""
    fixed_holiday = F.date_format("d", "MM-dd").isin("12-25", "01-01")
    work = (~F.dayofweek("d").isin(1, 7) & ~fixed_holiday).cast("int")
    days = spark.sql("select explode(sequence(date '1995-01-01', date '2001-12-31')) as d").select("d", work.alias("work"))
    c = F.broadcast(days.select("d", "work", F.sum("work").over(Window.orderBy("d")).alias("n")))  # a fixed calendar of seven years
    last = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(last, F.expr("l_orderkey = o_orderkey")).withColumn("first", F.to_date("o_orderdate"))
    a, b = c.toDF("first", "work_a", "n_a"), c.toDF("last", "work_b", "n_b")
    return o.join(a, "first").join(b, "last").select("o_orderkey", (F.col("n_b") - F.col("n_a") + F.col("work_a")).alias("business_days"))


@query("select event_type, ts::date as day, count(*) as n from events group by 1, 2")
def st07_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, counted in one-day windows."""
    from ..streaming.jobs import drained

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    counts = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(counts.select("event_type", F.to_date("w.start").alias("day"), "n"), "complete")


@query("select user_id, event_type, min(event_id) as first_event from events group by 1, 2")
def st01_unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch inserts the keys that the table doesn't hold yet."""
    from ..streaming.jobs import insert_unseen

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return insert_unseen(e, ["user_id", "event_type"], "event_id", "first_event")


@query("select distinct user_id, event_type, ts::date as day from events")
def st03_once_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly once by key within the horizon; the watermark lets the state of older keys go."""
    from ..streaming.jobs import drained

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    once = e.select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])
    return drained(once, "append").drop("at")
