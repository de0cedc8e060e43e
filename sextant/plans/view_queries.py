"""Queries of views, boards, reports and sinks, of the news pipeline, and of streams with their failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, extract, gates, text
from ..operators import clusters, merges
from ..operators import terms as index
from ..operators.health import health_level
from ..operators.snapshots import Snapshots
from ..operators.storage import new_dir, written
from ..registry import query
from ..sources import feeds
from ..streaming import jobs, stateful
from .news_queries import CLUSTERS, TERMS, _band_sql, items, t06_bands, terms
from .notice_queries import main_area, term_hits
from .posting_queries import SCORED, judged
from .proxies import NEWS, news
from .signal_queries import LAST
from .source_queries import feed_payloads
from .state_queries import STATE, state

BANDS = f"bands as materialized ({_band_sql()})"

# ---- terms and themes

#: Theme and its terms; a star ends a prefix.  Themes that aren't named let everything pass.
THEME_TERMS = {"tema0": ("tion*", "was"), "tema1": ("that",), "tema5": ("la", "der", "en*")}


def term_sql(column: str, term: str) -> str:
    return f"regexp_matches({column}, '(^|[^a-z0-9_]){term.rstrip('*')}" + ("')" if term.endswith("*") else "([^a-z0-9_]|$)')")


TITLED = "lower(strip_accents(title))"


@query(f"with {NEWS} select id, theme from news where " + " and ".join(f"(theme != '{k}' or {' or '.join(term_sql(TITLED, t) for t in v)})" for k, v in THEME_TERMS.items()))
def g07_theme_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a filtered theme stay if any of its terms is in the title; a theme without terms is an error."""
    if any(not v for v in THEME_TERMS.values()):
        raise ValueError("a filtered theme needs terms")
    passes = F.lit(True)
    for theme, words in THEME_TERMS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | gates.has_term(F.col("title"), w)
        passes = passes & ((F.col("theme") != theme) | hit)
    return news(spark, sf_dir).where(passes).select("id", "theme")


@query(f"with {NEWS} " + " union all ".join(f"select '{t}' as term, count_if({term_sql(TITLED, t)})::bigint as n from news" for t in ("tion*", "was", "the", "en*", "la")))
def f12_term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ("tion*", "was", "the", "en*", "la")
    hit = F.array(*(F.struct(F.lit(w).alias("term"), gates.has_term(F.col("title"), w).alias("hit")) for w in words))
    return news(spark, sf_dir).select(F.inline(hit)).groupBy("term").agg(F.count_if("hit").alias("n"))


@query(
    f"""with {TERMS}, own as (select lower(term) as term, 9.5 as weight from (select item_id, unnest(string_split(text, ' ')) as term from benchmark) where length(term) >= 9 and not regexp_matches(term, '[^a-zA-Z]') group by 1)
select term, round(coalesce(own.weight, (['10', '20', '30', '15', '0'])[right(area, 1)::int + 1]::double / 5 * case when area = 'area2' then 1.25 else 1 end), 2)::double as weight, case when own.term is null then 'base' else 'news' end as origin
from terms left join own using (term) where own.term is not null or area != 'area4'"""
)
def f39_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the area's weight, a quarter more for the profile's area; the news dictionary overrides; weightless terms go."""
    base = spark.createDataFrame([(f"area{k}", w) for k, w in enumerate((10.0, 20.0, 30.0, 15.0, 0.0))], "area string, area_weight double")
    t = terms(spark, sf_dir).join(F.broadcast(base), "area").select("term", (F.col("area_weight") / 5 * F.when(F.col("area") == "area2", 1.25).otherwise(1.0)).alias("base"))
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", " ")).alias("term")).select(F.lower("term").alias("term")).where("length(term) >= 9 and not term rlike '[^a-zA-Z]'").distinct().withColumn("own", F.lit(9.5))
    return t.join(own, "term", "left").where("own is not null or base > 0").select("term", F.round(F.coalesce("own", "base"), 2).alias("weight"), F.when(F.col("own").isNull(), "base").otherwise("news").alias("origin"))


@query(f"with {NEWS} select id, case when tab = 'ia' and theme != 'tema4' and {term_sql(TITLED, 'the')} then 'claude' else theme end as theme from news")
def v13_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one tab that hit a listed term move to their own theme; rows outside the known tabs or themes are an error."""
    known = [(t, f"tema{k}") for t in ("geral", "ia", "trabalho", "ciencia") for k in range(9)]
    n = news(spark, sf_dir)
    stray = n.select("tab", "theme").distinct().join(spark.createDataFrame(known, "tab string, theme string"), ["tab", "theme"], "left_anti")
    if not stray.isEmpty():
        raise ValueError("unknown tab or theme")
    moved = (F.col("tab") == "ia") & (F.col("theme") != "tema4") & gates.has_term(F.col("title"), "the")
    return n.select("id", F.when(moved, "claude").otherwise(F.col("theme")).alias("theme"))


# ---- the news pipeline

FEED_ITEMS = f"""raw as (select doc_id, doc_id // 100 as feed, trim(split_part(text, chr(10), 1)) as title, timestamp '2024-01-01' + to_hours(doc_id::int) as ts from documents where trim(split_part(text, chr(10), 1)) != ''),
fresh as (select *, max(ts) over (partition by feed) as newest, min(ts) over () as epoch_start from raw),
alive as (select * from fresh where feed % 10 != 9 and newest >= epoch_start + interval 20 hour and ts >= newest - interval 90 hour),
firsts as (select * from alive qualify row_number() over (partition by lower(title) order by feed % 4, feed, doc_id) = 1),
routed as (select *, (['ciencia', 'ia', 'trabalho', 'geral'])[(feed % 4 + 1)::int] as tab, case when feed % 4 = 1 and {term_sql(TITLED, 'the')} then 'claude' else 'tema' || feed % 3 end as theme, doc_id * 7919 % 101 as signal from firsts)"""


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of fresh feeds, one row a title, with their tab and theme."""
    parsed = feeds.parse_feed(feed_payloads(spark, sf_dir, atom=False)).withColumn("id", F.regexp_extract("link", "([0-9]+)$", 1).cast("long"))
    parsed = written(parsed.withColumn("newest", F.max("ts").over(Window.partitionBy("feed"))), "parsed")
    start = parsed.agg(F.min("ts").alias("epoch_start"))
    kept = parsed.where("feed % 10 != 9").join(F.broadcast(start)).where("newest >= epoch_start + interval 20 hours and ts >= newest - interval 90 hours")  # one row
    one = feeds.first_per_key(kept.select("feed", "id", "title", "ts", F.lower("title").alias("title_key"), F.struct(F.col("feed") % 4, "feed", "id").alias("arrival")), ["title_key"], "arrival")
    tab = F.element_at(F.array(*map(F.lit, ("ciencia", "ia", "trabalho", "geral"))), (F.col("feed") % 4 + 1).cast("int"))
    theme = F.when((F.col("feed") % 4 == 1) & gates.has_term(F.col("title"), "the"), "claude").otherwise(F.concat(F.lit("tema"), (F.col("feed") % 3).cast("string")))
    lang = F.when(F.col("feed") % 3 == 0, "pt").otherwise("en")
    domain = F.concat(F.lit("pub"), (F.col("feed") % 7).cast("string"))
    return one.select("id", "title", lang.alias("lang"), domain.alias("domain"), tab.alias("tab"), theme.alias("theme"), "ts", (F.col("id") * 7919 % 101).alias("signal"))


@query(f"with {FEED_ITEMS} select doc_id as id, tab, theme, round(((rank() over (partition by tab, theme order by signal) - 1) + 0.5 * count(*) over (partition by tab, theme, signal)) / count(*) over (partition by tab, theme) * 100, 6) as percentile from routed")
def v12_news_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, freshness of feeds, age of items, one row a title by tab precedence, routing, rank: feeds in, ranked items out."""
    routed = feed_items(spark, sf_dir)
    return clusters.mid_rank_percentile(routed, ["tab", "theme"], "signal").select("id", "tab", "theme", F.round("percentile", 6).alias("percentile"))


#: Themes of the feeds that keep titles with one of these terms only.
FEED_TERMS = {"tema1": ("the", "en*", "la"), "tema2": ("der", "tion*", "and")}
#: Polls of the feeds: items of the first hours, then the rest.
FIRST_HOURS = 480
FEED_NEWS = f"""{FEED_ITEMS}, news as (select doc_id as id, title, case when feed % 3 = 0 then 'pt' else 'en' end as lang, 'pub' || feed % 7 as domain, tab, theme, ts, signal from routed
  where {' and '.join(f"(theme != '{k}' or {' or '.join(term_sql(TITLED, t) for t in v)})" for k, v in FEED_TERMS.items())})"""


def filtered_by_terms(rows: DataFrame) -> DataFrame:
    """Items of a theme with terms stay if their title has one of them."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, t) for k, v in FEED_TERMS.items() for t in v], "theme string, term string")
    met = index.term_hits(rows.where(F.col("theme").isin(list(FEED_TERMS))).select("id", F.col("title").alias("text")), wanted.select("term").distinct())
    kept = met.join(rows.select("id", "theme"), "id").join(wanted, ["theme", "term"]).select("id").distinct()
    return rows.where(~F.col("theme").isin(list(FEED_TERMS))).unionByName(rows.join(kept, "id", "left_semi"))


DERIVED = ["cluster", "n_items", "percentile"]


def stored_news(store: Snapshots, batch: DataFrame, number: int) -> int:
    """One poll: items that are new join the stored clusters, all are scored anew, and the store takes new rows whole and of known rows the derived columns."""
    columns = ["id", "title", "lang", "domain", "tab", "theme", "ts", "signal", "anchors", "first_poll"]
    rows = batch.withColumn("anchors", text.anchors(F.col("title"))).withColumn("first_poll", F.lit(number)).select(columns)
    latest = store.latest()
    if latest is None:
        everything, placed = rows, clusters.clustered(rows)
        stored = rows.limit(0).select("*", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("n_items"), F.lit(0.0).alias("percentile"), F.lit(0).alias("updated_at"))
    else:
        stored = store.read(latest)
        fresh = rows.join(stored.select("id"), "id", "left_anti")
        everything = stored.select(columns).unionByName(fresh)
        placed = clusters.with_fresh(stored.select(*columns, "cluster"), fresh)
    placed = written(placed, "news-clusters")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n_items"))
    scored = clusters.mid_rank_percentile(everything, ["tab", "theme"], "signal").drop("batch").join(placed.join(sizes, "cluster"), "id")
    merged = merges.upsert(stored, scored.withColumn("updated_at", F.lit(number)), "id", DERIVED, F.lit(number))
    return store.commit(merged.drop("inserted"), latest)


@query(
    "with recursive " + CLUSTERS.removeprefix("recursive ").replace(NEWS, FEED_NEWS) + f""", grown as (select cluster, count(*) as n_items from assigned group by 1)
select id, tab, theme, cluster, n_items, round(((rank() over (partition by tab, theme order by signal) - 1) + 0.5 * count(*) over (partition by tab, theme, signal)) / count(*) over (partition by tab, theme) * 100, 6) as percentile,
  case when ts < (select min(epoch_start) from fresh) + interval {FIRST_HOURS} hour then 1 else 2 end as first_poll from news join assigned using (id) join grown using (cluster)"""
)
def v12x_news_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds to a store in two polls: parse, freshness, age, one row a title, routing, theme filter, clusters that grow, ranks, merge; two polls give what one would."""
    rows = written(filtered_by_terms(feed_items(spark, sf_dir)), "feed-items")
    start = feeds.parse_feed(feed_payloads(spark, sf_dir, atom=False)).agg(F.min("ts")).first()[0]
    if start is None:
        return rows.limit(0).select("id", "tab", "theme", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("n_items"), F.lit(0.0).alias("percentile"), F.lit(0).alias("first_poll"))
    early = F.col("ts") < F.lit(start) + F.make_dt_interval(hours=F.lit(FIRST_HOURS))
    store = Snapshots(spark, new_dir(spark, "news-store"))
    for number, batch in enumerate((rows.where(early), rows.where(~early)), 1):
        stored_news(store, batch, number)
    return store.read().select("id", "tab", "theme", "cluster", "n_items", F.round("percentile", 6).alias("percentile"), "first_poll")


@query("with " + CLUSTERS.replace("else 0.34", "else 0.5").replace("36 * 3600", "72 * 3600") + " select id, cluster from assigned")
def v15_reclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items clustered anew with other parameters, their anchors extracted again."""
    return clusters.clustered(items(spark, sf_dir), across=0.5, hours=72)


PUBLISHERS = f"pub as materialized (with {CLUSTERS}, c as (select cluster, count(distinct domain) as n from assigned join news using (id) group by cluster) select a.id, c.n from assigned a join c using (cluster))"
FACTS = f"with {BANDS}, {PUBLISHERS} select b.id, b.tab, b.band, b.place, n.theme, pub.n as publishers, case when pub.n > case when b.tab = 'geral' then 2 else 1 end then 'repercute' else '' end as marker from bands b join pub using (id) join (with {NEWS} select id, theme from news) n using (id)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the bands with their cluster's publishers."""
    i = items(spark, sf_dir)
    found = written(clusters.clustered(i), "clusters")
    per = i.join(found, "id").groupBy("cluster").agg(F.countDistinct("domain").alias("publishers"))
    shown = t06_bands(spark, sf_dir).join(found, "id").join(per, "cluster")
    marker = F.when(F.col("publishers") > F.when(F.col("tab") == "geral", 2).otherwise(1), "repercute").otherwise("")
    return shown.select("id", "tab", "band", "place", "theme", "publishers", marker.alias("marker"))


@query(FACTS)
def v06_news_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tabs of four bands, with a mark where more publishers tell the same."""
    return facts(spark, sf_dir)


@query(f"select tab, band, count(*) as n, count_if(theme != '' and place <= 20)::bigint as sound from ({FACTS}) group by tab, band")
def k03_news_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table replaced as a whole and read back."""
    path = new_dir(spark, "news-facts")
    t06_bands(spark, sf_dir).select("id", "tab", "band", "place", "theme").write.mode("overwrite").parquet(path)
    f = spark.read.schema("id long, tab string, band int, place int, theme string").parquet(path)
    return f.groupBy("tab", "band").agg(F.count("*").alias("n"), F.count_if((F.col("theme") != "") & (F.col("place") <= 20)).alias("sound"))


@query(f"with v as ({FACTS}) select tab, band, count(*) as shown, count(*) as stored, count(*) <= 20 as holds from v group by tab, band")
def a29_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the view, worked out anew, against those of the published table, by tab and band: it holds if they are the same rows."""
    store = Snapshots(spark, new_dir(spark, "published-facts"))
    store.commit(facts(spark, sf_dir).select("id", "tab", "band"), None)
    view = v06_news_tables(spark, sf_dir).select("id", "tab", "band", F.lit(1).alias("in_view"))
    both = view.join(store.read().withColumn("in_store", F.lit(1)), ["id", "tab", "band"], "full")
    counts = both.groupBy("tab", "band").agg(F.count("in_view").alias("shown"), F.count("in_store").alias("stored"), F.count_if(F.col("in_view").isNotNull() & F.col("in_store").isNotNull()).alias("same"))
    return counts.select("tab", "band", "shown", "stored", ((F.col("same") == F.col("shown")) & (F.col("same") == F.col("stored")) & (F.col("shown") <= 20)).alias("holds"))


# ---- health, stamps and reports

WORKDAYS = "wd as (select d, sum((dayofweek(d) not in (0, 6))::int) over (order by d) as n from (select unnest(generate_series(date '2024-01-02', date '2024-02-09', interval 1 day))::date as d))"


@query(
    f"""with {WORKDAYS}, s as (select s_suppkey as id, s_suppkey % 2 = 0 as is_news, case when s_suppkey % 7 != 0 then date '2024-02-07' - (s_suppkey % 10)::int end as stamp from supplier)
select id, case when stamp is null then true when is_news then date '2024-02-07' - stamp >= 2 else b.n - a.n >= 3 end as alarm from s left join wd a on a.d = stamp join wd b on b.d = date '2024-02-07'"""
)
def v07_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three business days since the stamp for postings, two days for news, always without a stamp."""
    today = F.lit("2024-02-07").cast("date")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, F.date_sub(today, (F.col("s_suppkey") % 10).cast("int"))).alias("d"))
    c = calendar.calendar(spark, "2024-01-02", "2024-02-09").select("d", "n_business")
    now = c.where("d = date '2024-02-07'").select(F.col("n_business").alias("n_now"))
    j = s.join(F.broadcast(c), "d", "left").join(F.broadcast(now))  # forty days, one row
    alarm = F.when(F.col("d").isNull(), True).when(F.col("id") % 2 == 0, F.datediff(today, "d") >= 2).otherwise(F.col("n_now") - F.col("n_business") >= 3)
    return j.select("id", alarm.alias("alarm"))


@query(
    f"""with {STATE}, {WORKDAYS}, p as (select url, count(*) as total, count_if(voice = 'robo') as done, case when url % 11 != 0 then date '2024-02-07' - (url % 20)::int end as last_move, date '2024-02-07' + (url % 9 - 2)::int as deadline, url % 6 = 5 as no_open from state group by url)
select url, case when done * 2 >= total and url % 3 = 0 then 'entregue' when deadline < date '2024-02-07' then 'atrasado' when last_move is null then 'sem sinal' when b.n - a.n >= 7 then 'parado' when no_open then 'sem direcao' else 'em dia' end as health
from p left join wd a on a.d = last_move join wd b on b.d = date '2024-02-07'"""
)
def f40_project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered, late, no signal, stalled for seven business days, no direction, on track: the first that holds."""
    today, u = F.lit("2024-02-07").cast("date"), F.col("url")
    p = state(spark, sf_dir).groupBy("url").agg(F.count("*").alias("total"), F.count_if(F.col("voice") == "robo").alias("done"))
    p = p.withColumn("d", F.when(u % 11 != 0, F.date_sub(today, (u % 20).cast("int")))).withColumn("deadline", F.date_add(today, (u % 9 - 2).cast("int")))
    c = calendar.calendar(spark, "2024-01-02", "2024-02-09").select("d", "n_business")
    now = c.where("d = date '2024-02-07'").select(F.col("n_business").alias("n_now"))
    j = p.join(F.broadcast(c), "d", "left").join(F.broadcast(now))  # forty days, one row
    health = F.when((F.col("done") * 2 >= F.col("total")) & (u % 3 == 0), "entregue").when(F.col("deadline") < today, "atrasado").when(F.col("d").isNull(), "sem sinal").when(F.col("n_now") - F.col("n_business") >= 7, "parado").when(u % 6 == 5, "sem direcao").otherwise("em dia")
    return j.select("url", health.alias("health"))


@query(f"with {SCORED} select 'postings' as name, count(*) as n, date '2024-02-07' as stamped_on, '07/02/2024' as said from judged")
def k04_publish_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stamp is written after the table has been committed, and says what was."""
    table = written(judged(spark, sf_dir).select("id", "score", "final"), "published")
    day = F.lit("2024-02-07").cast("date")
    return written(table.agg(F.count("*").alias("n")).select(F.lit("postings").alias("name"), "n", day.alias("stamped_on"), F.date_format(day, "dd/MM/yyyy").alias("said")), "publish-log")


@query("select event_id, ts, true as in_order from events")
def k05_sorted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store rewritten newest first: ranges of time, sorted inside; the order is read back from the files and the places of the rows in them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    path = new_dir(spark, "sorted-store")
    e.repartitionByRange(F.desc("ts")).sortWithinPartitions(F.desc("ts"), F.desc("event_id")).write.parquet(path)
    stored = spark.read.schema(e.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    inside = stored.withColumn("before", F.lag("ts").over(Window.partitionBy("file").orderBy("row")))
    files = inside.groupBy("file").agg(F.max("ts").alias("newest"), F.min("ts").alias("oldest"), F.count_if(F.col("ts") > F.col("before")).alias("wrong"))
    over = Window.orderBy("file")  # a row a file
    verdict = files.withColumn("wrong", F.col("wrong") + F.coalesce((F.col("newest") > F.lag("oldest").over(over)).cast("int"), F.lit(0))).agg((F.sum("wrong") == 0).alias("in_order"))
    return stored.crossJoin(F.broadcast(verdict)).select("event_id", "ts", "in_order")  # one row


@query(f"with {SCORED} select case when grouping(final) = 0 then 'verdict' when grouping(uf) = 0 then 'uf' else 'month' end as section, coalesce(final, uf, strftime(month, '%Y-%m')) as key, count(*) as n, max(score) as best from (select *, date_trunc('month', published) as month from judged) group by grouping sets ((final), (uf), (month))")
def k06_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's sections from one pass."""
    j = judged(spark, sf_dir).withColumn("month", F.date_format("published", "yyyy-MM"))
    g = j.groupingSets([["final"], ["uf"], ["month"]], "final", "uf", "month").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.grouping("final").alias("g1"), F.grouping("uf").alias("g2"))
    return g.select(F.when(F.col("g1") == 0, "verdict").when(F.col("g2") == 0, "uf").otherwise("month").alias("section"), F.coalesce("final", "uf", "month").alias("key"), "n", "best")


@query(
    f"""with {SCORED}, r as (select *, case when final = 'fora' then null else coalesce(area, 'sem área') end as profile_area from judged),
totals as (select count(*) as total, count_if(final != 'fora') as eligible from r)
select 'total' as section, 'total' as key, total::bigint as n, round(eligible / total, 6) as share from totals
union all select 'area', profile_area, count(*), round(count(*) / (select eligible from totals), 6) from r where profile_area is not null group by profile_area
union all select 'degree', coalesce(degree, 'sem exigência'), count(*), round(count_if(final != 'fora') / count(*), 6) from r group by 2"""
)
def k06x_profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one profile: how many postings are eligible, in which areas, and what each degree leaves open."""
    j = judged(spark, sf_dir).withColumn("open", F.col("final") != "fora")
    totals = written(j.agg(F.count("*").alias("total"), F.count_if("open").alias("eligible")), "report-totals")
    share = lambda a, b: F.round(a / b, 6).alias("share")
    whole = totals.where("total > 0").select(F.lit("total").alias("section"), F.lit("total").alias("key"), F.col("total").alias("n"), share(F.col("eligible"), F.col("total")))
    areas = j.where("open").groupBy(F.coalesce("area", F.lit("sem área")).alias("key")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(totals))  # one row
    degrees = j.groupBy(F.coalesce("degree", F.lit("sem exigência")).alias("key")).agg(F.count("*").alias("n"), F.count_if("open").alias("k"))
    return whole.unionByName(areas.select(F.lit("area").alias("section"), "key", "n", share(F.col("n"), F.col("eligible")))).unionByName(degrees.select(F.lit("degree").alias("section"), "key", "n", share(F.col("k"), F.col("n"))))

# ---- boards

BOARD = f"""{STATE}, {SCORED},
queue as (select 'fila' as block, url::varchar as key, 10 as most, row_number() over (order by url % 17, url) as place from (select distinct url from state)),
journal as (select 'diario' as block, url || '/' || turn as key, 5 as most, row_number() over (order by turn desc, url) as place from state),
radar as (select 'radar' as block, id::varchar as key, 10 as most, row_number() over (order by published desc, id) as place from judged),
due as (select 'vence' as block, id::varchar as key, 8 as most, row_number() over (order by deadline, id) as place from judged where deadline >= date '1998-06-01'),
attention as (select 'atencao' as block, id::varchar as key, 8 as most, row_number() over (order by score desc, id) as place from judged where final = 'indeterminada'),
tasks as (select 'tarefas' as block, url || '/' || turn as key, 12 as most, row_number() over (order by turn, url) as place from state where voice = 'humano'),
projects as (select 'projetos' as block, url || ' ' || count_if(voice = 'robo') || '/' || count(*) as key, 10 as most, row_number() over (order by max(turn) desc, url) as place from state group by url),
fresh_news as (select 'noticias' as block, doc_id::varchar as key, 10 as most, row_number() over (order by (doc_id * 7919 % 997)::int desc, doc_id) as place from documents),
pulse as (select 'pulso' as block, strftime(published, '%Y-%m') || ' ' || count(*) as key, 2 as most, row_number() over (order by strftime(published, '%Y-%m') desc) as place from judged where final != 'fora' group by strftime(published, '%Y-%m'))"""
BLOCKS = ("queue", "journal", "radar", "due", "attention", "tasks", "projects", "fresh_news", "pulse")


def blocks(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame, list]]:
    """(block, rows shown, rows with a key, order) of each block."""
    s, j = state(spark, sf_dir), written(judged(spark, sf_dir).select("id", "published", "deadline", "score", "final"), "judged")
    entry = s.withColumn("key", F.concat_ws("/", "url", "turn"))
    by_id = lambda d: d.withColumn("key", F.col("id").cast("string"))
    projects = s.groupBy("url").agg(F.max("turn").alias("last"), F.count_if(F.col("voice") == "robo").alias("done"), F.count("*").alias("total"))
    n = news(spark, sf_dir).select("id", (F.col("id") * 7919 % 997).cast("int").alias("score"))
    months = j.where("final != 'fora'").groupBy(F.date_format("published", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return [
        ("fila", 10, s.select("url").distinct().withColumn("key", F.col("url").cast("string")), [F.col("url") % 17, F.col("url")]),
        ("diario", 5, entry, [F.desc("turn"), F.col("url")]),
        ("radar", 10, by_id(j), [F.desc("published"), F.col("id")]),
        ("vence", 8, by_id(j.where("deadline >= date '1998-06-01'")), [F.col("deadline"), F.col("id")]),
        ("atencao", 8, by_id(j.where("final = 'indeterminada'")), [F.desc("score"), F.col("id")]),
        ("tarefas", 12, entry.where("voice = 'humano'"), [F.col("turn"), F.col("url")]),
        ("projetos", 10, projects.withColumn("key", F.concat_ws(" ", "url", F.concat_ws("/", "done", "total"))), [F.desc("last"), F.col("url")]),
        ("noticias", 10, by_id(n), [F.desc("score"), F.col("id")]),
        ("pulso", 2, months.withColumn("key", F.concat_ws(" ", "month", "n")), [F.desc("month")]),
    ]


@query(f"with {BOARD} " + " union all ".join(f"select block, key, place::int as place from {b} where place <= most" for b in BLOCKS[:7]))
def t08_newest_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next of the queue, newest of the journal and of the radar, what is due, what calls for attention, tasks and projects, each with its own limit."""
    return board_rows(blocks(spark, sf_dir)[:7])


def board_rows(found: list[tuple[str, int, DataFrame, list]]) -> DataFrame:
    out = None
    for block, most, rows, order in found:
        top = rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a top-k, so a few rows
        one = top.select(F.lit(block).alias("block"), "key", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {BOARD}, whole as ({' union all '.join(f'select * from {b}' for b in BLOCKS)}), n as (select block, count(*) as total, any_value(most) as most from whole group by block) select w.block, w.key, w.place::int as place, case when total > n.most then total - n.most end as beyond from whole w join n using (block) where w.place <= w.most")
def v05_today_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each block in one form, and how many more there are."""
    found = blocks(spark, sf_dir)
    totals = None
    for block, most, rows, _ in found:
        n = rows.agg(F.count("*").alias("total")).select(F.lit(block).alias("block"), F.when(F.col("total") > most, F.col("total") - most).alias("beyond"))
        totals = n if totals is None else totals.union(n)
    return board_rows(found).join(F.broadcast(totals), "block").select("block", "key", "place", "beyond")  # a row a block


# ---- umbrella notices


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): notices whose section of offers has an item for each line of an order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    area = F.concat(F.lit("Área "), F.col("k").cast("string"))
    item = F.when(F.col("k") % 2 == 1, F.concat(area, F.lit(" (CR) "), F.col("q"), F.lit(" vagas no Campus Centro de Minas agora;"))).otherwise(F.concat(area, F.lit(" ("), F.col("q"), F.lit(" vagas) manhã;")))
    rows = li.withColumn("item", item).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), " ").alias("all"))
    return rows.select("id", F.concat(F.lit("CONCURSO (edital); VAGAS OFERECIDAS no ano: "), F.col("all"), F.lit(" DATAS IMPORTANTES: prova (sim) hoje;")).alias("body"))


@query("select l_orderkey as id, 'Área ' || l_linenumber as code, case when l_linenumber % 2 = 1 then 'Centro de Minas' end as campus, l_quantity::int as vacancies from lineitem qualify count(*) over (partition by l_orderkey) >= 2")
def v09_offers_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the section of offers, each ended by a semicolon; at least two, else it's no umbrella."""
    at = F.instr("body", "VAGAS OFERECIDAS")
    section = offered(spark, sf_dir).where(at > 0).withColumn("from_mark", F.substring("body", at, F.length("body")))
    section = section.select("id", F.regexp_extract("from_mark", "(?s)^[^:]{0,300}:(.*?)(?:DATAS IMPORTANTES|DETALHES DOS CARGOS|\\z)", 1).alias("s"))
    found = F.regexp_extract_all("s", F.lit("([^;()]+?\\s*\\([^)]*\\)\\s*[^;]*);"), F.lit(1))
    rows = section.select("id", found.alias("items")).where("size(items) >= 2").select("id", F.explode("items").alias("x"))
    bracket, extra = F.regexp_extract("x", "\\(([^)]*)\\)", 1), F.regexp_extract("x", "\\)\\s*(.*)$", 1)
    count = F.regexp_extract(F.when(bracket.rlike("\\d"), bracket).otherwise(extra), "(\\d+)", 1).try_cast("int")
    campus = F.nullif(F.regexp_extract(extra, "Campus\\s+([A-ZÀ-Ý][\\wÀ-ÿ'.-]*(?:\\s+[a-zà-ÿ]{1,3}\\s+[A-ZÀ-Ý][\\wÀ-ÿ'.-]*)*)", 1), F.lit(""))
    return rows.select("id", F.trim(F.regexp_extract("x", "^([^;()]+?)\\s*\\(", 1)).alias("code"), campus.alias("campus"), count.alias("vacancies"))


@query("select l_orderkey as id, l_linenumber as place, case l_linenumber % 4 when 1 then 'Design' else 'Computação/IA' end as area, case l_linenumber % 4 when 1 then 'doutorado' when 2 then 'graduacao' end as degree from lineitem where l_linenumber % 4 in (1, 2)")
def v10_relevant_subnotices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area from the text before the required degree, the degree from the whole row."""
    k = (F.col("l_linenumber") % 4).cast("int")
    said = F.array(*map(F.lit, ("História. Título de Doutor em Design", "Design. Doutorado em Artes", "Computação; graduação aceita", "Letras")))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("place"), F.get(said, k).alias("body"))
    head = F.split("body", "T[íi]tulo\\s+de\\s+[Dd]outor|[Dd]outorado\\s+em", 2)[0]
    rows = li.withColumn("hits", term_hits(head)).where(F.size("hits") > 0)
    return rows.select("id", "place", main_area(F.col("hits")).alias("area"), extract.degree(F.col("body")).alias("degree"))


# ---- streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


@query(f"select event_id, user_id from events where ts is null or ts >= {LAST} - to_days((7 + user_id % 24)::int)")
def st02_late_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items older than their feed's limit are turned away in the stream; the watermark bounds what state would be kept."""
    limit = F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval((7 + F.col("user_id") % 24).cast("int"))
    e = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "31 days")
    return jobs.drained(e.where(F.col("at").isNull() | (F.col("at") >= limit)).select("event_id", "user_id"), "append")


@query("select user_id, event_type, min(ts) as first_seen from events group by 1, 2")
def st04_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first time of each item as value state of the stream."""
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    found = stateful.first_seen(event_stream(spark, sf_dir).select(key.alias("key"), F.col("ts").cast("timestamp").alias("at")))
    return found.select(F.split_part("key", F.lit("|"), F.lit(1)).cast("long").alias("user_id"), F.split_part("key", F.lit("|"), F.lit(2)).alias("event_type"), "first_seen")


LIMITS = "limits as (select distinct user_id, 1 + user_id % 3 as least from events)"


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a source: the least volume of a working day."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (1 + F.col("user_id") % 3).alias("least")).distinct()


@query(
    f"""with {LIMITS}, n as (select ts::date as day, user_id, count(*) as n from events group by 1, 2), span as (select unnest(generate_series(min(day), max(day), interval 1 day))::date as day from n),
v as (select d.day, l.user_id, l.least, coalesce(n.n, 0)::bigint as n from span d cross join limits l left join n on n.day = d.day and n.user_id = l.user_id)
select user_id, day, n, case when n = 0 then 'critico' else 'atencao' end as level from v where case when n = 0 then dayofweek(day) not in (0, 6) and not (month(day) = 1 and day(day) = 1) else n < least end"""
)
def st07_volume_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a source that call for attention, silent ones too, judged by the source's own limits as rows of their own."""
    own = limits(spark, sf_dir)

    def judge(volumes: DataFrame) -> DataFrame:
        return volumes.join(own, "user_id").withColumn("level", health_level(F.col("n"), F.col("day"), F.col("least"))).drop("least")

    return stateful.volume_monitor(event_stream(spark, sf_dir), "user_id", "ts", judge)[1]


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, some of them cut off and some with a text where a number belongs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id").cast("string")
    whole = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("points")))
    wrong = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.lit("many").alias("points")))
    line = F.when(F.col("user_id") % 13 == 0, F.concat(F.lit('{"event_id": '), k, F.lit(', "kind"'))).when(F.col("event_type") == "error", wrong).otherwise(whole)
    path = new_dir(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    return spark.readStream.schema("value string").text(path)


@query("""select event_id, case when user_id % 13 = 0 then 'json' else 'field' end as error from events where user_id % 13 = 0 or event_type = 'error'""")
def st08x_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that don't parse go to a table of errors with their text, inside the stream; the rest goes on."""
    _, errors = stateful.split_corrupt(line_stream(spark, sf_dir), "event_id long, kind string, points long")
    return errors.select(F.regexp_extract("value", '"event_id": ?([0-9]+)', 1).cast("long").alias("event_id"), "error")


@query("select o_custkey as source, case when o_custkey % 7 = 0 then 0 else count(*) end as n_items, case when o_custkey % 7 = 0 then 'payload' end as error from orders group by o_custkey")
def st08_isolated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source whose payload doesn't parse is recorded with its error; the others go on."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = o.groupBy(F.col("o_custkey").alias("source")).agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id")))).alias("body"))
    landed = body.select("source", F.when(F.col("source") % 7 == 0, F.lit('[{"id": 1')).otherwise(F.col("body")).alias("body"))
    read = landed.select("source", F.try_variant_get(F.try_parse_json("body"), "$", "array<struct<id:bigint>>").alias("items"))
    return read.select("source", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.when(F.col("items").isNull(), "payload").alias("error"))
