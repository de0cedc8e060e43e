"""Queries over news items: anchors, clusters, ranks, bands and term hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bands, clusters, replay
from ..operators import terms as index
from ..operators.bands import BAND_DAYS
from ..operators.storage import written
from ..registry import query
from .proxies import NEWS, NEWS_NOW, news
from .text_queries import ANCHORS


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).withColumn("anchors", text.anchors(F.col("title")))


BLOCKS = f"""{NEWS}, {ANCHORS},
exploded as (select id, tab, lang, domain, ts, unnest(anchors) as anchor from anchored),
blocks as (select tab, lang, count(distinct id) as block from exploded group by 1, 2),
cut as (select tab, lang, anchor, count(*) as n, block from exploded join blocks using (tab, lang) group by tab, lang, anchor, block having block >= 20 and n > 0.15 * block)"""
PAIRS = f"""{BLOCKS},
kept as (select * from exploded e where not exists (select 1 from cut c where c.tab = e.tab and c.lang = e.lang and c.anchor = e.anchor)),
sizes as (select id, count(*) as n from kept group by id),
met as (select a.id as a, b.id as b, a.domain = b.domain as inside, count(*) as common from kept a join kept b
  on a.tab = b.tab and a.lang = b.lang and a.anchor = b.anchor and a.id < b.id and abs(epoch(a.ts) - epoch(b.ts)) <= 36 * 3600 group by 1, 2, 3),
pairs as (select a, b, inside, common, common / (x.n + y.n - common) as jaccard from met join sizes x on a = x.id join sizes y on b = y.id
  where common >= 2 and common / (x.n + y.n - common) >= case when inside then 0.60 else 0.34 end)"""
CLUSTERS = f"""recursive {PAIRS},
links as (select a, b from pairs union select b, a from pairs),
reach as (select id, id as root from news union select l.b, r.root from reach r join links l on l.a = r.id),
assigned as (select id, min(root) as cluster from reach group by id)"""


@query(f"with {BLOCKS} select tab, lang, anchor, n from cut")
def a10_frequent_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = items(spark, sf_dir).select("id", "tab", "lang", F.explode("anchors").alias("anchor"))
    return clusters.frequent_anchors(exploded).select("tab", "lang", "anchor", "n")


@query(f"with {PAIRS} select a, b, common, round(jaccard, 6) as jaccard, inside from pairs")
def j06_anchor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.similar_pairs(items(spark, sf_dir)).select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"), "inside")


@query(f"with {CLUSTERS} select id, cluster from assigned")
def v14_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(items(spark, sf_dir))


@query()
def v14x_guarded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the ordered replay with the representative guard; no SQL states it, ``tests/test_replay.py`` does."""
    return replay.guarded_clusters(items(spark, sf_dir))


@query(
    f"""with {CLUSTERS}, parts as (select cluster, id // 10000 as part, sha256(string_agg(id::varchar, ',' order by id)) as digest from assigned group by 1, 2),
keys as (select cluster, substring(sha256(string_agg(digest, ',' order by part)), 1, 20) as cluster_key from parts group by cluster)
select cluster, count(*) as n_items, count(distinct domain) as n_domains, min(ts) as first_ts, max(ts) as last_ts, any_value(cluster_key) as cluster_key from assigned join news using (id) join keys using (cluster) group by cluster"""
)
def a11_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return clusters.summaries(i, clusters.clustered(i))


@query(f"with {PAIRS} select least(floor(jaccard / 0.05), 19)::int as bin, inside, count(*) as n from pairs group by 1, 2")
def a12_jaccard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = clusters.similar_pairs(items(spark, sf_dir))
    return p.groupBy(F.least(F.floor(F.col("jaccard") / 0.05), F.lit(19)).cast("int").alias("bin"), "inside").agg(F.count("*").alias("n"))


@query(f"with {CLUSTERS} select cluster, count(distinct domain) as n_domains from assigned join news using (id) group by cluster having count(distinct domain) >= 2 order by n_domains desc, cluster limit 20")
def a14_multi_publisher_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    s = clusters.summaries(i, clusters.clustered(i))
    return s.where("n_domains >= 2").orderBy(F.desc("n_domains"), "cluster").limit(20).select("cluster", "n_domains")


@query(f"with {NEWS} select tab, theme, count(*) as n from news group by cube (tab, theme)")
def a13_items_per_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).cube("tab", "theme").agg(F.count("*").alias("n"))


@query(f"with {NEWS}, r as (select *, row_number() over (partition by title order by case tab when 'ciencia' then 1 when 'ia' then 2 when 'trabalho' then 3 else 4 end, id) as n from news) select id, tab, n = 1 as kept from r")
def u03x_dedup_across_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal titles the one in the tab of highest precedence stays; the rest are the decisions to log."""
    precedence = F.when(F.col("tab") == "ciencia", 1).when(F.col("tab") == "ia", 2).when(F.col("tab") == "trabalho", 3).otherwise(4)
    n = news(spark, sf_dir).withColumn("order", F.struct(precedence, "id"))
    best = n.groupBy("title").agg(F.min("order").alias("best"))
    return n.join(best, "title").select("id", "tab", (F.col("order") == F.col("best")).alias("kept"))


@query(f"with {NEWS}, r as (select *, first_value(tab) over w as kept_tab, first_value(id) over w as kept_id, row_number() over w as n from news window w as (partition by title order by case tab when 'ciencia' then 1 when 'ia' then 2 when 'trabalho' then 3 else 4 end, id)) select id, tab, kept_id, kept_tab, case when tab = kept_tab then 'mesma aba' else 'precedência' end as decision from r where n > 1")
def u03x_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what lost: the row, the one that stayed, and whether a tab's precedence or the order inside it decided."""
    precedence = F.when(F.col("tab") == "ciencia", 1).when(F.col("tab") == "ia", 2).when(F.col("tab") == "trabalho", 3).otherwise(4)
    n = news(spark, sf_dir).select("id", "tab", "title", precedence.alias("rank"))
    best = n.groupBy("title").agg(F.min(F.struct("rank", "id", "tab")).alias("best"))
    lost = n.join(best, "title").where(F.col("id") != F.col("best.id"))
    decision = F.when(F.col("tab") == F.col("best.tab"), "mesma aba").otherwise("precedência")
    return lost.select("id", "tab", F.col("best.id").alias("kept_id"), F.col("best.tab").alias("kept_tab"), decision.alias("decision"))


@query(f"with {NEWS}, s as (select id, tab, ts, (id * 7919 % 101)::int as signal from news), b as (select *, (ts - interval 3 hour)::date as day from s) select id, tab, day, count(*) over (partition by day, tab) as batch, round(((rank() over (partition by day, tab order by signal) - 1) + 0.5 * count(*) over (partition by day, tab, signal)) / count(*) over (partition by day, tab) * 100, 6) as percentile from b")
def w02_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = news(spark, sf_dir).withColumn("signal", (F.col("id") * 7919 % 101).cast("int")).withColumn("day", F.to_date(F.col("ts") - F.expr("interval 3 hours")))
    return clusters.mid_rank_percentile(n, ["day", "tab"], "signal").select("id", "tab", "day", "batch", F.round("percentile", 6).alias("percentile"))


def _band_sql() -> str:
    """The cascade in SQL, one block of steps a band."""
    out = f"""{CLUSTERS}, scored as (select id, tab, theme, ts, domain || '/' || (id % 400) as link, cluster, (id * 7919 % 997)::int as score from news join assigned using (id)),
volumes as (select tab, theme, count(*) as volume, sum(count(*)) over (partition by tab) as tab_volume from scored group by tab, theme)"""
    picked = []
    for k, days in enumerate(BAND_DAYS):
        when = f"(ts - interval 3 hour)::date = (timestamp '{NEWS_NOW}' - interval 27 hour)::date" if not days else f"ts >= timestamp '{NEWS_NOW}' - interval 24 hour - interval {days} day"
        free = "".join(f" and (tab, cluster) not in (select (tab, cluster) from band{j}) and (tab, link) not in (select (tab, link) from band{j})" for j in range(k))
        out += f""", clusters{k} as materialized (select * from scored where {when}{free} qualify row_number() over (partition by tab, cluster order by score desc, ts desc, id) = 1),
links{k} as (select * from clusters{k} qualify row_number() over (partition by tab, link order by score desc, ts desc, id) = 1),
cand{k} as materialized (select *, row_number() over (partition by tab order by score desc, ts desc, id) as place, row_number() over (partition by tab, theme order by score desc, ts desc, id) as tp from links{k}),
themes{k} as (select tab, theme, count(*) as has, count_if(place <= 20) as taken, min(place) as first_place, any_value(volume) as volume, any_value(tab_volume) as tab_volume from cand{k} join volumes using (tab, theme) group by tab, theme),
floors{k} as (select *, least(greatest(1, floor(20 * volume / tab_volume + 0.5)), has)::int as f from themes{k}),
cuts{k} as (select tab, theme, count(*) as cut from (select tab, theme, row_number() over (partition by tab order by level desc, first_place) as n from (select *, unnest(range(2, f + 1)) as level from floors{k}))
  join (select tab, sum(f) - 20 as over from floors{k} group by tab) using (tab) where n <= over group by tab, theme),
needs{k} as (select *, greatest(0, f - taken) as needs, greatest(0, taken - f) as spare from (select * replace (f - coalesce(cut, 0) as f) from floors{k} left join cuts{k} using (tab, theme))),
swaps{k} as (select *, least(sum(needs) over (partition by tab), sum(spare) over (partition by tab)) as swaps, sum(needs) over (partition by tab order by first_place, theme) - needs as before from needs{k}),
going{k} as (select *, place <= 20 and row_number() over (partition by tab, theme, place <= 20 order by score, place) <= spare as can_go from cand{k} join swaps{k} using (tab, theme)),
gone{k} as (select *, can_go and row_number() over (partition by tab, can_go order by score, place) <= swaps as goes from going{k}),
band{k} as materialized (select id, tab, theme, link, cluster, row_number() over (partition by tab order by score desc, ts desc, id) as place from gone{k} where (place <= 20 and not goes) or (place > 20 and tp - taken <= needs and before + tp - taken <= swaps))"""
        picked.append(f"select id, tab, theme, {days} as band, place::int as place from band{k}")
    return f"with {out} " + " union all ".join(picked)


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with cluster, link and score."""
    i = items(spark, sf_dir)
    scored = i.select("id", "tab", "theme", F.concat_ws("/", "domain", (F.col("id") % 400).cast("string")).alias("link"), (F.col("id") * 7919 % 997).cast("int").alias("score"), "ts")
    return written(scored.join(clusters.clustered(i), "id"), "ranked-items")


def band_now() -> Column:
    return F.lit(NEWS_NOW).cast("timestamp") - F.expr("interval 24 hours")


@query(_band_sql())
def t06_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today, 7, 15 and 30 days: one row a cluster and a link, 20 a tab with floors for themes, without what an earlier band shows."""
    return bands.cascade(ranked_items(spark, sf_dir), band_now())


@query(f"with {CLUSTERS}, scored as (select id, tab, theme, ts, cluster, (id * 7919 % 997)::int as score from news join assigned using (id)) select id, tab, cluster from scored qualify row_number() over (partition by tab, cluster order by score desc, ts desc, id) = 1")
def w03_best_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.best("cluster", ranked_items(spark, sf_dir)).select("id", "tab", "cluster")


@query(
    f"""with {NEWS}, scored as (select id, tab, theme, ts, (id * 7919 % 997)::int as score from news),
volumes as (select tab, theme, count(*) as volume, sum(count(*)) over (partition by tab) as tab_volume from scored group by tab, theme),
ranked as (select *, row_number() over (partition by tab order by score desc, ts desc, id) as place, row_number() over (partition by tab, theme order by score desc, ts desc, id) as tp from scored),
themes as (select tab, theme, count(*) as has, count_if(place <= 20) as taken, min(place) as first_place from ranked group by tab, theme),
floors as (select *, least(greatest(1, floor(20 * volume / tab_volume + 0.5)), has)::int as f from themes join volumes using (tab, theme)),
cuts as (select tab, theme, count(*) as cut from (select tab, theme, row_number() over (partition by tab order by level desc, first_place) as n from (select *, unnest(range(2, f + 1)) as level from floors)) join (select tab, sum(f) - 20 as over from floors group by tab) using (tab) where n <= over group by tab, theme),
needs as (select *, greatest(0, f - taken) as needs, greatest(0, taken - f) as spare from (select * replace (f - coalesce(cut, 0) as f) from floors left join cuts using (tab, theme))),
swaps as (select *, least(sum(needs) over (partition by tab), sum(spare) over (partition by tab)) as swaps, sum(needs) over (partition by tab order by first_place, theme) - needs as before from needs),
gone as (select *, can_go and row_number() over (partition by tab, can_go order by score, place) <= swaps as goes from (select *, place <= 20 and row_number() over (partition by tab, theme, place <= 20 order by score, place) <= spare as can_go from ranked join swaps using (tab, theme)))
select id, tab, theme, (row_number() over (partition by tab order by score desc, ts desc, id))::int as place from gone where (place <= 20 and not goes) or (place > 20 and tp - taken <= needs and before + tp - taken <= swaps)"""
)
def t05_diversity_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each tab, with a floor for each theme."""
    n = news(spark, sf_dir).select("id", "tab", "theme", (F.col("id") * 7919 % 997).cast("int").alias("score"), "ts")
    return bands.with_floors(n, n.groupBy("tab", "theme").agg(F.count("*").alias("volume"))).select("id", "tab", "theme", "place")


TERMS = """spelt as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+') as w from benchmark),
named as (select item_id, unnest(w) as term from spelt
  union all select item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from spelt
  union all select item_id, unnest(list_transform(list_filter(w, lambda x: length(x) >= 9), lambda x: x[:7] || '*')) from spelt),
terms as (select term, min(item_id) as first_item, (length(term) % 7 + 1)::int as weight, 'area' || (length(term) % 5) as area from named where length(term) >= 6 group by term)"""
WORDS = """pieces as (select doc_id as id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9_]+|[^a-z0-9_]+') as p from documents),
words as (select distinct id, unnest(list_transform(range(1, len(p) + 1), lambda i: p[i])) as term from pieces
  union select id, unnest(list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2])) from pieces
  union select id, unnest(list_transform(list_filter(p, lambda x: length(x) >= 7), lambda x: x[:7] || '*')) from pieces)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted dictionary from the benchmark: its words, its pairs of words and beginnings of its long words."""
    spelt = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_extract_all(index.normalised(F.col("text")), F.lit("([a-z0-9_]+)"), F.lit(1)).alias("w"))
    pairs = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda x, k: F.concat(F.get("w", k), F.lit(" "), x))
    heads = F.transform(F.filter("w", lambda x: F.length(x) >= 9), lambda x: F.concat(F.substring(x, 1, 7), F.lit("*")))
    n = F.length("term")
    named = spelt.select("item_id", F.explode(F.concat("w", pairs, heads)).alias("term")).where("length(term) >= 6")
    return named.groupBy("term").agg(F.min("item_id").alias("first_item")).select("term", "first_item", (n % 7 + 1).cast("int").alias("weight"), F.concat(F.lit("area"), (n % 5).cast("string")).alias("area"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return index.term_hits(d, terms(spark, sf_dir))


@query(f"with {TERMS}, {WORDS} select id, term, weight from words join terms using (term)")
def j01_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("id", "term", "weight")


@query(f"with {TERMS}, {WORDS} select id, arg_max(area, weight * 1000000 - first_item * 100 - length(term)) as area, count(*) as n_hits from words join terms using (term) group by id")
def g04_principal_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of the heaviest hit, the first in the dictionary on a tie."""
    key = F.col("weight") * 1000000 - F.col("first_item") * 100 - F.length("term")
    return hits(spark, sf_dir).groupBy("id").agg(F.max_by("area", key).alias("area"), F.count("*").alias("n_hits"))


@query(f"with {TERMS}, {WORDS} select id, least(55, sum(weight))::bigint as adherence from words join terms using (term) group by id")
def g06_market_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("id").agg(F.least(F.lit(55), F.sum("weight")).alias("adherence"))


@query(f"with {TERMS}, {WORDS}, b as (select id, least(40, sum(weight / 5.0)) as bump from words join terms using (term) group by id) select doc_id as id, round(coalesce(bump, 0))::int as bump from documents left join b on b.id = doc_id")
def f38_profile_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = hits(spark, sf_dir).groupBy("id").agg(F.least(F.lit(40.0), F.sum(F.col("weight") / 5.0)).alias("bump"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id")).join(b, "id", "left").select("id", F.round(F.coalesce("bump", F.lit(0.0))).cast("int").alias("bump"))


@query(f"with {TERMS}, {WORDS}, v as (select distinct id from words join terms using (term) where area = 'area0') select doc_id as id from documents where doc_id not in (select id from v)")
def g05_negative_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    vetoed = hits(spark, sf_dir).where("area = 'area0'").select("id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id")).join(vetoed, "id", "left_anti")


@query(f"with {TERMS}, {WORDS}, f as (select distinct id, true as found from words join terms using (term)) select quality, count(*) as n, sum(coalesce(found, false)::int)::bigint as found from labels left join f on f.id = doc_id group by quality")
def a30_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hits(spark, sf_dir).select(F.col("id").alias("doc_id")).distinct().withColumn("found", F.lit(1))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").join(f, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("found").alias("found"))
