"""Queries of the text, URL and page functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text, urls
from ..registry import query
from .proxies import NEWS, news

STOP_SQL = "[" + ", ".join("'" + w + "'" for w in text.STOP_WORDS) + "]"
EDGE_SQL = "[^\\p{L}\\p{N}''’-]+"
TOKENS_SQL = f"list_filter(list_transform(regexp_split_to_array(title, '{EDGE_SQL}'), lambda t: regexp_replace(t, '^[''’-]+|[''’-]+$', '', 'g')), lambda t: t != '')"
NUMBERS_SQL = "list_filter(list_transform(regexp_extract_all(title, '[0-9]+(?:[.,][0-9]+)*[xX][0-9]+(?:[.,][0-9]+)*|[0-9][0-9.,]*'), lambda n: lower(replace(regexp_replace(n, '[.,]+$', ''), ',', '.'))), lambda n: not regexp_matches(n, '^[0-9]?$'))"
ANCHORS = f"""tokened as (select *, {TOKENS_SQL} as toks, {NUMBERS_SQL} as nums from news),
shouted as (select *, list_filter(toks, lambda t: regexp_matches(t, '\\p{{L}}') and length(t) >= 6) as long_toks from tokened),
regimes as (select *, coalesce(len(list_filter(long_toks, lambda t: t = upper(t) and t != lower(t))) / nullif(len(long_toks), 0) > 0.6, false) as shouting from shouted),
anchored as (select *, list_distinct(list_concat(list_filter(case when shouting
    then list_filter(list_transform(list_filter(toks, lambda t: regexp_matches(t, '\\p{{L}}')), lambda t: lower(strip_accents(t))), lambda t: length(t) >= 4)
    else list_filter(list_transform(list_filter(toks, lambda t: regexp_matches(t, '^\\p{{Lu}}')), lambda t: lower(strip_accents(t))), lambda t: length(t) >= 2) end,
  lambda t: not list_contains({STOP_SQL}, t)), nums)) as anchors from regimes)"""


@query(f"with {NEWS} select id, lower(strip_accents(title)) as plain, lower(trim(coalesce(domain, ''))) as domain_key from news")
def f04_strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("id", F.lower(text.strip_accents(F.col("title"))).alias("plain"), text.normalise_key(F.col("domain")).alias("domain_key"))


@query(f"with {NEWS} select id, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}},.]+', ' ', 'g'), ' +', ' ', 'g')) as title_key from news")
def f05_normalise_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("id", text.normalise_title(F.col("title")).alias("title_key"))


@query("select s_suppkey, regexp_replace(trim(regexp_replace(lower(strip_accents(s_name)), '[^a-z0-9]+', ' ', 'g')), '^fundacao ', '') as institution from supplier")
def f06_institution_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", text.institution_key(F.col("s_name")).alias("institution"))


@query(f"with {NEWS} select id, len({TOKENS_SQL})::int as n_tokens, array_to_string({TOKENS_SQL}, '|') as tokens from news")
def f07_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("title"))
    return news(spark, sf_dir).select("id", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


@query(f"with {NEWS}, {ANCHORS} select id, shouting, case when shouting then 'conteudo' else 'maiuscula' end as regime from regimes")
def f08_shouting_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = text.is_shouting(F.col("title"))
    return news(spark, sf_dir).select("id", loud.alias("shouting"), F.when(loud, "conteudo").otherwise("maiuscula").alias("regime"))


@query("""with news as (select doc_id as id, text as title from documents) select id, array_to_string(""" + NUMBERS_SQL + """, '|') as numbers from news""")
def f09_number_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.array_join(text.numbers(F.col("text")), "|").alias("numbers"))


@query(f"with {NEWS}, {ANCHORS} select id, array_to_string(list_sort(anchors), '|') as anchors, len(anchors)::int as n_anchors from anchored")
def f10_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = text.anchors(F.col("title"))
    return news(spark, sf_dir).select("id", a.alias("a")).select("id", F.array_join(F.sort_array("a"), "|").alias("anchors"), F.size("a").alias("n_anchors"))


LINK_SQL = """linked as (
  select page_id, trim(url) as raw, regexp_replace(trim(url), '#.*$', '') as bare from pages),
parts as (
  select page_id, raw, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.', '') as host,
    coalesce(nullif(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), ''), '/') as path,
    array_to_string(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p != '' and not regexp_matches(p, '(?i)^(utm_[^=]*|cmp|ref|fbclid|gclid|src|source)(=|$)')), '&') as params
  from linked),
links as (
  select page_id, case when host = '' then nullif(raw, '') when path != '/' then regexp_replace(scheme || '://' || host || path || case when params != '' then '?' || params else '' end, '/$', '')
    else scheme || '://' || host || path || case when params != '' then '?' || params else '' end end as link from parts)"""


@query(f"with {LINK_SQL} select page_id, link from links")
def f13_canonical_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.canonical_link(F.col("url")).alias("link"))


@query(
    f"""with hosts as (select page_id, regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') as host from pages),
cut as (select page_id, host, string_split(host, '.') as p from hosts),
two as (select page_id, host, p, case when len(p) <= 2 then host else p[-2] || '.' || p[-1] end as d from cut)
select page_id, case when d in {urls.TWO_LEVEL} and len(p) > 2 then p[-3] || '.' || d else d end as domain from two where host != ''"""
)
def f14_registered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.registered_domain(F.col("url")).alias("domain")).where("domain is not null")


def _decoded(c: str) -> str:
    for name, letter in (text.ENTITIES | text.PAGE_ENTITIES | {"&amp;": "&"}).items():
        quoted = letter.replace("'", "''")
        c = f"replace({c}, '{name}', '{quoted}')"
    return c


@query("select o_orderkey as id, 'a' || chr((o_orderkey % 500 + 200)::int) || chr((o_orderkey % 300 + 128512)::int) || ' < \u201cx\u201d &lt; && ' || chr((o_orderkey % 90 + 33)::int) || '.&#;&#z1;' as plain from orders")
def f15_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named, decimal and hexadecimal references, beyond the basic plane too; numbers outside Unicode vanish."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("a&#"), (k % 500 + 200).cast("string"), F.lit(";&#x"), F.hex(k % 300 + 128512), F.lit("; &LT; &#8220;x&#8221; &amp;lt; &amp;& &#"), (k % 90 + 33).cast("string"), F.lit(";&#0;&#1114112;&#x110000;.&#;&#z1;"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), text.decode_entities(said).alias("plain"))


@query(f"""select page_id, trim(regexp_replace({_decoded("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) as plain from pages""")
def f16_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of whole pages, with the further names that pages use."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_tags(F.col("html"), text.PAGE_ENTITIES).alias("plain"))


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as body from pages""")
def s05_article_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_extract("html", "(?s)<article[^>]*>(.*?)</article>", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), "\\s+", " ")).alias("body"))


@query(
    """with blocks as (select page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) as block, generate_subscripts(regexp_extract_all(html, '(?s)<li>.*?</li>'), 1) - 1 as place from pages),
cards as (select page_id, place, regexp_extract(block, 'href="([^"]*)"', 1) as link, regexp_extract(block, '>([^<]*)</a>', 1) as label from blocks),
firsts as (select *, row_number() over (partition by page_id, link order by place) as n from cards)
select page_id, place::int as place, link, label from firsts where n = 1"""
)
def s10_listing_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated blocks of a page as rows, the first of each link."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    blocks = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)(<li>.*?</li>)"), F.lit(1))).alias("place", "block"))
    cards = blocks.select("page_id", "place", F.regexp_extract("block", 'href="([^"]*)"', 1).alias("link"), F.regexp_extract("block", ">([^<]*)</a>", 1).alias("label"))
    return cards.groupBy("page_id", "link").agg(F.min("place").alias("place"), F.min_by("label", "place").alias("label")).select("page_id", "place", "link", "label")


@query(f"with {NEWS} select id, case when length(title) > 40 then substring(title, 1, 39) || '…' else title end as shown from news")
def p16_truncated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news(spark, sf_dir).select("id", text.truncated(F.col("title"), 40).alias("shown"))


@query("""select page_id, regexp_replace(regexp_replace(trim(lower(strip_accents(regexp_extract(html, '<title>([^<]*)</title>', 1)))), '[^a-z0-9\\s-]+', '', 'g'), '\\s+', '-', 'g') as slug from pages""")
def f29_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query(
    """with t as (select doc_id as id, text, instr(lower(text), 'license') as spot, length(text) as n from documents)
select id, case when n <= 400 then text when spot > 0 then substring(text, greatest(1, spot - 100), spot - greatest(1, spot - 100) + 200) else substring(text, 1, 400) end as part from t"""
)
def f45_keyword_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), text.keyword_window(F.col("text"), "license", 100, 200, 400).alias("part"))


JOB_TEXT = "concat_ws(' ', 'Professor', case o_orderkey % 4 when 0 then 'substituto, mestrado' when 1 then 'efetivo, doutorado em' when 2 then 'especialização; bolsista' else 'projeto' end, case when o_orderkey % 3 = 0 then 'Sênior' when o_orderkey % 3 = 1 then 'Analista Pleno' else 'Lead' end)"


@query(
    f"""with t as (select o_orderkey as id, {JOB_TEXT} as body from orders)
select id, case when contains(body, 'doutorado') then 'doutorado' when contains(body, 'mestrado') then 'mestrado' when contains(body, 'especialização') then 'especializacao' end as degree,
  case when contains(body, 'substituto') then 'substituto' when contains(body, 'bolsista') then 'posdoc_bolsa' when contains(body, 'efetivo') then 'efetivo' end as kind,
  case when contains(body, 'Lead') then 'lead' when contains(body, 'Sênior') then 'senior' when contains(body, 'Pleno') then 'pleno' end as level from t"""
)
def f21_posting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree, kind and seniority by ordered rules."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.expr(JOB_TEXT).alias("body"))
    return t.select("id", extract.degree(F.col("body")).alias("degree"), extract.kind(F.col("body")).alias("kind"), extract.seniority(F.col("body")).alias("level"))


@query("""select event_id, (props::json->>'k')::int as k, (ts - interval 3 hour)::date as batch_day, event_type from events""")
def f19_batch_day_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON payload, and the civil day at a fixed UTC-3."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", k.alias("k"), F.to_date(F.col("ts") - F.expr("interval 3 hours")).alias("batch_day"), "event_type")
