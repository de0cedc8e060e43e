"""Queries that give whole records: closed schemas, derived blocks, identity, and the rows that a stage turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, scoring, text, urls
from ..operators.storage import written
from ..registry import query
from ..sources import feeds
from .news_queries import ANCHORS, items
from .notice_queries import IS_CONTEST, IS_POST, NOTICES, VACANCIES, notices, pipeline_rows
from .posting_queries import MARKET_SQL, SCORED, TIER_SQL, judged, market, tiers
from .proxies import NEWS, NOW
from .source_queries import feed_payloads
from .state_queries import STATE, state

#: The closed schema of postings: column, type, default.
POSTING = {c: ("string", None) for c in "fonte trilha orgao campus uf area subarea subedital titulacao_exigida regime classe tipo modalidade senioridade tipo_contrato faixa_salarial url texto_bruto extracao veredito area_compativel julgamento".split()}
POSTING |= {"id": ("long", None), "vagas": ("int", None), "score": ("int", None), "inscricao_inicio": ("date", None), "inscricao_fim": ("date", None), "data_publicacao": ("date", None), "coletado_em": ("timestamp", None), "julgado_em": ("timestamp", None), "notificado_em": ("timestamp", None), "notificado": ("boolean", False), "stack": ("array<string>", []), "keywords_matched": ("array<string>", []), "campos_llm": ("array<string>", [])}


def conformed(rows: DataFrame) -> DataFrame:
    """Any columns to the closed schema: unknown ones go, missing ones take their default, a missing track is ``docente``."""

    def column(name: str, kind: str, default: object) -> Column:
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        fill = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        return F.coalesce(value, F.lit("docente")) if name == "trilha" else F.coalesce(value, fill) if default is not None else value

    return rows.select(*(column(c, *spec).alias(c) for c, spec in POSTING.items()))


@query(f"with {NOTICES} select id, (['Universidade Federal', 'Instituto Federal', 'Prefeitura Municipal', 'Empresa Privada'])[inst + 1] as orgao, {VACANCIES} as vagas, case when id % 2 = 0 then 'mercado' else 'docente' end as trilha, false as notificado, 0 as n_stack, {len(POSTING)} as n_columns from n")
def p01_closed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of unlike columns in the closed schema of postings."""
    n = notices(spark, sf_dir)
    one = n.where("id % 2 = 1").select("id", F.col("org").alias("orgao"), extract.vacancies(F.col("text")).alias("vagas"), F.lit(1).alias("unknown"))
    two = n.where("id % 2 = 0").select("id", F.col("org").alias("orgao"), extract.vacancies(F.col("text")).cast("string").alias("vagas"), F.lit("mercado").alias("trilha"))
    both = conformed(one).unionByName(conformed(two))
    return both.select("id", "orgao", "vagas", "trilha", "notificado", F.size("stack").alias("n_stack"), F.lit(len(both.columns)).alias("n_columns"))


#: The published fact table: column and whether it is a number.
FACT = {"id": True, "org": False, "uf": False, "track": False, "area": False, "degree": False, "published": False, "deadline": False, "price": True, "score": True, "final": False}


@query(f"with {SCORED} select id, coalesce(org, '') as org, coalesce(uf, '') as uf, coalesce(track, '') as track, coalesce(area, '') as area, coalesce(degree, '') as degree, coalesce(published::varchar, '') as published, coalesce(deadline::varchar, '') as deadline, price, score, coalesce(final, '') as final from judged")
def k02_fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table replaced as a whole: columns in order, empty text for null, numbers stay numbers."""
    j = judged(spark, sf_dir)
    return written(j.select(*(F.col(c) if number else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, number in FACT.items())), "fact-table")


@query(f"with {NEWS} select id, title, domain as publisher, case when id % 4 = 0 then null else (id % 100) / 7.0 end as signal, case when id % 6 = 0 then null else ts end as seen from news")
def p12_news_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that aren't finite become null."""
    i = items(spark, sf_dir)
    raw = F.when(F.col("id") % 4 == 0, F.when(F.col("id") % 8 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise((F.col("id") % 100) / F.lit(7.0))
    finite = F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw)
    return i.select("id", "title", F.col("domain").alias("publisher"), finite.alias("signal"), F.when(F.col("id") % 6 != 0, F.col("ts")).alias("seen"))


@query(f"with {NEWS}, {ANCHORS} select id, 'https://site.example/n/' || id as link, substring(sha256('https://site.example/n/' || id || '|' || lower(trim(title))), 1, 20) as key, len(anchors)::int as n_anchors from anchored")
def p13_identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical link, id of link and title, anchors."""
    landed = items(spark, sf_dir).withColumn("url", F.concat(F.lit("https://www.site.example/n/"), F.col("id").cast("string"), F.lit("/?utm_source=x&fbclid=1#top")))
    link = urls.canonical_link(F.col("url"))
    return landed.select("id", link.alias("link"), F.substring(F.sha2(F.concat_ws("|", link, text.normalise_key(F.col("title"))), 256), 1, 20).alias("key"), F.size("anchors").alias("n_anchors"))


NOW_SQL = f"date '{NOW}'"


@query(
    f"""with {SCORED}, {TIER_SQL} select id, tier, coalesce(days_left, 999)::int as subkey, tier * 100000 + least(coalesce(days_left, 999), 999) * 100 + (100 - score) as order_key,
  case when deadline is null then 'sem prazo' when deadline >= {NOW_SQL} then 'aberto' else 'encerrado' end as status,
  case final when 'elegivel_agora' then 'pode prestar' when 'indeterminada' then 'confirmar titulação' else 'só com doutorado' end as eligibility,
  case when deadline is null then 'publicado há ' || ({NOW_SQL} - published) || ' d' when deadline < {NOW_SQL} then 'encerrou ' || strftime(deadline, '%d/%m/%y') when deadline = {NOW_SQL} then 'fecha hoje' else 'fecha em ' || (deadline - {NOW_SQL}) || ' d' end as closing,
  case area when 'Design' then 'Design' when 'UX/IHC' then 'UX/IHC' when 'Computação/IA' then 'Computação/IA' when 'Educação/Ensino' then 'Outra' else 'não identificada' end as bucket from tiers"""
)
def p14_contest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived columns of a teaching post: tier, order, status, eligibility, closing and area labels."""
    now, d = F.lit(NOW).cast("date"), F.col("deadline")
    days = lambda a, b: F.datediff(a, b).cast("string")
    closing = F.when(d.isNull(), F.concat(F.lit("publicado há "), days(now, "published"), F.lit(" d"))).when(d < now, F.concat(F.lit("encerrou "), F.date_format(d, "dd/MM/yy"))).when(d == now, "fecha hoje").otherwise(F.concat(F.lit("fecha em "), days(d, now), F.lit(" d")))
    subkey = F.coalesce("days_left", F.lit(999))
    return tiers(spark, sf_dir).select(
        "id",
        "tier",
        subkey.cast("int").alias("subkey"),
        (F.col("tier") * 100000 + F.least(subkey, F.lit(999)) * 100 + (100 - F.col("score"))).alias("order_key"),
        F.when(d.isNull(), "sem prazo").when(d >= now, "aberto").otherwise("encerrado").alias("status"),
        F.when(F.col("final") == "elegivel_agora", "pode prestar").when(F.col("final") == "indeterminada", "confirmar titulação").otherwise("só com doutorado").alias("eligibility"),
        closing.alias("closing"),
        extract.area_bucket(F.col("area")).alias("bucket"),
    )


@query(f"with {SCORED}, {MARKET_SQL} select id, bucket, match, case bucket when 1 then 'hoje' when 2 then 'esta semana' when 3 then 'este mês' when 4 then 'até 90 dias' else 'mais antiga' end as label, case when score is null then '—' else score || '/85' end as shown_score, case when length(org) > 15 then substring(org, 1, 14) || '…' else org end as company from buckets")
def p15_market_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived columns of a market offer: bucket, match and their labels, a short company name."""
    labels = F.array(*map(F.lit, ("hoje", "esta semana", "este mês", "até 90 dias", "mais antiga")))
    return market(spark, sf_dir).select("id", "bucket", "match", F.get(labels, F.col("bucket") - 1).alias("label"), F.coalesce(F.concat(F.col("score").cast("string"), F.lit("/85")), F.lit("—")).alias("shown_score"), text.truncated(F.col("org"), 15).alias("company"))


@query(f"with {NOTICES}, s as (select id, {IS_CONTEST} as contest, ({IS_CONTEST}) and {IS_POST} as post from n) select id, case when not contest then 'contest' else 'post' end as stage, case when not contest then 'não é concurso' else 'não é vaga docente' end as reason from s where not post")
def a08_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notice that a gate turned away, with the stage and the reason."""
    p = pipeline_rows(spark, sf_dir).where("not post")
    return p.select("id", F.when(~F.col("contest"), "contest").otherwise("post").alias("stage"), F.when(~F.col("contest"), "não é concurso").otherwise("não é vaga docente").alias("reason"))


@query("select doc_id // 100 as feed, count(*) as volume, count_if(trim(split_part(text, chr(10), 1)) = '')::bigint as dropped, (count_if(trim(split_part(text, chr(10), 1)) != '') - count(distinct nullif(trim(split_part(text, chr(10), 1)), '')))::bigint as repeated from documents group by 1")
def s13_feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each feed: items in the payload, items without a title or link, and titles that repeat."""
    payloads = written(feed_payloads(spark, sf_dir, atom=False), "payloads")
    volume = payloads.select("feed", F.regexp_count("body", F.lit("<item[\\s>]")).cast("long").alias("volume"))
    kept = feeds.parse_feed(payloads).groupBy("feed").agg(F.count("*").alias("kept"), F.countDistinct("title").alias("titles"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return volume.join(kept, "feed", "left").select("feed", "volume", (F.col("volume") - n("kept")).alias("dropped"), (n("kept") - n("titles")).alias("repeated"))


@query("select o_orderkey as id, 'r/' || (['design', 'ux', 'ia'])[o_orderkey % 3 + 1] as publisher, 'hn:' || o_orderkey % 1000 as guid from orders qualify row_number() over (partition by o_orderkey % 1000 order by o_orderkey) = 1")
def s14_unique_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits unique by guid, the first wins; the publisher is the community's label."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    labels = F.array(*map(F.lit, ("design", "ux", "ia")))
    rows = o.select("id", F.concat(F.lit("r/"), F.get(labels, (F.col("id") % 3).cast("int"))).alias("publisher"), F.concat(F.lit("hn:"), (F.col("id") % 1000).cast("string")).alias("guid"))
    return feeds.first_per_key(rows.withColumn("arrival", F.col("id")), ["guid"], "arrival").select("id", "publisher", "guid")


@query("select o_orderkey as id, l_linenumber as place, l_partkey || '/24.' || lpad(l_linenumber::varchar, 2, '0') as code from orders join lineitem on l_orderkey = o_orderkey qualify count(*) over (partition by o_orderkey) >= 2")
def v08_umbrella_until_second_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the first table only: the text ends at "Quadro II"."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.concat(F.col("l_partkey").cast("string"), F.lit("/24."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    body = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("Quadro I\n"), F.array_join(F.collect_list(F.concat(code, F.lit(" Depto 1 vaga"))), "\n"), F.lit("\nQUADRO II\n999/24.99 Depto 1 vaga")).alias("body"))
    first = F.split("body", "(?i)quadro\\s+ii(?![a-z0-9_])", 2)[0]
    rows = body.select("id", F.regexp_extract_all(first, F.lit("([0-9]+/[0-9]{2}\\.[0-9]{2})"), F.lit(1)).alias("codes")).where("size(codes) >= 2")
    return rows.select("id", F.explode("codes").alias("code")).select("id", F.substring_index("code", ".", -1).cast("int").alias("place"), "code")


@query(f"with {STATE} select url, turn % 2 = 0 as flag, turn from (select *, row_number() over (partition by url order by turn desc) as n from state where url % 5 != 0) where n = 1")
def u10_parsed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as TRUE texts or booleans, rows without an address dropped, the last row of each address."""
    s = state(spark, sf_dir)
    said = F.when(F.col("turn") % 2 == 0, F.when(F.col("turn") % 4 == 0, " true ").otherwise("TRUE")).otherwise(F.when(F.col("turn") % 3 == 0, "FALSE"))
    rows = s.select(F.when(F.col("url") % 5 != 0, F.col("url").cast("string")).otherwise("  ").alias("address"), "turn", said.alias("said")).where(F.trim("address") != "")
    last = rows.groupBy("address").agg(F.max(F.struct("turn", "said")).alias("x"))
    return last.select(F.col("address").cast("long").alias("url"), F.coalesce(F.upper(F.trim("x.said")) == "TRUE", F.lit(False)).alias("flag"), "x.turn")


@query(f"with {SCORED}, q as (select *, row_number() over (order by score desc, id) as place from judged where final != 'fora') select 'item' as kind, id, place::int as place from q where place <= 15 union all select 'overflow', null, (count(*) - 15)::int from q having count(*) > 15")
def t04_queue_with_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 15 of the queue and, where more are pending, one notice of how many stay."""
    q = written(judged(spark, sf_dir).where("final != 'fora'").select("id", "score"), "pending")
    top = q.orderBy(F.desc("score"), "id").limit(15)
    sent = top.select(F.lit("item").alias("kind"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("place"))  # 15 rows
    more = q.agg((F.count("*") - 15).cast("int").alias("place")).where("place > 0")
    return sent.unionByName(more.select(F.lit("overflow").alias("kind"), F.lit(None).cast("long").alias("id"), "place"))


@query(f"with {NEWS} select id, case when date '2024-01-30' - min(ts) over ()::date < 7 then 'desde ' || strftime(min(ts) over (), '%d/%m') else '7 dias' end as window_label from news")
def f43_window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's label by the store's real age."""
    i = items(spark, sf_dir).select("id", "ts")
    first = i.agg(F.min("ts").alias("m"))
    label = F.when(F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("m")) < 7, F.concat(F.lit("desde "), F.date_format("m", "dd/MM"))).otherwise("7 dias")
    return i.join(F.broadcast(first)).select("id", label.alias("window_label"))  # one row


@query(f"with {SCORED}, a as (select distinct id, final, area, degree, uf from judged where track = 'docente') select final, uf, count(*) as n, count_if(area is not null)::bigint as with_area from a group by final, uf")
def a06_verdicts_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).where("track = 'docente'")
    return j.groupBy("final", "uf").agg(F.count("*").alias("n"), F.count("area").alias("with_area"))


@query(f"with {SCORED} select id, least(30, recency)::int as recency, least(55, weight)::int as adherence, case when weight = 0 then 0 else least(55, weight) + recency end::int as score from judged where track = 'mercado'")
def f35_market_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = judged(spark, sf_dir).where("track = 'mercado'")
    return m.select("id", F.least(F.lit(30), F.col("recency")).cast("int").alias("recency"), F.least(F.lit(55), F.col("weight")).cast("int").alias("adherence"), scoring.market_score(F.col("weight"), F.col("recency")).cast("int").alias("score"))
