"""Queries that parse landed payloads of the posting sources and project them to the common record.

Payloads have the sources' shapes; Spark builds them from the driver's tables, so the SQL states the rows that must come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, gates, text
from ..operators.storage import new_dir
from ..registry import query
from ..sources import boards, feeds
from .notice_queries import IS_CONTEST, NOTICES, VACANCIES, notices


def of(key: Column, *words: str | None) -> Column:
    return F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))


def joined(rows: DataFrame, key: str, order: str, item: str, sep: str = "") -> DataFrame:
    """(key, body): the items of each key in order, one text.  A key is one landed page."""
    listed = F.sort_array(F.collect_list(F.struct(order, item)))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[item]), sep).alias("body"))


# ---- the gazette


def gazette_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, body): an HTML page whose script holds a JSON array of the customer's notices."""
    n = notices(spark, sf_dir)
    path = F.slice(F.array(F.lit("Ministério"), F.concat(F.lit("Universidade "), (F.col("id") % 9).cast("string")), F.lit("Reitoria"), F.lit("Campus Norte")), F.lit(1), (F.col("id") % 5).cast("int"))
    date = F.when(F.col("id") % 10 == 0, "sem data").otherwise(F.date_format("d", "dd/MM/yyyy"))
    item = F.struct(F.concat(F.lit("edital-"), F.col("id").cast("string")).alias("urlTitle"), F.col("art_type").alias("artType"), date.alias("pubDate"), F.lit("EDITAL").alias("title"), F.col("text").alias("content"), F.array_join(path, "/").alias("hierarchyStr"), path.alias("hierarchyList"))
    pages = n.withColumn("item", F.to_json(item))
    found = joined(pages, "page", "id", "item", ",")
    return found.select("page", F.concat(F.lit('<html><script id="params" type="application/json">{"jsonArray":['), F.col("body"), F.lit("]}</script></html>")).alias("body"))


@query(f"with {NOTICES}, v as (select page, count(*) as volume from n group by page) select page, volume, 'edital-' || id as name from n join v using (page) where {IS_CONTEST}")
def s04_gazette_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array in the page's script; the volume is counted before the gate."""
    items = boards.gazette_items(gazette_pages(spark, sf_dir))
    blob = F.concat_ws(" \n ", *(F.nullif(c, F.lit("")) for c in ("title", "content", "hierarchyStr")))
    return items.where(gates.is_contest(F.col("artType"), blob)).select("page", "volume", F.col("urlTitle").alias("name"))


@query(
    f"""with {NOTICES}, p as (select *, (['Ministério', 'Universidade ' || id % 9, 'Reitoria', 'Campus Norte'])[1:id % 5] as path from n)
select 'https://www.in.gov.br/web/dou/-/edital-' || id as url, case when len(path) > 1 then path[2] else path[1] end as org, case when len(path) > 2 then path[-1] end as campus, case when id % 10 != 0 then d end as published from p"""
)
def p02_gazette_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level is the body (the first if alone), the last of more than two is the campus."""
    return boards.gazette_records(boards.gazette_items(gazette_pages(spark, sf_dir))).select("url", "org", "campus", "published")


@query(f"with {NOTICES} select id, case when id % 3 = 0 then 'artigo' else 'preview' end as origin, {VACANCIES} as vacancies, case place when 1 then 'SP' when 2 then 'SP' when 3 then 'GO' end as uf from n")
def p10_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text where there is one, else the preview; fields from whichever it is."""
    n = notices(spark, sf_dir)
    article = F.concat(F.lit('<div class="texto-dou">\n<html>\n<head></head>\n<body><p>'), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("</p>\n</body></html></div>"))
    articles = n.where("id % 3 = 0").select("id", boards.article_text(article).alias("full"))
    t = n.join(articles, "id", "left").withColumn("body", F.coalesce("full", "text"))
    return t.select("id", F.when(F.col("full").isNotNull(), "artigo").otherwise("preview").alias("origin"), extract.vacancies(F.col("body")).alias("vacancies"), extract.state_in_text(F.col("body")).alias("uf"))


# ---- blogs, listings and APIs


def blog_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, body): WordPress RSS; two posts with neighbouring numbers may share a link, some have no link."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("feed"), F.col("o_orderkey").alias("id"), "o_orderdate")
    s = lambda c: c.cast("string")
    link = F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("https://blog.example/"), s(F.col("id") - F.col("id") % 2)))
    body = F.when(F.col("id") % 3 == 0, "<p>Vagas abertas.</p>").otherwise(F.concat(F.lit("<p>A Universidade Federal de Letra  "), s(F.col("id") % 7), F.lit(" (UFL) abre 3 vagas; inscrições até 09/10/2026.</p>")))
    cats = F.concat(F.lit("<category><![CDATA[Concursos]]></category>"), F.when(F.col("id") % 2 == 0, "<category><![CDATA[Professor & cia]]></category>").otherwise(""))
    item = F.concat(F.lit("<item><title><![CDATA[Post <"), s(F.col("id")), F.lit(">]]></title><link>"), link, F.lit("</link><pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"), cats, F.lit("<content:encoded><![CDATA["), body, F.lit("]]></content:encoded></item>"))
    found = joined(o.withColumn("item", item), "feed", "id", "item")
    return found.select("feed", F.concat(F.lit("<rss><channel>"), F.col("body"), F.lit("</channel></rss>")).alias("body"))


POSTS = """posts as (select *, row_number() over (partition by link order by feed, id) as n from (
  select o_custkey as feed, o_orderkey as id, o_orderdate::date as d, 'https://blog.example/' || (o_orderkey - o_orderkey % 2) as link from orders where o_orderkey % 11 != 0))"""


@query(f"with {POSTS} select feed, 'Post <' || id || '>' as title, link, case when id % 2 = 0 then 2 else 1 end as n_categories from posts where n = 1")
def s09_blog_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDATA titles, categories as an array, first per link."""
    posts = feeds.first_per_key(boards.blog_posts(blog_feeds(spark, sf_dir)), ["link"], "arrival")
    return posts.select("feed", "title", "link", F.size("categories").alias("n_categories"))


@query(f"with {POSTS} select link, case when id % 3 = 0 then 'Post <' || id || '>' else 'UFL - Universidade Federal de Letra ' || id % 7 end as org, d as published, case when id % 3 != 0 then date '2026-10-09' end as last_day, case when id % 3 != 0 then 3 end as vacancies from posts where n = 1")
def p06_blog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = feeds.first_per_key(boards.blog_posts(blog_feeds(spark, sf_dir)), ["link"], "arrival")
    return boards.blog_records(posts).select("link", "org", "published", "last_day", "vacancies")


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, body): listings of a developers' board."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"))
    place = of(F.col("id"), "Remoto", "Recife/PE (Híbrido)", "São Paulo/SP", "Curitiba (Presencial)", "")
    s = F.col("id").cast("string")
    item = F.concat(F.lit('<a href="/jobs/'), s, F.lit("-dev-python\"><h3 class='t'>Dev &amp; Data "), s, F.lit("</h3><i class='fa fa-briefcase'></i> Empresa "), (F.col("id") % 3).cast("string"), F.lit(" <i class='fa fa-map-marker-alt'></i>"), place, F.lit("</a>"), F.when(F.col("id") % 13 == 0, F.repeat(F.lit("x"), 5000)).otherwise(""), F.lit("<h3>late</h3>"))
    return joined(o.withColumn("item", item), "page", "id", "item")


@query("select o_custkey as page, o_orderkey::varchar as id, 'Dev & Data ' || o_orderkey as title, 'Empresa ' || o_orderkey % 3 as company from orders")
def s11_board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards reach from one link to the next, at most 4,000 characters."""
    return boards.board_cards(board_pages(spark, sf_dir)).select("page", "id", "title", "company")


@query(
    """select o_orderkey::varchar as id, (['Recife', 'São Paulo', 'Curitiba'])[o_orderkey % 5] as campus, (['PE', 'SP'])[o_orderkey % 5] as uf,
  case o_orderkey % 5 when 0 then 'remoto' when 1 then 'hibrido' when 3 then 'presencial' end as modality from orders"""
)
def p08_board_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.board_records(boards.board_cards(board_pages(spark, sf_dir))).select("id", "campus", "uf", "modality")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, html): a broken block, one of another type and, for most, a JobPosting with raw line ends in a text."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    place = of(F.col("id"), "Recife/PE", "Campinas, São Paulo", "Lisboa")
    posting = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.lit("Dev").alias("title"), F.lit("<p><strong>Habilidades</strong> <br> Java, Go</p>@@fim").alias("description"), F.struct(F.lit("Empresa X").alias("name")).alias("hiringOrganization"), F.struct(F.struct(place.alias("addressLocality")).alias("address")).alias("jobLocation"), F.col("d").alias("datePosted"), F.lit("FULL_TIME").alias("employmentType"), F.struct(F.struct((F.col("id") % 100 * 1000).alias("value"), F.lit("MONTH").alias("unitText")).alias("value"), F.lit("BRL").alias("currency")).alias("baseSalary")))
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">\n'), c, F.lit("</script>"))
    html = F.concat(block(F.lit("{broken")), block(F.lit('{"@type":"Organization","name":"y"}')), F.when(F.col("id") % 4 != 0, block(F.replace(posting, F.lit("@@"), F.lit("\n\t")))).otherwise(""))
    return o.select("id", html.alias("html"))


DETAILS = "o_orderkey as id, case when o_orderkey % 4 = 0 then 'fallback_listagem' else 'json_ld' end as origin"


@query(f"select {DETAILS}, case when o_orderkey % 4 != 0 then 'Dev' end as title, case when o_orderkey % 4 != 0 then o_orderdate::date end as published from orders")
def s12_job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of that type that parses; raw control characters are allowed inside texts."""
    d = boards.job_postings(detail_pages(spark, sf_dir))
    return d.select("id", F.when(F.col("posting").isNull(), "fallback_listagem").otherwise("json_ld").alias("origin"), F.col("posting.title").alias("title"), F.to_date("posting.datePosted").alias("published"))


@query(
    f"""select {DETAILS}, case when o_orderkey % 4 = 0 then 'Da lista' else 'Empresa X' end as org, case when o_orderkey % 4 != 0 then (['Recife', 'Campinas', 'Lisboa'])[o_orderkey % 3 + 1] end as campus,
  case when o_orderkey % 4 = 0 then 'RJ' else (['PE', 'SP', null])[o_orderkey % 3 + 1] end as uf, case when o_orderkey % 4 != 0 then 'CLT' end as contract,
  case when o_orderkey % 4 != 0 then 'Até R$' || replace(format('{{:,}}', o_orderkey % 100 * 1000), ',', '.') || '/mês' end as salary, case when o_orderkey % 4 = 0 then 0 else 2 end as n_stack from orders"""
)
def p09_detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail fields over listing fields; the listing's place holds where there is no detail."""
    d = boards.job_postings(detail_pages(spark, sf_dir)).withColumn("org", F.lit("Da lista")).withColumn("uf", F.lit("RJ"))
    return boards.with_details(d).select("id", "origin", "org", "campus", "uf", "contract", "salary", F.size("stack").alias("n_stack"))


@query(
    """select o_orderkey as id, (['Recife – PE', 'Rio Branco – AC', 'Lisboa', null])[o_orderkey % 4 + 1] as campus, (['PE', 'AC', null, null])[o_orderkey % 4 + 1] as uf,
  case when o_orderkey % 5 = 0 then 'senior' else 'junior' end as level, case when o_orderkey % 3 = 0 then 'remoto' else 'presencial' end as modality, o_orderdate::date as first_day from orders"""
)
def p03_job_api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state's name gives its code; the publication day is the first day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey"))
    city, state = of(F.col("id"), "Recife", "Rio Branco", "Lisboa", None), of(F.col("id"), "Pernambuco", " ACRE ", "Lisboa", None)
    title = F.when(F.col("id") % 5 == 0, "Dev Sênior").otherwise("Analista Jr.")
    uf = extract.state_code(state)
    place = F.when(city.isNotNull(), F.concat_ws(" – ", city, uf))
    return o.select("id", place.alias("campus"), uf.alias("uf"), extract.seniority(title).alias("level"), extract.modality(F.when(F.col("id") % 3 != 0, "on-site"), F.col("id") % 3 == 0).alias("modality"), F.to_date("o_orderdate").alias("first_day"))


@query("select c_custkey as id, (['AC', 'SP', null])[c_custkey % 3 + 1] as uf from customer")
def j05_state_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small dimension joined on the bare, lower-case name."""
    states = spark.createDataFrame(list(extract.STATES.items()), "state_name string, uf string")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), of(F.col("c_custkey"), "Acre", "SÃO PAULO", "Algarve").alias("name"))
    return c.withColumn("state_name", F.lower(text.strip_accents(F.col("name")))).join(F.broadcast(states), "state_name", "left").select("id", "uf")


@query("select l_orderkey as id, 'PROFESSOR DE NÍVEL ' || l_linenumber as code, o_orderdate::date as published from lineitem join orders on l_orderkey = o_orderkey where o_orderkey % 6 != 0")
def p04_contest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each position of an open contest; blanks in its name collapse and the window's first day is the publication."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" PROFESSOR  DE\n NÍVEL "), F.col("l_linenumber").cast("string"))).alias("cargos"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(li, F.expr("l_orderkey = o_orderkey"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), "cargos", F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("inicio"), (F.col("o_orderkey") % 6 != 0).alias("aberto")).alias("datas")))
    return boards.contest_records(o.select(body.alias("body"))).select("id", "code", "published")


@query("select s_suppkey as id, s_name as company, case when s_suppkey % 3 = 0 then 'Texas' else 'Anywhere' end as campus, 'remoto' as modality from supplier")
def p05_remote_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a remote-work feed: always remote, the place is the state or else the region."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, "Texas").otherwise("").alias("state"))
    item = F.concat(F.lit("<item><title>"), F.col("s_name"), F.lit(": Dev</title><link>https://r/"), F.col("id").cast("string"), F.lit("</link><region>Anywhere</region><state>"), F.col("state"), F.lit("</state></item>"))
    rows = boards.remote_offers(s.select(item.alias("body")))
    return rows.select(F.regexp_extract("link", "([0-9]+)$", 1).cast("long").alias("id"), "company", F.coalesce("state", "region").alias("campus"), F.lit("remoto").alias("modality"))


@query(
    """select o_orderkey as id, (['remoto', 'hibrido', 'presencial', 'remoto'])[o_orderkey % 4 + 1] as modality,
  case o_orderkey % 3 when 0 then date '1998-06-01' when 1 then date '1998-06-01' - (o_orderkey % 30)::int when 2 then o_orderdate::date end as published from orders"""
)
def p07_card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modality from the place's wording, the publication day from relative dates."""
    from ..functions.calendar import relative_date

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey"))
    place = of(F.col("id"), "100% Remoto", "Recife (híbrido)", "Recife / PE", "Home office")
    said = F.when(F.col("id") % 3 == 0, "Hoje").when(F.col("id") % 3 == 1, F.concat(F.lit("Há "), (F.col("id") % 30).cast("string"), F.lit(" dias"))).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("id", boards.modality_of_place(place).alias("modality"), relative_date(said, F.lit("1998-06-01").cast("date")).alias("published"))


# ---- stores, bytes and dictionaries


@query("select n_nationkey as id, n_name || ' ação é ñ' as body from nation union all select s_suppkey + 100, s_name || ' ação é ñ' from supplier")
def s16_decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by each feed's own character set."""
    read = lambda t, k, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(k).cast("long").alias("id"), F.concat(F.col(c), F.lit(" ação é ñ")).alias("said"))
    landed = read("nation", "n_nationkey", "n_name").select("id", F.encode("said", "ISO-8859-1").alias("bytes"), F.lit("ISO-8859-1").alias("charset")).union(read("supplier", "s_suppkey", "s_name").select(F.col("id") + 100, F.encode("said", "UTF-8"), F.lit(None)))
    return landed.select("id", F.when(F.col("charset") == "ISO-8859-1", F.decode("bytes", "ISO-8859-1")).otherwise(F.decode("bytes", "UTF-8")).alias("body"))


def json_lines(rows: DataFrame, schema: str) -> DataFrame:
    """Rows as a store of one object a line, with blank lines, read back."""
    path = new_dir(rows.sparkSession, "store")
    rows.select(F.concat(F.to_json(F.struct(*rows.columns)), F.when(F.col(rows.columns[0]) % 5 == 0, "\n\n  ").otherwise("")).alias("value")).write.text(path)
    return rows.sparkSession.read.schema(schema).option("mode", "PERMISSIVE").json(path).dropna("all")


@query("select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders")
def s01_posting_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of JSON lines; blank lines don't count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return json_lines(o, "id long, status string, price double")


@query("select doc_id as id, lang, n_chars from documents")
def s02_news_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return json_lines(d, "id long, lang string, n_chars long")


@query("select unnest(string_split(text, ' ')) as term, count(*) as n from benchmark group by 1")
def s17_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of many-line JSON documents as a table of terms."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    path = new_dir(spark, "dictionary")
    b.select(F.to_json(F.struct(F.lit("x").alias("name"), F.split("text", " ").alias("terms")), {"pretty": "true"}).alias("value")).repartition(F.col("value")).write.text(path, lineSep="\n")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?<=\n\})\n")).alias("one"))
    parsed = whole.select(F.from_json("one", "name string, terms array<string>").alias("x"))
    return parsed.select(F.explode("x.terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
