"""Queries that parse payloads, built by Spark from the driver's tables, back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import feeds


def xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_payloads(spark: SparkSession, sf_dir: str, atom: bool) -> DataFrame:
    """One feed of about 100 items for each hundred documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title, link = xml(F.split_part("text", F.lit("\n"), F.lit(1))), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    if atom:
        item = F.concat(F.lit("<entry><title type='text'>"), title, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><updated>'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    else:
        item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    rows = d.select("doc_id", F.floor(F.col("doc_id") / 100).alias("feed"), item.alias("item"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "")
    return rows.groupBy("feed").agg(F.concat(F.lit("<rss><channel>"), body, F.lit("</channel></rss>")).alias("body"))


FEED_SQL = """select doc_id // 100 as feed, trim(split_part(text, chr(10), 1)) as title, 'https://x.example/' || doc_id as link, timestamp '2024-01-01' + to_hours(doc_id::int) as ts
from documents where trim(split_part(text, chr(10), 1)) != ''"""


@query(FEED_SQL)
def s13_rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_feed(feed_payloads(spark, sf_dir, atom=False)).select("feed", "title", "link", "ts")


@query(FEED_SQL)
def s15_atom_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.parse_feed(feed_payloads(spark, sf_dir, atom=True)).select("feed", "title", "link", "ts")


@query("select o_custkey as feed, o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders where o_orderstatus != 'P'")
def s06_json_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with overlapping pages, unique by id, the first wins."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    once = o.groupBy(F.col("o_custkey").alias("feed")).agg(F.collect_list(item).alias("items"))
    body = F.to_json(F.struct(F.concat("items", "items").alias("data")))
    rows = feeds.from_json_array(once.select("feed", body.alias("body")), "$.data", "id long, status string, price double")
    return feeds.first_per_key(rows, ["id"], "place").where("status != 'P'").select("feed", "id", "status", "price")


@query("select event_id, (props::json->>'k')::int as points, coalesce(null, (props::json->>'k')::int % 3) as comments from events")
def s14_discussion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments fall back to the number of children."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct(k.alias("points"), F.expr("cast(null as int)").alias("num_comments"), F.slice(F.sequence(F.lit(0), F.lit(2)), F.lit(1), k % 3).alias("children")))
    hit = F.from_json(body, "points int, num_comments int, children array<int>")
    return e.select("event_id", hit.alias("h")).select("event_id", "h.points", F.coalesce("h.num_comments", F.size("h.children")).alias("comments"))


@query("select s_suppkey as id, trim(split_part(s_name || ': role ' || s_nationkey, ':', 1)) as company, trim(split_part(s_name || ': role ' || s_nationkey, ':', 2)) as role from supplier")
def s08_company_and_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles split at the first colon."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.concat(F.col("s_name"), F.lit(": role "), F.col("s_nationkey").cast("string")).alias("title"))
    at = F.instr("title", ":")
    return s.where(at > 0).select("id", F.trim(F.substring("title", F.lit(1), at - 1)).alias("company"), F.trim(F.substring("title", at + 1, F.length("title"))).alias("role"))


@query("select o_orderkey as id, l_linenumber as place, l_partkey || '/24.' || lpad(l_linenumber::varchar, 2, '0') as code, l_quantity::int as vacancies from orders join lineitem on l_orderkey = o_orderkey where o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 2)")
def v08_umbrella_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An umbrella notice's table text to one row for each code; it takes two codes at least."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.concat(F.col("l_partkey").cast("string"), F.lit("/24."), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    line = F.concat_ws(" ", code, F.lit("Depto"), F.col("l_quantity").cast("int").cast("string"), F.lit("vagas"))
    text = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    found = text.select("id", F.regexp_extract_all("body", F.lit("([0-9]+/[0-9]{2}\\.[0-9]{2})"), F.lit(1)).alias("codes"), F.regexp_extract_all("body", F.lit("([0-9]+) vagas"), F.lit(1)).alias("counts")).where("size(codes) >= 2")
    rows = found.select("id", F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    return rows.select("id", F.substring_index("x.codes", ".", -1).cast("int").alias("place"), F.col("x.codes").alias("code"), F.col("x.counts").cast("int").alias("vacancies"))
