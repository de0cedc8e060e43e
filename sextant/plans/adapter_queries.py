"""All feeds through one adapter: landed files, a table of feeds, items and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import new_dir
from ..registry import query
from ..sources.landed import SourceAdapter, land

FEED = "doc_id // 100"
#: Titles as a page in Latin-1 can spell them.
TITLES = f"""items as (select doc_id, {FEED} as feed, case when ({FEED}) % 4 = 1 then regexp_replace(trim(split_part(text, chr(10), 1)), '[^\\x00-\\xFF]', '?', 'g') else trim(split_part(text, chr(10), 1)) end as title from documents)"""


def feed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a feed: kind, character set, publisher, tab, theme and terms."""
    k = F.col("feed")
    charset = F.when(k % 4 == 1, "ISO-8859-1").when(k % 4 == 3, "UTF-16LE")
    terms = F.when(k % 5 == 2, F.array(*map(F.lit, ("the", "tion*", "der")))).when(k % 5 == 3, F.array(*map(F.lit, ("la", "en*"))))
    feeds = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.floor(F.col("doc_id") / 100).alias("feed")).distinct()
    publisher = F.when(k % 3 == 1, F.concat(F.lit("r/sub"), k.cast("string"))).otherwise(F.concat(F.lit("pub"), (k % 7).cast("string")))
    return feeds.select("feed", F.when(k % 3 == 2, "json").otherwise("feed").alias("kind"), charset.alias("charset"), publisher.alias("publisher"), F.when(k % 2 == 0, "ia").otherwise("geral").alias("tab"), F.concat(F.lit("tema"), (k % 3).cast("string")).alias("theme"), terms.alias("terms"))


def landed(spark: SparkSession, sf_dir: str, feeds: DataFrame) -> str:
    """Payloads of the feeds' kinds and character sets, as a fetcher lands them; every 9th feed's is cut off."""
    k = F.col("feed")
    first = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.floor(F.col("doc_id") / 100).alias("feed"), first.alias("said"))
    title = F.when(k % 4 == 1, F.regexp_replace("said", "[^\\x00-\\xFF]", "?")).otherwise(F.col("said"))
    escaped = F.regexp_replace(F.regexp_replace(title, "&", "&amp;"), "<", "&lt;")
    link = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 3600)
    rss = F.concat(F.lit("<item><title>"), escaped, F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), escaped, F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><updated>'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    comments = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 11)
    hit = F.struct(title.alias("title"), link.alias("url"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), (F.col("doc_id") % 50).alias("points"), comments.alias("num_comments"), F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), (F.col("doc_id") % 7).cast("int")).alias("children"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c.alias("x")))), lambda y: y["x"])
    bodies = d.groupBy("feed").agg(F.array_join(listed(rss), "").alias("rss"), F.array_join(listed(atom), "").alias("atom"), F.to_json(F.struct(listed(hit).alias("hits"))).alias("json"))
    text = F.when(k % 3 == 0, F.concat(F.lit("<rss><channel>"), "rss", F.lit("</channel></rss>"))).when(k % 3 == 1, F.concat(F.lit('<feed xmlns="a">'), "atom", F.lit("</feed>"))).otherwise(F.col("json"))
    body = F.when(k % 9 == 8, F.substring(text, 1, 40)).otherwise(text)
    payload = F.when(k % 4 == 1, F.encode(body, "ISO-8859-1")).when(k % 4 == 3, F.encode(body, "UTF-16LE")).otherwise(body.cast("binary"))
    path = new_dir(spark, "landed")
    land(bodies.select("feed", payload.alias("payload")), path)
    return path


PASSES = """case feed % 5 when 2 then regexp_matches(lower(strip_accents(title)), '(^|[^a-z0-9_])(the([^a-z0-9_]|$)|tion|der([^a-z0-9_]|$))')
  when 3 then regexp_matches(lower(strip_accents(title)), '(^|[^a-z0-9_])(la([^a-z0-9_]|$)|en)') else true end"""


@query(
    f"""with {TITLES} select feed, title, 'https://x.example/' || doc_id as link, timestamp '2024-01-01' + to_hours(doc_id::int) as ts, case when feed % 3 = 2 then doc_id % 50 end as points,
  case when feed % 3 = 2 then case when doc_id % 2 = 0 then doc_id % 11 else doc_id % 7 end end as comments, case when feed % 3 = 1 then 'r/sub' || feed else 'pub' || feed % 7 end as publisher,
  case when feed % 2 = 0 then 'ia' else 'geral' end as tab, 'tema' || feed % 3 as theme from items where feed % 9 != 8 and (title != '' or feed % 3 = 2) and {PASSES}"""
)
def s18_source_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS, Atom and API payloads in three character sets, read from landed files by one adapter and a row a feed; feeds with terms keep the titles that have one."""
    feeds = feed_table(spark, sf_dir)
    return SourceAdapter(feeds, landed(spark, sf_dir, feeds), part_bytes=1 << 18).items().drop("place")


@query(f"select distinct {FEED} as feed, 'payload' as error from documents where ({FEED}) % 9 = 8 and ({FEED}) % 3 = 2")
def s18x_adapter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that can't be read are told by feed and file; the other feeds go on."""
    feeds = feed_table(spark, sf_dir)
    return SourceAdapter(feeds, landed(spark, sf_dir, feeds)).errors().select("feed", "error")
