"""The library's record families as adapters over the driver's tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed "now" of the posting and news queries.
NOW = "1998-06-01"
NEWS_NOW = "2024-02-01"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first line is the title."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tabs = F.array(*map(F.lit, ("geral", "ia", "trabalho", "ciencia")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        "lang",
        F.col("source").alias("domain"),
        F.element_at(tabs, (F.col("doc_id") % 4 + 1).cast("int")).alias("tab"),
        F.concat(F.lit("tema"), (F.col("doc_id") % 9).cast("string")).alias("theme"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 37 % 720 * 3600).alias("ts"),
    )


NEWS = """news as (
  select doc_id as id, split_part(text, chr(10), 1) as title, lang, source as domain,
    (['geral', 'ia', 'trabalho', 'ciencia'])[(doc_id % 4 + 1)::int] as tab, 'tema' || (doc_id % 9) as theme,
    timestamp '2024-01-01' + to_hours((doc_id * 37 % 720)::int) as ts
  from documents)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings: the customer publishes, the nation is the state, the last shipment is the deadline."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    deadline = read("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("deadline"))
    joined = read("orders").join(read("customer"), F.expr("o_custkey = c_custkey")).join(read("nation"), F.expr("c_nationkey = n_nationkey")).join(deadline, F.expr("o_orderkey = l_orderkey"), "left")
    degrees = F.array(*map(F.lit, ("doutorado", "mestrado", "especializacao", "graduacao", None)))
    areas = {"1-URGENT": "Design", "2-HIGH": "UX/IHC", "3-MEDIUM": "Computação/IA", "4-NOT SPECIFIED": None}
    area = None
    for k, v in areas.items():
        area = F.when(F.col("o_orderpriority") == k, v) if area is None else area.when(F.col("o_orderpriority") == k, v)
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("org"),
        F.col("n_name").alias("uf"),
        F.when(F.col("o_orderstatus") == "O", "docente").when(F.col("o_orderstatus") == "F", "mercado").otherwise("outro").alias("track"),
        area.otherwise("Educação/Ensino").alias("area"),
        F.col("o_orderpriority").alias("kind"),
        F.element_at(degrees, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("degree"),
        (F.col("o_orderkey") % 61).cast("int").alias("weight"),
        (F.col("o_orderkey") % 11).cast("int").alias("source_no"),
        F.col("o_orderdate").cast("date").alias("published"),
        "deadline",
        F.col("o_totalprice").alias("price"),
    )


POSTINGS = """postings as (
  select o_orderkey as id, c_name as org, n_name as uf, case o_orderstatus when 'O' then 'docente' when 'F' then 'mercado' else 'outro' end as track,
    case o_orderpriority when '1-URGENT' then 'Design' when '2-HIGH' then 'UX/IHC' when '3-MEDIUM' then 'Computação/IA' when '4-NOT SPECIFIED' then null else 'Educação/Ensino' end as area,
    o_orderpriority as kind, (['doutorado', 'mestrado', 'especializacao', 'graduacao', null])[(o_orderkey % 5 + 1)::int] as degree,
    (o_orderkey % 61)::int as weight, (o_orderkey % 11)::int as source_no, o_orderdate::date as published, deadline, o_totalprice as price
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    left join (select l_orderkey, max(l_shipdate)::date as deadline from lineitem group by 1) on o_orderkey = l_orderkey)"""
