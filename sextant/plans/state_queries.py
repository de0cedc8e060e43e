"""Queries over hand-kept state: conversations stand for rows that a person and a robot keep by url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query

STATE = "state as (select conv_id as url, turn, case role when 'user' then 'humano' when 'assistant' then 'robo' else role end as voice, text from conversations)"


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    voice = F.when(F.col("role") == "user", "humano").when(F.col("role") == "assistant", "robo").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("url"), "turn", voice.alias("voice"), "text")


@query(f"with {STATE} select url, turn, voice from (select *, row_number() over (partition by url order by turn desc) as n from state where text != '') where n = 1")
def u10_last_row_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = state(spark, sf_dir).where("text != ''").groupBy("url").agg(F.max_by("voice", "turn").alias("voice"), F.max("turn").alias("turn"))
    return last.select("url", "turn", "voice")


@query(f"with {STATE} select a.url, a.turn, a.voice, b.voice as answers, substring(b.text, 1, 60) as quoted, case when a.turn = 0 then 'inicio' when b.url is null then 'invalida' else 'ok' end as context from state a left join state b on b.url = a.url and b.turn = a.turn - 1")
def j16_reply_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry with the one it answers."""
    s = state(spark, sf_dir)
    b = s.select("url", (F.col("turn") + 1).alias("turn"), F.col("voice").alias("answers"), F.substring("text", 1, 60).alias("quoted"), F.lit(True).alias("there"))
    context = F.when(F.col("turn") == 0, "inicio").when(F.col("there").isNull(), "invalida").otherwise("ok")
    return s.join(b, ["url", "turn"], "left").select("url", "turn", "voice", "answers", "quoted", context.alias("context"))


@query(f"with {STATE}, r as (select *, row_number() over (partition by url order by length(text), turn) as n from state) select url, string_agg(turn || ':' || voice, ' / ' order by length(text), turn) as next_tasks from r where n <= 3 group by url")
def w10_next_tasks_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three first entries of a project as one text."""
    n = F.row_number().over(Window.partitionBy("url").orderBy(F.length("text"), "turn"))
    top = state(spark, sf_dir).withColumn("n", n).where("n <= 3")
    return top.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(":", "turn", "voice").alias("t")))), lambda x: x["t"]), " / ").alias("next_tasks"))


@query(f"with {STATE}, r as (select *, row_number() over (partition by url order by turn desc) as n from state) select url, string_agg(turn || ' ' || voice, '; ' order by turn desc) as moves from r where n <= 2 group by url")
def w11_last_moves_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = state(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("turn")))).where("n <= 2")
    return top.groupBy("url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", "turn", "voice").alias("t")))), lambda x: x["t"]), "; ").alias("moves"))


#: Applications are customers' orders, their stage is the priority; the list of stages is a table, in its order.
STAGES = "stages as (select o_orderpriority as stage, row_number() over (order by o_orderpriority) as place from (select distinct o_orderpriority from orders))"


@query(f"with {STAGES} select s.stage, s.place, count(o.o_orderkey) as n, count_if(o.o_orderdate::date < date '1998-08-02' - 14)::bigint as stale from stages s left join orders o on o.o_orderpriority = s.stage and o.o_orderstatus = 'P' group by 1, 2")
def a23_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolled rows by stage, in the order of the stages, and those that haven't moved for 14 days; all stages appear, those without rows too."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    stages = o.select(F.col("o_orderpriority").alias("stage")).distinct().withColumn("place", F.row_number().over(Window.orderBy("stage")).cast("long"))  # a row a stage
    stale = F.to_date("o_orderdate") < F.date_sub(F.lit("1998-08-02").cast("date"), 14)
    n = o.where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.count_if(stale).alias("stale"))
    return stages.join(n, "stage", "left").select("stage", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("stale", F.lit(0)).alias("stale"))


@query(
    """with tasks as (select l_orderkey as project, l_linenumber as place, l_shipdate::date as day, l_linestatus = 'F' as done from lineitem)
select o_orderkey as project, max(case when done then day end) as last_move, count(case when not done then 1 end) as open_tasks, min(case when not done then day end) as next_deadline, count(case when done then 1 end) as done, count(place) as total,
  min(case when not done then place end) as current_stage from orders left join tasks on project = o_orderkey group by 1"""
)
def a24_project_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each project, one without tasks too: last movement, open tasks, next deadline, progress and the first stage that isn't done."""
    done = F.col("l_linestatus") == "F"
    tasks = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("project"))
        .agg(
            F.to_date(F.max(F.when(done, F.col("l_shipdate")))).alias("last_move"),
            F.count_if(~done).alias("open_tasks"),
            F.to_date(F.min(F.when(~done, F.col("l_shipdate")))).alias("next_deadline"),
            F.count_if(done).alias("done"),
            F.count("*").alias("total"),
            F.min(F.when(~done, F.col("l_linenumber"))).alias("current_stage"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    projects = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("project"))
    return projects.join(tasks, "project", "left").select("project", "last_move", zero("open_tasks"), "next_deadline", zero("done"), zero("total"), "current_stage")


@query(f"with {STATE}, due as (select url, turn, 'tarefa' as kind from state where voice = 'humano' and turn <= 2), att as (select url, turn, 'aviso' as kind from state where voice = 'robo' and turn >= 5) select url, turn, kind from (select *, row_number() over (partition by kind order by turn, url) as n from (select * from due union all select * from att)) where n <= 8")
def u02x_due_and_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of unlike rows in one form, the first of each block."""
    s = state(spark, sf_dir)
    due = s.where("voice = 'humano' and turn <= 2").select("url", "turn", F.lit("tarefa").alias("kind"))
    both = due.unionByName(s.where("voice = 'robo' and turn >= 5").select("url", "turn", F.lit("aviso").alias("kind")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("turn", "url"))).where("n <= 8").select("url", "turn", "kind")


@query(f"with {STATE} select url, turn, case voice when 'humano' then 'pessoa' when 'robo' then 'automatico' else voice end as voice from state")
def u09_rename_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("humano", "pessoa"), ("robo", "automatico")], "voice string, new string")
    return state(spark, sf_dir).join(F.broadcast(names), "voice", "left").select("url", "turn", F.coalesce("new", "voice").alias("voice"))
