"""From raw documents to packed sequences: quality rules, line dedup, near-duplicate removal, mixing to target weights, packing.

Each stage reads what its predecessor wrote and returns the columns of documents, but for the last, which returns the pieces
of the packed sequences.  ORACLE_SQL is None: the estimation, the template tree, the signatures and the linear program have no SQL
form; ``tests/llm`` holds the stages against plain Python.

Edge cases: a document whose lines all recur across documents is dropped with them, one without a word stays; rows with a null doc_id pass near-duplicate
removal; of rows that share a doc_id and a text one stays there, those with other texts count as documents of their own; columns may have
any further names; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.line_dedup import drop_recurring_lines
from sextant.llm.mixing import mix
from sextant.llm.near_duplicates import near_duplicates
from sextant.llm.packing import pack
from sextant.llm.quality_rules import SPACE, judged
from sextant.llm.shared import free_name, new_dir

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = free_name(docs, "quality_verdict")
    return judged(docs, docs.columns, verdict).where(F.col(verdict)["kept"]).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "line_dedup")
    rows, cut = drop_recurring_lines(docs, name=name), F.col(name)
    emptied = (cut["n_dropped"] > 0) & (F.length(F.btrim(cut["text"], F.lit(SPACE))) == 0)
    own = {"text": cut["text"], "n_chars": F.coalesce(F.length(cut["text"]), F.lit(0)).cast("long")}
    return rows.where(~emptied).select(*(own[c].alias(c) if c in own else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    id_, key, class_ = (free_name(docs, x) for x in ("near_doc_id", "near_text_key", "near_class"))
    kept = near_duplicates(docs).where("kept and doc_id is not null")
    one = kept.where("class_no is not null").groupBy("class_no", "doc_id").agg(F.min("text_key").alias("text_key"))
    wordless = kept.where("class_no is null").select(F.lit(None).cast("long").alias("class_no"), "doc_id", "text_key").distinct()
    chosen = one.unionByName(wordless).toDF(class_, id_, key)
    rows = docs.withColumn(key, F.xxhash64("text"))
    stay = rows.join(chosen, (rows["doc_id"] == chosen[id_]) & (rows[key] == chosen[key]), "left_semi").dropDuplicates(["doc_id", key])
    return stay.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, docs.columns).where("copies > 0").select(F.explode(F.sequence(F.lit(1), "copies")).alias("copy_of_row"), "row").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"stage-{name}")
        found = stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
