"""A backfill of an interval of days with a ledger of what was done.

The ledger has a row a day: interval, day, outcome and error.  A run goes on where the last one stopped if the ledger is whole and of the same interval; another
interval, or a row that doesn't parse, starts a new generation from nothing, with its own table.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "lo string, hi string, day date, outcome string, error string"


def generations(spark: SparkSession, path: str) -> list[int]:
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(int(x.removeprefix("generation-")) for x in names if x.startswith("generation-"))


def ledger(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(f"{LEDGER}, bad string").option("columnNameOfCorruptRecord", "bad").json(f"{path}/ledger/generation-{generation}")


def usable(spark: SparkSession, path: str, lo: str, hi: str) -> int | None:
    """The last generation, if its ledger is whole and of this interval."""
    if not (found := generations(spark, path)):
        return None
    rows = ledger(spark, path, found[-1])
    # the parser leaves the field alone unless some other field is asked for
    odd = rows.select("*").where(F.col("bad").isNotNull() | ~F.col("lo").eqNullSafe(lo) | ~F.col("hi").eqNullSafe(hi) | ~F.coalesce(F.col("outcome").isin("ok", "error"), F.lit(False)))
    return found[-1] if odd.limit(1).count() == 0 else None


def backfill(spark: SparkSession, path: str, lo: datetime.date, hi: datetime.date, work: Callable[[DataFrame], DataFrame], step: int, stop_after: int | None = None) -> int:
    """Works through the days of the interval in commits of ``step`` days and returns the generation.

    ``work`` takes rows (day) and gives rows with a column ``day``, and, where it can't, a column ``error``.  A commit writes its days' part of the table, overwriting what a
    killed one has left there, then its rows of the ledger.  ``stop_after`` commits the run ends, as a lost driver does.
    """
    first, last = lo.isoformat(), hi.isoformat()
    generation = usable(spark, path, first, last)
    if generation is None:
        generation = max(generations(spark, path), default=-1) + 1
        spark.createDataFrame([], LEDGER).write.mode("append").json(f"{path}/ledger/generation-{generation}")
    table = f"{path}/table/generation-{generation}"
    done = ledger(spark, path, generation).agg(F.max("day")).first()[0]
    start = lo if done is None else done + datetime.timedelta(1)
    commits = 0
    while start <= hi and (stop_after is None or commits < stop_after):
        end = min(hi, start + datetime.timedelta(step - 1))
        days = spark.sql(f"select explode(sequence(date '{start}', date '{end}')) as day")
        found = work(days)
        rows = found.drop("error") if "error" in found.columns else found
        failed = found.where("error is not null").groupBy("day").agg(F.min("error").alias("error")) if "error" in found.columns else days.limit(0).withColumn("error", F.lit(None).cast("string"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
        marks = days.join(failed, "day", "left").select(F.lit(first).alias("lo"), F.lit(last).alias("hi"), "day", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("outcome"), "error")
        marks.coalesce(1).write.mode("append").json(f"{path}/ledger/generation-{generation}")  # a row a day
        start, commits = end + datetime.timedelta(1), commits + 1
    return generation


def read_table(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.option("basePath", f"{path}/table/generation-{generation}").parquet(f"{path}/table/generation-{generation}")
