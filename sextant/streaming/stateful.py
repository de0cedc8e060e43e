"""Streams that keep state: first times of items with a horizon, volumes of sources that fall silent, and records that don't parse."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.storage import new_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as value state needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class FirstSeen(StatefulProcessor):
    """Keeps the first time of each key as value state, which lapses ``horizon_ms`` after it was last set; tells a key when its first time is new or earlier."""

    def __init__(self, horizon_ms: int | None):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at timestamp", self.horizon_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = min((x["at"].min() for x in rows), default=None)
        if found is None or pd.isna(found):
            return
        held = self.first.get()[0] if self.first.exists() else None
        if held is None or found < pd.Timestamp(held):
            self.first.update((found.to_pydatetime(),))
            yield pd.DataFrame({"key": [key[0]], "first_seen": [found]})

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, folder: str | None = None, horizon_ms: int | None = None) -> DataFrame:
    """``stream(key string, at timestamp)`` to (key, first_seen).

    The times are state of the stream, so a run that goes on from ``folder`` keeps those of earlier runs and writes only keys that are new to it; with a
    horizon, state that old is let go.  A batch that is run again overwrites its own part.
    """
    spark = stream.sparkSession
    folder = folder or new_dir(spark, "first-seen")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    with rocks_db(spark):
        mode = "ProcessingTime" if horizon_ms else "None"
        told = stream.where("key is not null and at is not null").groupBy("key").transformWithStateInPandas(FirstSeen(horizon_ms), "key string, first_seen timestamp", "Update", mode)
        told.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema("key string, first_seen timestamp").parquet(f"{folder}/table").groupBy("key").agg(F.min("first_seen").alias("first_seen"))


def with_silent_days(counts: DataFrame, source: str) -> DataFrame:
    """``counts(source, day, n)`` with a row of zero for each source and day between the first and the last day of all; the grid grows with sources and days, not with events."""
    lo, hi = counts.agg(F.min("day"), F.max("day")).first()
    days = F.sequence(F.lit(lo), F.lit(hi)) if lo else F.array().cast("array<date>")
    grid = counts.select(source).distinct().select(source, F.explode(days).alias("day"))
    return grid.join(counts, [source, "day"], "left").select(source, "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def volume_monitor(stream: DataFrame, source: str, at: str, judge: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts a stream by day and source and judges the days, silent ones too; (volumes, alerts), where ``judge`` adds a column ``level`` and all but ``ok`` are alerts."""
    spark = stream.sparkSession
    folder = folder or new_dir(spark, "volumes")
    counts = stream.groupBy(F.window(at, "1 day").alias("w"), source).agg(F.count("*").alias("n")).select(source, F.to_date("w.start").alias("day"), "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/volumes")
        whole = spark.read.schema(batch.schema).parquet(f"{folder}/volumes")
        judge(with_silent_days(whole, source)).where("level != 'ok'").write.mode("overwrite").parquet(f"{folder}/alerts")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{folder}/volumes"), spark.read.parquet(f"{folder}/alerts")


def split_corrupt(lines: DataFrame, schema: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A stream of text ``lines(value, …)``, one JSON object each, to (rows, errors).

    Each batch is parsed once; what doesn't fit the schema goes to a table of errors with its text, beside the rows, under the batch's number.  A batch that is run again
    overwrites both of its parts; :func:`replayed` parses stored errors anew.
    """
    spark = lines.sparkSession
    folder = folder or new_dir(spark, "records")
    rest = [c for c in lines.columns if c != "value"]

    def write(batch: DataFrame, number: int) -> None:
        parsed = parsed_lines(batch, schema).persist()
        try:
            parsed.where("error is null").select("x.*", *rest).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
            parsed.where("error is not null").select("value", "error", *rest).write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")
        finally:
            parsed.unpersist()

    lines.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    more = ", ".join(f"`{c}` {dict(lines.dtypes)[c]}" for c in rest)
    read = lambda name, own: spark.read.schema(", ".join(x for x in (own, more) if x)).parquet(f"{folder}/{name}").drop("batch")
    return read("rows", schema), read("errors", "value string, error string")


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``lines`` with the object ``x`` of each ``value``, or an ``error``: no JSON, or a field that doesn't fit."""
    value = F.try_parse_json("value")
    rows = lines.withColumn("x", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    error = F.when(value.isNull(), "json").when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "field")
    return rows.withColumn("error", error).withColumn("x", F.col("x").dropFields("_bad"))


def replayed(errors: DataFrame, schema: str) -> DataFrame:
    """Stored errors that fit a (wider) schema after all."""
    return parsed_lines(errors.drop("error"), schema).where("error is null").select("x.*")
