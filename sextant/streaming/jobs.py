"""Structured Streaming jobs that drain what has landed and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import new_dir


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its table; a retried batch overwrites its own part."""
    spark = stream.sparkSession
    out, state = new_dir(spark, "stream-out"), new_dir(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(stream.columns)


def insert_unseen(stream: DataFrame, key: list[str], arrival: str, name: str, folder: str | None = None) -> DataFrame:
    """The first arrival of each key; later batches only add keys that the table lacks.

    ``folder`` holds the table and the stream's checkpoint, so that a restart goes on where the last run stopped.  A batch that is run
    again overwrites its own part and looks at the parts of earlier batches only.
    """
    spark = stream.sparkSession
    folder = folder or new_dir(spark, "unseen")
    out = f"{folder}/table"
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + f", {name} {kinds[arrival]}"
    read = lambda: spark.read.schema(f"{schema}, batch long").parquet(out)
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        firsts = batch.groupBy(*key).agg(F.min(arrival).alias(name))
        fresh = firsts.join(read().where(F.col("batch") < number).select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return read().select(*key, name)


def with_alerts(stream: DataFrame, level: Callable[[DataFrame], DataFrame], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs a counting stream to its end; returns its table and the rows of it that raise an alert, each written per batch."""
    spark = stream.sparkSession
    folder = folder or new_dir(spark, "monitor")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")
        level(batch).write.mode("overwrite").parquet(f"{folder}/alerts")

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table"), spark.read.parquet(f"{folder}/alerts")
