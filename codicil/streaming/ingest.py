"""Incremental arrival of records (an addition; the batch operators don't need it).

Rows that are delivered twice or late are dropped by key within a watermark, and
each micro-batch is appended to the landing table with the batch number in its
path, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    return stream.where(" and ".join(f"`{k}` is not null" for k in keys)).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once landing: one folder for each batch, overwritten on replay."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_day(stream: DataFrame, time: str, delay: str = "7 days") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "release_tag").agg(F.count(F.lit(1)).alias("n"))
