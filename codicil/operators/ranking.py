"""Row numbers within groups of any size.

A window numbers a group in one task, which a group with a third of all rows
would overload. Here rows are range-sorted over all tasks, numbered within each
task by position, and lifted by the number of the group's rows in earlier tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.session import durable


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within ``group`` by ``order``, whose values are unique in a group."""
    mid = F.monotonically_increasing_id()  # (task << 33) + position in the task
    placed = durable(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", mid), "ranked")
    placed = placed.withColumn("_task", F.shiftright("_id", 33))
    keys = [f"_g{i}" for i in range(len(group))]
    parts = placed.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col("_task").alias("_at")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row for each group and task it lies in: a group of any size has at most as many as there are tasks.
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    condition = F.col("_task") == F.col("_at")
    for g, k in zip(group, keys):
        condition = condition & F.col(g).eqNullSafe(F.col(k))
    out = placed.join(parts, condition, "left")
    return out.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(name))
