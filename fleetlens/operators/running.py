"""Running sums over whole tables without a task that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators.sizes import small
from fleetlens.sources.scratch import written


def run_up(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows of their group that come before them in order, which has no ties.

    Rows are range-sorted by group and order; each partition is summed up by itself, and what partitions before hold of
    its first group is added: a table of as many rows as there are partitions and groups."""
    placed = written(rows.orderBy(*group, *order).withColumn("_p", F.spark_partition_id()))
    before = F.sum(value).over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    sums = placed.groupBy("_p", *group).agg(F.sum(value).alias("_s"))
    offsets = sums.select("_p", *group, (F.sum("_s").over(Window.partitionBy(*(group or [F.lit(1)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"))
    return placed.withColumn(name, before).join(small(offsets), ["_p", *group]).withColumn(name, F.col(name) + F.col("_o")).drop("_p", "_o")
