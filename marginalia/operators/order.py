"""A global row index without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import shared_folder


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: made once, and partition ids stay what they were."""
    path = shared_folder(df.sparkSession, "order")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_index(df: DataFrame, *order: Column | str, name: str = "row_index", total: str = "row_count") -> DataFrame:
    """Add the 0-based position in ``order`` over all rows, and the number of rows.

    Rows are range-partitioned; partitions are counted (one small row each) and numbered inside.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"), F.sum("_n").over(Window.partitionBy()).alias(total))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(starts, "_part").withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_part", "_start")


def running_total(df: DataFrame, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """Add the inclusive running sum of ``value`` in ``order`` over all rows, the same way."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_s"))
    starts = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(starts, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def earlier_in_group(df: DataFrame, value: Column, group: Sequence[str], *order: Column | str, name: str = "earlier") -> DataFrame:
    """Add the sum of ``value`` over the rows of a group that come before a row in ``order``; 0 for the first.

    A group is cut into ranges of the order, so that no task holds all of a hot one: what a range adds is one small row a
    group. Null groups are groups; rows that tie in ``order`` follow each other as they come.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stable(df.withColumn("_value", value).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    keys = [F.col(g).alias(f"_of_{i}") for i, g in enumerate(group)]
    sums = placed.groupBy(F.col("_part").alias("_p"), *keys).agg(F.sum("_value").alias("_s"))
    lower = Window.partitionBy(*[f"_of_{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_s").over(lower), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return rows.join(starts, same).withColumn(name, F.col(name) + F.col("_start")).select(*df.columns, name)


def evenly(index: Column, total: Column, count: Column) -> Column:
    """Whether row ``index`` of ``total`` is one of ``count`` rows at positions ``i * total div count``."""
    i = F.ceil(index * count / total).cast("long")
    return (count >= total) | ((i < count) & (F.floor(i * total / count) == index))
