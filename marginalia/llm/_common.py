"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: ASCII white space as the contracts define it: blank and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where Spark is a single process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: cuts lineage, survives lost executors, is computed once.

    The tables belong to the job: whoever owns the folder clears it after the results are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so that a run of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def bucket_bits(spark: SparkSession) -> int:
    """Bits of a hash that name a bucket: about four buckets for each shuffle partition."""
    return max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def running_sums(df: DataFrame, group: Sequence[str], position: str, value: Column, ties: Sequence[str] = (), out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of a group that come earlier.

    ``position`` is a column of 63-bit non-negative numbers, evenly spread (a hash). Rows of a group are dealt into
    buckets of neighbouring positions; sums over buckets give each bucket's start, so that no task holds a whole group,
    however hot; the window over those sums has at most one row a bucket for each group. The order, hence the result,
    does not depend on the number of buckets. Group columns are not null; other columns of any name stay as they are.
    """
    bits = bucket_bits(df.sparkSession)
    bucket, amount, total, start = fresh([*df.columns, out], "_bucket", "_value", "_total", "_start")
    df = df.withColumn(bucket, F.shiftright(F.col(position), 63 - bits)).withColumn(amount, value)
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(amount).alias(total))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(start))
    inside = Window.partitionBy(*keys).orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, keys).withColumn(out, F.col(start) + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop(bucket, amount, start)


def join_facts(rows: DataFrame, facts: DataFrame, key: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and in ``n`` how many rows have that key.

    A key of more than a ten-thousandth of the ``total`` rows (512 at least) is split: its rows are dealt by hash, its fact is
    repeated once for each part. So no task holds a hot key whole. Fewer than 10,000 keys can be that hot, and only they
    and the number of their parts are broadcast. ``n`` is dropped.
    """
    limit = max(512, total // 10_000)
    part, parts = fresh([*rows.columns, *facts.columns], "_part", "_parts")
    split = F.ceil(F.col("n") / limit).cast("int")
    hot = facts.where(F.col("n") > limit).select(*key, split.alias(parts))
    others = [c for c in rows.columns if c not in key]
    dealt = rows.join(F.broadcast(hot), list(key), "left").withColumn(part, F.pmod(F.xxhash64(*others), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copies = facts.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(split, F.lit(1)) - 1))).drop("n")
    return dealt.join(copies, [*key, part], how).drop(part)


def hashed(*columns: Column | str) -> Column:
    """A 63-bit non-negative hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that none of ``taken`` equals, upper and lower case being one."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def columns(names: Iterable[str]) -> list[Column]:
    """The columns of these names, dots and all."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in names]
