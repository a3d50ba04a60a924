"""Counts that come with a write: named metrics observed by the job itself, not by a second pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F


def metered_write(rows: DataFrame, metrics: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, object]:
    """Write ``rows`` and return what was counted of them on the way."""
    seen = Observation()
    write(rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]))
    return seen.get


def import_posts(archive: DataFrame, queue: DataFrame | None, path: str, key: str = "tweet_id", when: str = "created_at") -> dict[str, int]:
    """Append the posts of an archive that the queue has never held to ``path``; ``total, added, skipped, failed``.

    A post without a key or a time fails; of posts that repeat a key within the archive one is added and the others are
    skipped, as are those whose key is in ``queue``, whatever became of it. All four numbers are observed by the one job
    that writes.
    """
    known = queue.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True)) if queue is not None else archive.select(key).limit(0).withColumn("_known", F.lit(True))
    every = archive.withColumn("_bad", F.col(key).isNull() | F.col(when).isNull())
    before, after = Observation(), Observation()
    counted = every.observe(before, F.count(F.lit(1)).alias("total"), F.count_if("_bad").alias("failed"))
    fresh = counted.where("not _bad").dropDuplicates([key]).join(known, key, "left").where("_known is null").select(*archive.columns)
    fresh.observe(after, F.count(F.lit(1)).alias("added")).write.mode("append").parquet(path)
    found = before.get | after.get
    return {"total": found["total"], "added": found["added"], "skipped": found["total"] - found["failed"] - found["added"], "failed": found["failed"]}


def process_batch(captures: DataFrame, process: Callable[[DataFrame], DataFrame], path: str) -> dict[str, object]:
    """Process a batch into ``path`` and sum it up: n, processed, failed, recovered, files, kinds, as the write saw them.

    What ``process`` returns has ``status, output_file, kind``, a file for each note at most; kinds are few.
    """
    is_ = lambda x: F.count_if(F.col("status") == x)
    metrics = {"n": F.count(F.lit(1)), "processed": is_("done"), "failed": is_("failed"), "recovered": is_("written"), "files": F.count("output_file"), "kinds": F.size(F.collect_set("kind"))}
    return metered_write(process(captures), metrics, lambda rows: rows.write.mode("append").parquet(path))
