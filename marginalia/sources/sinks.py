"""Sinks: partitioned tables committed as a whole, manifests, rejects and checkpoints of runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares; on a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-catalog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_notes(notes: DataFrame, path: str, mode: str = "append") -> None:
    """Notes by ``folder, capture_date``; a failed job leaves nothing behind."""
    notes.repartition("folder", "capture_date", F.pmod(F.xxhash64("stem"), F.lit(32))).write.mode(mode).partitionBy("folder", "capture_date").parquet(path)


def write_page_artifacts(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Raw html and extracted text of each page, the text headed by where it came from."""
    head = F.concat(F.lit("<!-- source: "), F.coalesce("url", F.lit("unknown")), F.lit(" -->\n\n"))
    pages.select("stem", "capture_date", "html", F.concat(head, F.coalesce("markdown_content", F.lit(""))).alias("extracted")).write.mode(mode).partitionBy("capture_date").parquet(path)


def write_analysis_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """One row a dimension by ``run_id, phase``; its metadata as JSON without empty fields."""
    meta = [c for c in results.columns if c not in ("run_id", "phase", "content")]
    known = F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta])
    results.select("run_id", "phase", F.to_json(known).alias("frontmatter"), "content").write.mode(mode).partitionBy("run_id", "phase").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest of one row as JSON."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_run_manifests(manifests: DataFrame, path: str, mode: str = "append") -> None:
    """A JSON line for each run (see ``run_manifest``) with the time it was made; empty fields are written as null, so that all lines have
    the same ones."""
    manifests.withColumn("generated_at", F.current_timestamp()).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_rejects(checked: DataFrame, path: str) -> DataFrame:
    """Append the refused rows with their reason and time; return the admitted ones."""
    checked.where(F.col("reason").isNotNull()).withColumn("rejected_at", F.current_timestamp()).write.mode("append").parquet(path)
    return checked.where(F.col("reason").isNull()).drop("reason")


def write_phase_checkpoint(spark: SparkSession, path: str, run_id: str, phase: str, completed: list[str], pending: list[str], mark: str) -> None:
    """Append a row to the table of runs: a phase, its dimensions done and to do, and the fingerprint of the corpus."""
    rows = spark.createDataFrame([(run_id, phase, completed, pending, mark)], "run_id string, phase string, completed array<string>, pending array<string>, mark string")
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def append_pending_images(images: DataFrame, path: str) -> None:
    """Append images that wait for a text: ``message_id, chat_id, file_path, captured_at``."""
    images.select("message_id", "chat_id", "file_path", "captured_at", F.lit("pending").alias("status")).write.mode("append").parquet(path)


def write_category_summaries(summaries: DataFrame, path: str, mode: str = "append") -> None:
    """A row for each category of a run; its metadata as JSON without empty fields, beside its content.

    The number of files goes with the tasks, not with the runs, of which there may be very many. Files are sorted by ``run_id``, so a
    reader of one run skips the pages of all others.
    """
    meta = [c for c in summaries.columns if c not in ("run_id", "content")]
    known = F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in meta])
    summaries.select("run_id", F.to_json(known).alias("frontmatter"), "content").sortWithinPartitions("run_id").write.mode(mode).parquet(path)
