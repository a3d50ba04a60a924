"""A queue worked off in rounds that the clock drives, so a backlog shrinks without new input."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

#: Captures that one round processes, how often a round starts, and how many rounds share a snapshot of what waits.
BATCH, EVERY, KEEP = 500, "5 minutes", 16
_TICK = "_tick"


def clock(spark: SparkSession) -> DataFrame:
    """A tick a second: a stream that has something new at every trigger."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().select(F.lit(True).alias(_TICK))


def _rounds(spark: SparkSession, schema, root: str, kind: str, first: int, last: int) -> DataFrame | None:
    """The written tables of some rounds, one path each; none if there is no round."""
    return spark.read.schema(schema).parquet(*[f"{root}/{kind}/round={i}" for i in range(first, last + 1)]) if first <= last else None


def waiting(spark: SparkSession, schema, root: str, number: int, key: str, keep: int = KEEP, with_done: bool = False) -> DataFrame:
    """The captures that wait in round ``number`` before (or, ``with_done``, after) it has processed any.

    The last snapshot, what came in since, less what was processed since: at most ``2 * keep + 1`` paths, however old the
    queue is.
    """
    base = (number if with_done else number - 1) // keep * keep if number else 0
    base = base - keep if with_done and base == number and number else base
    rows = [x for x in (spark.read.schema(schema).parquet(f"{root}/waiting/round={base}") if base else None, _rounds(spark, schema, root, "added", base + 1 if base else 0, number)) if x]
    queue = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
    kind = next(f.dataType.simpleString() for f in schema.fields if f.name == key)
    done = _rounds(spark, f"`{key}` {kind}", root, "done", base + 1 if base else 0, number if with_done else number - 1)
    return queue.join(done, key, "left_anti").select(*queue.columns) if done else queue


def process_periodically(
    captures: DataFrame, root: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], batch: int = BATCH, order: Sequence[str] = ("priority", "message_id"), key: str = "message_id", keep: int = KEEP
) -> DataStreamWriter:
    """Rounds of a queue. Each adds what came in, takes the ``batch`` most urgent captures that wait, and writes what ``process``
    makes of them to ``root/done``; ``process`` gets the columns of ``captures`` and keeps ``key``.

    The stream is joined by a clock, so there is a round at every trigger (start it with one of :data:`EVERY`) until nothing waits,
    whether or not anything comes in. State is a log of rounds: what each added and processed, and every ``keep`` rounds a
    snapshot of what waits, so a round reads a bounded number of paths and writes the whole queue only then. Every
    folder is named by its round and overwritten as a whole, and a round reads only earlier ones and its own input: a
    round that is repeated after a failure gives the same again. Folders older than the last snapshot but one are
    never read again. Captures without a key are left out; those that repeat a key are one piece of work.
    """
    schema = captures.schema

    def round_(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.where(F.col(_TICK).isNull() & F.col(key).isNotNull()).drop(_TICK).write.mode("overwrite").parquet(f"{root}/added/round={number}")
        taken = waiting(spark, schema, root, number, key, keep).orderBy(*order).limit(batch)
        process(taken).write.mode("overwrite").parquet(f"{root}/done/round={number}")
        if number and number % keep == 0:
            waiting(spark, schema, root, number, key, keep, with_done=True).write.mode("overwrite").parquet(f"{root}/waiting/round={number}")

    ticking = captures.withColumn(_TICK, F.lit(None).cast("boolean")).unionByName(clock(captures.sparkSession), allowMissingColumns=True)
    return ticking.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)


def drain(spark: SparkSession, query: StreamingQuery, root: str, schema, key: str = "message_id", keep: int = KEEP, most_seconds: float = 600) -> int:
    """Let the rounds go on until nothing waits, then stop; returns how many rounds have been finished.

    The first round of a run may have been planned before it, so at least one more is waited for.
    """
    until, finished, first = time.time() + most_seconds, -1, None
    while query.isActive and time.time() < until:
        query.awaitTermination(1)
        last = query.lastProgress
        finished = last["batchId"] if last and last["numInputRows"] else -1
        first = finished if first is None and finished >= 0 else first
        if first is not None and finished > first and waiting(spark, schema, root, finished, key, keep, with_done=True).isEmpty():
            break
    query.stop()
    if query.exception():
        raise query.exception()
    return finished + 1
