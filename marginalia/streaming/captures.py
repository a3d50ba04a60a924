"""Chat updates as a stream: resumable reading, dedup by message id, admission, an exactly-once sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import messages as M
from ..operators.catalog import admit

UPDATES = "message_id long, chat_id long, ts timestamp, kind string, text string"


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Updates as JSON files of a folder; what was read is kept in the checkpoint of the query that reads it."""
    return spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def dedup_messages(updates: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of each message id; ids are forgotten once the watermark has passed them."""
    return updates.withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_id"])


def ingest(updates: DataFrame, longest: int = 100_000) -> DataFrame:
    """Texts as captures: type, mood, body, and the reason where one is refused; no state."""
    lines = M.message_lines(F.col("text"))
    body = M.message_body(lines)
    return updates.where("kind in ('text', 'captioned')").select(
        "message_id", "chat_id", "ts", M.message_type(F.col("text")).alias("type"), M.message_field(lines, "mood").alias("mood"), body.alias("body"), admit(body, longest).alias("reason"))


def write_once(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to a Parquet folder, exactly once through its commit log; start it with a trigger of five minutes, or ``availableNow``."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
