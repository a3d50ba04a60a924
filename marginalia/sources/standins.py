"""Catalog tables derived from the star-schema and text tables, and the same derivations in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, doc_id, created`` : every document as a note in markdown."""
    d = read(spark, sf_dir, "documents")
    created = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    stem = lambda i, c: F.concat(c.cast("string"), F.lit("--note-"), i.cast("string"))
    before = F.when(F.col("doc_id") % 10 == 0, F.lit("2000-01-01--gone")).otherwise(stem(F.col("doc_id") - 1, F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("doc_id") - 1) % 365).cast("int"))))
    size = F.when(F.length("text") < 1000, "short").when(F.length("text") < 5000, "medium").otherwise("long")
    mood = F.when(F.col("doc_id") % 3 == 0, F.lit("mood: calm\n")).otherwise(F.lit(""))
    content = F.concat(
        F.lit("---\ncaptured_at: "), created.cast("string"), F.lit("\ntags: ["), "lang", F.lit("]\n"), mood, F.lit("---\n# Note "), F.col("doc_id").cast("string"), F.lit("\n\n## Raw Capture\n"), "text",
        F.lit("\n\n## Themes\n- "), "lang", F.lit("\n- "), "source", F.lit("\n- "), size, F.lit("\n\n## Related Hub Notes\n- [["), "lang", F.lit("]]\n- [["), "source", F.lit("|Source]]\n- [["), before, F.lit("]]\n"))
    return d.select(F.concat(F.lit("notes/"), stem(F.col("doc_id"), created), F.lit(".md")).alias("path"), content.alias("content"), "doc_id", created.alias("created"), "source", "lang", "text")


#: The columns that parsing must give back, straight from the documents.
NOTES_SQL = """notes AS (SELECT doc_id, lang, source, text, (DATE '2024-01-01' + (doc_id % 365)::INT)::DATE AS created,
 CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 5000 THEN 'medium' ELSE 'long' END AS size,
 strftime((DATE '2024-01-01' + (doc_id % 365)::INT), '%Y-%m-%d') || '--note-' || doc_id AS stem,
 CASE WHEN doc_id % 10 = 0 THEN '2000-01-01--gone' ELSE strftime((DATE '2024-01-01' + ((doc_id - 1) % 365)::INT), '%Y-%m-%d') || '--note-' || (doc_id - 1) END AS prev,
 CASE WHEN doc_id % 3 = 0 THEN 'calm' END AS mood, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS words FROM documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat updates from events: message_id, chat_id, ts, kind, k."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "purchase", "captioned").when(F.col("event_type") == "click", "text").when(F.col("event_type") == "signup", "document").otherwise("command")
    return e.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("chat_id"), "ts", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))


MESSAGES_SQL = """messages AS (SELECT event_id AS message_id, user_id AS chat_id, ts, CASE event_type WHEN 'view' THEN 'photo' WHEN 'purchase' THEN 'captioned' WHEN 'click' THEN 'text' WHEN 'signup' THEN 'document' ELSE 'command' END AS kind,
 json_extract_string(props, '$.k')::INT AS k FROM events)"""

# The statuses a capture goes through, by event_id modulo 7.
HISTORY = {0: ("pending", "processing", "written", "done"), 1: ("pending", "processing", "failed"), 2: ("pending", "processing", "written", "pending"), 3: ("pending", "processing", "written"), 4: ("pending", "processing"), 5: ("pending",), 6: ("pending", "processing", "failed", "pending")}


def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, capture_id, status, output_file, error_message: the append-only history of the queue."""
    m = messages(spark, sf_dir)
    steps = F.lit(None)
    for r, h in HISTORY.items():
        steps = F.when(F.col("message_id") % 7 == r, F.array(*map(F.lit, h))).otherwise(steps)
    rows = m.select(F.col("message_id").alias("capture_id"), F.posexplode(steps).alias("step", "status"))
    return rows.select((F.col("capture_id") * 10 + F.col("step")).alias("seq"), "capture_id", "status",
                       F.when(F.col("status") == "written", F.concat(F.lit("notes/"), F.col("capture_id").cast("string"), F.lit(".md"))).alias("output_file"),
                       F.when(F.col("status") == "failed", F.lit("output validation failed")).alias("error_message"))


_LAST = " ".join(f"WHEN {r} THEN '{h[-1]}'" for r, h in HISTORY.items())
STATE_SQL = f"""{MESSAGES_SQL}, state AS (SELECT message_id AS capture_id, CASE message_id % 7 {_LAST} END AS status,
 CASE WHEN message_id % 7 IN (0, 3) THEN 'notes/' || message_id || '.md' END AS output_file, CASE WHEN message_id % 7 = 1 THEN 'output validation failed' END AS error_message, chat_id, ts, kind, k FROM messages)"""
