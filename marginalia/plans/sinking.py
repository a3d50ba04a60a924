"""Queries that write tables derived from the given ones through the sinks and streams, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import pages as P
from ..functions.routing import capture_kind
from ..operators import catalog as C, condense
from ..sources import files, sinks
from ..sources.standins import MESSAGES_SQL, NOTES_SQL, messages, note_files, read
from ..streaming import captures, images, queue
from .analysis import A, analyses
from .capturing import NEXT
from .registry import query
from .runs import MANIFEST_SQL, flat, manifests
from .vault import document_pages

N, MSG = f"WITH {NOTES_SQL}", f"WITH {MESSAGES_SQL}"


@query(f"{N} SELECT stem, CASE WHEN source = 'src0' THEN 'reflections' ELSE 'notes' END AS folder, created AS day FROM notes")
def write_notes(s, d):
    f = note_files(s, d)
    folder = F.when(F.col("source") == "src0", "reflections").otherwise("notes")
    out = sinks.shared_folder(s, "notes")
    sinks.write_notes(f.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), folder.alias("folder"), F.col("created").cast("string").alias("capture_date"), "content"), out)
    kept = s.read.schema("stem string, content string, folder string, capture_date string").parquet(out)
    return kept.select("stem", "folder", F.col("capture_date").cast("date").alias("day"))


@query("SELECT page_id::VARCHAR AS stem, md5(html) AS html_md5, md5('<!-- source: ' || coalesce(url, 'unknown') || ' -->' || chr(10) || chr(10) || coalesce(html, '')) AS text_md5 FROM pages")
def write_page_artifacts(s, d):
    out = sinks.shared_folder(s, "artifacts")
    rows = read(s, d, "pages").select(F.col("page_id").cast("string").alias("stem"), F.lit("2024-01-01").alias("capture_date"), "html", "url", F.col("html").alias("markdown_content"))
    sinks.write_page_artifacts(rows, out)
    kept = s.read.schema("stem string, html string, extracted string, capture_date string").parquet(out)
    return kept.select("stem", F.md5("html").alias("html_md5"), F.md5("extracted").alias("text_md5"))


@query("SELECT doc_id // 23 AS run_id, count(*) AS n, count(*) FILTER (doc_id % 5 = 0) AS low, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents GROUP BY 1")
def write_analysis_results(s, d):
    out = sinks.shared_folder(s, "results")
    rows = analyses(s, d).withColumn("phase", F.lit("all"))
    sinks.write_analysis_results(rows.withColumn("run_id", F.col("run_id").cast("string")), out)
    kept = s.read.schema("frontmatter string, content string, run_id long, phase string").parquet(out)
    low = F.get_json_object("frontmatter", "$.confidence") == "low"
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low"), F.sum(F.length("content").cast("long")).alias("n_chars"))


@query(f"{A} SELECT run_id, category, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5 FROM analyses JOIN defs USING (i) GROUP BY ALL")
def write_category_summaries(s, d):
    out = sinks.shared_folder(s, "summaries")
    sinks.write_category_summaries(condense.gather_sources(analyses(s, d), condense.category_defs(s)), out)
    kept = s.read.schema("frontmatter string, content string, run_id long").parquet(out)
    return kept.select("run_id", F.get_json_object("frontmatter", "$.category").alias("category"), F.md5("content").alias("content_md5"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' ELSE 'too long' END AS reason FROM conversations WHERE text IS NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR length(text) > 100")
def write_rejects(s, d):
    """The refused rows with their reason."""
    out = sinks.shared_folder(s, "rejects")
    sinks.write_rejects(read(s, d, "conversations").withColumn("reason", C.admit(F.col("text"), 100)), out)
    return s.read.parquet(out).select("conv_id", "turn", "reason")


@query(MANIFEST_SQL)
def write_manifest(s, d):
    """The manifest of the corpus, written as JSON and read back."""
    out, made = sinks.shared_folder(s, "manifest"), manifests(s, d)
    sinks.write_run_manifests(made, out)
    return flat(s.read.schema(made.schema).json(out))


@query(f"{MSG} SELECT chat_id, count(*) AS n FROM messages WHERE kind = 'photo' GROUP BY chat_id")
def append_pending_images(s, d):
    """Two appends, of odd and even ids."""
    out = sinks.shared_folder(s, "pending")
    photos = messages(s, d).where("kind = 'photo'").select("message_id", "chat_id", F.lit("a.jpg").alias("file_path"), F.col("ts").alias("captured_at"))
    for k in (0, 1):
        sinks.append_pending_images(photos.where(F.col("message_id") % 2 == k), out)
    return s.read.parquet(out).where("status = 'pending'").groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'image' ELSE 'text' END AS kind FROM events")
def scan_captures(s, d):
    """A queue written before some of its columns came into being."""
    out = sinks.shared_folder(s, "queue")
    read(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.when(F.col("event_type") == "view", F.array(F.lit("a.jpg"))).alias("image_paths")).write.parquet(out)
    return files.scan_captures(s, out).select("id", capture_kind(F.col("document_paths"), F.col("image_paths"), F.col("type")).alias("kind"))


@query("SELECT doc_id::VARCHAR AS doc, greatest(1, ceil(length(text) / 2000.0::DOUBLE))::BIGINT AS pages, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL")
def scan_document_pages(s, d):
    out = sinks.shared_folder(s, "pages")
    document_pages(s, d).withColumn("doc", F.col("doc").cast("string")).write.parquet(out)
    return files.scan_document_pages(s, out).groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("page_text").cast("long")).alias("n_chars"))


@query("SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def scan_pages(s, d):
    return read(s, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query()
def page_main_content(s, d):
    """The html of each page's main content and the container that holds it; tested on pages by hand."""
    return P.page_main_content(read(s, d, "pages")).select("page_id", "container", "main_html", "error")


def updates(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream of chat updates."""
    rows = s.readStream.schema(read(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "purchase", "captioned").when(F.col("event_type") == "click", "text").otherwise("command")
    return rows.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_type").alias("text"))


def drained(s: SparkSession, rows: DataFrame, name: str, times: int = 1) -> DataFrame:
    """The stream read until nothing is left, ``times`` over one checkpoint, and what its sink then holds."""
    out, marks = sinks.shared_folder(s, name), sinks.shared_folder(s, f"{name}-checkpoint")
    for _ in range(times):
        captures.write_once(rows, out, marks).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


@query("SELECT event_id AS message_id, user_id AS chat_id FROM events")
def stream_dedup_messages(s, d):
    """Every update comes twice and is kept once."""
    twice = updates(s, d).union(updates(s, d))
    return drained(s, captures.dedup_messages(twice, "40 days"), "once").select("message_id", "chat_id")


@query(f"{NEXT} SELECT image_id, chat_id, text_id FROM img JOIN (SELECT message_id, ts AS text_ts FROM messages) ON message_id = text_id, (SELECT epoch_ms(max(ts)) - 600000 AS passed FROM messages WHERE kind IN ('photo', 'text', 'captioned')) WHERE (epoch_ms(text_ts) // 60000 + 1) * 60000 <= passed")
def stream_image_association(s, d):
    """The images that found a text whose minute the watermark, ten minutes behind the last message, has passed."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, images.ROCKSDB)
    try:
        return drained(s, images.associate_images(updates(s, d), "40 days", "10 minutes"), "associated").where("text_id is not null")
    finally:
        s.conf.set(key, before)


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL")
def stream_exactly_once_sink(s, d):
    """Run twice over one checkpoint: the second run resumes behind the first and adds nothing."""
    return drained(s, captures.ingest(updates(s, d)), "exactly", 2).groupBy(F.col("body").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{MSG}, q AS (SELECT message_id, kind, CASE WHEN kind IN ('photo', 'captioned') THEN 1 WHEN kind = 'command' THEN 3 ELSE 2 END AS priority FROM (SELECT message_id, CASE WHEN kind = 'document' THEN 'command' ELSE kind END AS kind FROM messages)) SELECT message_id, kind, ((row_number() OVER (ORDER BY priority, message_id) - 1) // ((SELECT count(*) FROM q) // 3 + 1))::INT AS round FROM q")
def stream_periodic_process(s, d):
    """All events come at once; rounds of a third of them go on by the clock until nothing waits."""
    root, marks = sinks.shared_folder(s, "rounds"), sinks.shared_folder(s, "rounds-checkpoint")
    rows = updates(s, d).withColumn("priority", C.priority(F.col("kind"), F.col("message_id")))
    third = read(s, d, "events").count() // 3 + 1
    running = queue.process_periodically(rows, root, marks, lambda q: q.select("message_id", "kind"), third, keep=2).trigger(processingTime="1 second").start()
    queue.drain(s, running, root, rows.schema, keep=2)
    return s.read.schema("message_id long, kind string, round int").parquet(f"{root}/done")
