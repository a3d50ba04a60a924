"""Queries over captures: routing, limits, context, images, and posts of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import archive as A, messages as M, routing as R
from ..operators import catalog as C, metered
from ..sources.sinks import shared_folder
from ..sources.standins import MESSAGES_SQL, STATE_SQL, capture_events, messages, read
from .registry import query

MSG, S = f"WITH {MESSAGES_SQL}", f"WITH {STATE_SQL}"
NEXT = f"{MSG}, nxt AS (SELECT message_id AS image_id, chat_id, ts, kind, min(CASE WHEN kind IN ('text', 'captioned') THEN r END) OVER (PARTITION BY chat_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tr FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS r FROM messages)), ids AS (SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS r FROM messages), img AS (SELECT image_id, nxt.chat_id, ts, ids.message_id AS text_id FROM nxt LEFT JOIN ids ON nxt.chat_id = ids.chat_id AND tr = r WHERE kind = 'photo')"


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 23:59:59'")
def filter_date_range(s, d):
    """Every ninth event has no time and is kept."""
    at = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp_ntz"))
    first, last = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-10 23:59:59"))
    return read(s, d, "events").where(R.in_range(at, first, last, keep_null=True)).select("event_id")


def captures(s: SparkSession, d: str) -> DataFrame:
    """Events as captures: some with documents, images or both, some sources with or without a url."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.concat(F.lit("documents/"), i.cast("string"), F.when(i % 3 == 0, ".PDF").when(i % 3 == 1, ".txt").otherwise(".pdf"))
    return read(s, d, "events").select(
        "event_id", F.when(kind == "signup", F.array(name, F.lit("b.pdf"))).alias("documents"), F.when((kind == "view") | (kind == "signup") & (i % 2 == 0), F.array(F.lit("a.jpg"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(kind.isin("click", "view"), "Source").otherwise("Thought").alias("type"), F.when(i % 2 == 0, F.concat(F.lit("see https://a.b/"), i.cast("string"))).otherwise("nothing").alias("body"), (i % 40 * 1_000_000).alias("size"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'pdf' WHEN 'view' THEN 'image' WHEN 'click' THEN 'source' ELSE 'text' END AS kind, CASE event_type WHEN 'signup' THEN 'pdf' WHEN 'view' THEN 'image' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'text' END ELSE 'text' END AS route FROM events")
def route_capture_kind(s, d):
    kind = R.capture_kind(F.col("documents"), F.col("images"), F.col("type"))
    return captures(s, d).select("event_id", kind.alias("kind"), R.source_route(kind, F.col("body")).alias("route"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 1 THEN 'text' ELSE 'pdf' END END AS route FROM events")
def route_document(s, d):
    return captures(s, d).select("event_id", R.document_route(F.col("documents")).alias("route"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'type' WHEN event_id % 40 > 20 THEN 'size' END AS reason FROM events WHERE event_type = 'signup'")
def filter_processable(s, d):
    return captures(s, d).where("documents is not null").select("event_id", R.unprocessable(F.get("documents", F.lit(0)), F.col("size")).alias("reason"))


@query("SELECT page_id, CASE WHEN page_id % 4 >= 2 THEN 'type' WHEN page_id % 5 = 0 THEN 'size' END AS reason FROM pages")
def filter_content_type(s, d):
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "Text/HTML; charset=utf-8").when(k == 1, "application/xhtml+xml").when(k == 2, "application/pdf")
    size = F.length("html") + F.when(F.col("page_id") % 5 == 0, R.MAX_PAGE_BYTES).otherwise(0)
    return read(s, d, "pages").select("page_id", R.refused_content(kind, size).alias("reason"))


@query("SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN turn % 2 = 0 THEN 'Mood: calm' END, CASE WHEN conv_id % 3 = 0 THEN 'Energy: low' END, CASE WHEN role = 'user' THEN 'Context: user' END) AS lines FROM conversations")
def context_fields(s, d):
    values = {"context": F.when(F.col("role") == "user", F.col("role")), "energy": F.when(F.col("conv_id") % 3 == 0, "low").otherwise(""), "mood": F.when(F.col("turn") % 2 == 0, "calm"), "surface": F.lit("")}
    return read(s, d, "conversations").select("conv_id", "turn", R.context_lines(values).alias("lines"))


@query("SELECT page_id, CASE WHEN url IS NULL THEN 'No context provided by user.' WHEN page_id % 2 = 0 THEN 'why: ' || page_id ELSE 'No context provided by user.' END AS about_url, CASE WHEN page_id % 3 = 0 THEN 'read ' || page_id ELSE 'No context provided by user.' END AS about_document FROM pages")
def user_context(s, d):
    i = F.col("page_id").cast("string")
    body = F.concat(F.lit(" "), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("why: "), i, F.lit(" "))).otherwise(""), "url", F.lit("\n"))
    sent = F.concat(F.lit("PDF: a.pdf"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\nread "), i)).otherwise(" "))
    return read(s, d, "pages").select("page_id", R.url_context(body, F.col("url")).alias("about_url"), R.document_context(sent, F.lit("a.pdf")).alias("about_document"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 80000 THEN left(text, 80000) || chr(10) || chr(10) || '[Content truncated - original was significantly longer]' ELSE text END) AS text_md5, length(text) > 80000 AS cut FROM documents")
def truncate_content(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(R.truncated(F.col("text"))).alias("text_md5"), (F.length("text") > R.MAX_CHARS).alias("cut"))


@query(f"{NEXT} SELECT text_id AS capture_id, string_agg(image_id::VARCHAR, ',' ORDER BY ts, image_id) AS images FROM img WHERE text_id IS NOT NULL GROUP BY text_id")
def capture_images(s, d):
    """The images of each capture by time; those between two texts of one chat, so a group is short."""
    found = C.next_text(messages(s, d)).where("text_id is not null").join(messages(s, d).select(F.col("message_id").alias("image_id"), "ts"), "image_id")
    listed = F.array_sort(F.collect_list(F.struct("ts", "image_id")))
    return found.groupBy(F.col("text_id").alias("capture_id")).agg(F.array_join(F.transform(listed, lambda x: x["image_id"].cast("string")), ",").alias("images"))


@query(f"{NEXT} SELECT image_id, CASE WHEN text_id IS NULL THEN 'pending' ELSE 'associated' END AS status, text_id AS capture_id FROM img")
def associate_images(s, d):
    return C.next_text(messages(s, d)).select("image_id", F.when(F.col("text_id").isNull(), "pending").otherwise("associated").alias("status"), F.col("text_id").alias("capture_id"))


@query(f"{NEXT} SELECT chat_id, image_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts, image_id)::INT AS place FROM img WHERE text_id IS NULL")
def pending_images_for_chat(s, d):
    """What waits in each chat, by time."""
    waiting = C.next_text(messages(s, d)).where("text_id is null").join(messages(s, d).select(F.col("message_id").alias("image_id"), "ts"), "image_id")
    return waiting.select("chat_id", "image_id", F.row_number().over(Window.partitionBy("chat_id").orderBy("ts", "image_id")).alias("place"))


@query("SELECT CASE turn % 3 WHEN 0 THEN 'Idea' WHEN 1 THEN 'Quote' ELSE 'Thought' END AS type, count(*) AS n FROM conversations GROUP BY ALL")
def note_type_counts(s, d):
    said = F.concat(F.when(F.col("turn") % 3 == 0, "idea: ").when(F.col("turn") % 3 == 1, "QUOTE:").otherwise("about "), F.coalesce("text", F.lit("")))
    return read(s, d, "conversations").groupBy(M.message_type(said).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{S} SELECT count(*) AS n, count(*) FILTER (status = 'done') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'written') AS recovered, count(DISTINCT output_file) AS files, count(DISTINCT kind) AS kinds FROM state")
def batch_summary(s, d):
    """As the write of the batch observed it."""
    state = C.current_state(capture_events(s, d)).join(messages(s, d), F.col("capture_id") == F.col("message_id"))
    path = shared_folder(s, "batch")
    found = metered.process_batch(state, lambda rows: rows.select("capture_id", "status", "output_file", "kind"), path)
    return s.read.parquet(path).limit(1).select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()])


def posts(s: SparkSession, d: str) -> DataFrame:
    """``event_id, post``: events as archived posts read back from JSON, with links, tags, media and replies."""
    i = F.col("event_id")
    t = lambda c: c.cast("string")
    url = F.struct(F.concat(F.lit("https://t.co/"), t(i)).alias("url"), F.when(i % 3 != 0, F.concat(F.lit("https://x.y/"), t(i))).alias("expanded_url"))
    media = lambda name: F.array(F.struct(F.when(i % 5 != 0, "video").alias("type"), F.concat(F.lit(f"http://{name}/"), t(i)).alias("media_url"), F.when(i % 7 == 0, F.concat(F.lit(f"https://{name}/"), t(i))).alias("media_url_https")))
    none = F.lit(None)
    entities = F.struct(
        F.array(F.struct(F.col("event_type").alias("text"))).alias("hashtags"), F.when(i % 4 == 0, F.array(F.struct(F.concat(F.lit("u"), t(F.col("user_id"))).alias("screen_name")))).alias("user_mentions"),
        F.when(i % 2 == 0, F.array(url)).alias("urls"), F.when(i % 3 == 0, media("plain")).alias("media"))
    at = F.when(i % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")).when(i % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 5 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i % 5 == 3, "soon").otherwise(F.concat(F.lit("Sat "), F.date_format("ts", "MMM dd HH:mm:ss '-0500' yyyy")))
    text = F.concat(F.when(i % 6 == 0, "RT @a: ").otherwise(""), "event_type")
    fields = F.struct(F.when(i % 2 == 0, t(i)).alias("id_str"), F.when(i % 2 == 1, t(i)).alias("id"), F.when(i % 2 == 0, text).alias("full_text"), F.when(i % 2 == 1, text).alias("text"), at.alias("created_at"),
                      F.when(F.col("event_type") == "click", "9").alias("in_reply_to_status_id"), F.when(F.col("event_type") == "click", F.concat(F.lit("u"), t(F.col("user_id")))).alias("in_reply_to_screen_name"), entities.alias("entities"),
                      F.when(i % 4 == 1, F.struct(media("more").alias("media"))).otherwise(none).alias("extended_entities"))
    return read(s, d, "events").select("event_id", F.from_json(F.to_json(fields), A.POST).alias("post"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def parse_tweet_date(s, d):
    return posts(s, d).select("event_id", F.date_format(A.post_date(F.col("post.created_at")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate::DATE END AS day FROM orders")
def parse_cli_date(s, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    typed = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, F.date_format(day, "dd-MM-yyyy")).when(k == 3, F.date_format(day, "dd/MM/yyyy")).otherwise("tomorrow")
    return read(s, d, "orders").select("o_orderkey", A.typed_day(typed).alias("day"))


_MEDIA = "CASE WHEN event_id % 4 = 1 THEN 'more' WHEN event_id % 3 = 0 THEN 'plain' END"
_URL = f"CASE WHEN event_id % 7 = 0 THEN 'https://' ELSE 'http://' END || {_MEDIA} || '/' || event_id"
_TYPE = "CASE WHEN event_id % 5 <> 0 THEN 'video' ELSE 'photo' END"


@query(f"SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'RT @a: ' ELSE '' END || event_type || CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN chr(10) || chr(10) || 'Links:' || chr(10) || '- https://x.y/' || event_id ELSE '' END || coalesce(chr(10) || chr(10) || 'Media:' || chr(10) || '- [' || {_TYPE} || '] ' || {_URL}, '') AS body FROM events")
def format_tweet_body(s, d):
    return posts(s, d).select("event_id", A.post_body(F.col("post")).alias("body"))


@query(f"SELECT event_id, {_TYPE} AS type, {_URL} AS url FROM events WHERE event_id % 4 = 1 OR event_id % 3 = 0")
def tweet_attachments(s, d):
    return posts(s, d).select("event_id", F.explode(A.attachments(F.col("post"))).alias("a")).select("event_id", "a.type", "a.url")


@query("SELECT event_id::VARCHAR AS tweet_id, event_id % 6 = 0 AS is_retweet, event_type = 'click' AS is_reply, CASE WHEN event_type = 'click' THEN 'u' || user_id END AS reply_to, event_type AS hashtags, CASE WHEN event_id % 4 = 0 THEN 'u' || user_id ELSE '' END AS mentions, CASE WHEN event_id % 2 = 1 THEN '' WHEN event_id % 3 <> 0 THEN 'https://x.y/' || event_id ELSE 'https://t.co/' || event_id END AS urls FROM events")
def parse_tweet_fields(s, d):
    f = A.post_fields(F.col("post"))
    listed = [F.array_join(f[c], ",").alias(c) for c in ("hashtags", "mentions", "urls")]
    return posts(s, d).select(*[f[c].alias(c) for c in ("tweet_id", "is_retweet", "is_reply", "reply_to")], *listed)


@query("SELECT event_id::VARCHAR AS tweet_id, CASE WHEN event_id % 20 = 0 THEN 'a' ELSE 'b' END AS path FROM events")
def tweets_first_per_id(s, d):
    """The first row of each id by path; every twentieth post comes twice."""
    b = posts(s, d).select(A.post_id(F.col("post")).alias("tweet_id"), F.lit("b").alias("path"))
    both = b.unionByName(b.where("cast(tweet_id as long) % 20 = 0").withColumn("path", F.lit("a")))
    return both.withColumn("i", F.row_number().over(Window.partitionBy("tweet_id").orderBy("path"))).where("i = 1").drop("i")
