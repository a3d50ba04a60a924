"""The registered catalog queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..operators import catalog as C, condense, hosts as H, metered, profile, search, words as X
from ..operators.order import earlier_in_group, row_index, stable
from ..sources import files
from ..sources.sinks import shared_folder
from ..sources.standins import MESSAGES_SQL, NOTES_SQL, STATE_SQL, capture_events, messages, note_files, read
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def notes(s, d):
    return C.parse_notes(note_files(s, d))


def hubs(s, d):
    """Hubs: the languages and the sources."""
    t = read(s, d, "documents")
    return t.select(F.col("lang").alias("name")).union(t.select("source")).where("name is not null").distinct()


N, M, S = f"WITH {NOTES_SQL}", f"WITH {MESSAGES_SQL}", f"WITH {STATE_SQL}"
CONCEPTS = f"{N}, concepts AS (SELECT stem, lang AS concept FROM notes UNION SELECT stem, source FROM notes UNION SELECT stem, size FROM notes)"


@query(f"{N} SELECT 'notes/' || stem || '.md' AS path, 'Note ' || doc_id AS title, lang || ',' || source || ',' || size AS themes, lang AS tags, lang || ',' || source || ',' || prev AS hub_links, mood, created AS created_at FROM notes")
def parse_note(s, d):
    joined = [F.concat_ws(",", c).alias(c) for c in ("themes", "tags", "hub_links")]
    return notes(s, d).select("path", "title", *joined, "mood", "created_at")


@query(f"{N} SELECT stem, md5(trim(text, ' \n\t\r')) AS raw_md5 FROM notes")
def extract_section(s, d):
    return notes(s, d).select("stem", F.md5("raw_capture").alias("raw_md5"))


@query(f"{N} SELECT stem, words AS word_count, floor(words * 1.3::DOUBLE)::INT AS token_estimate FROM notes")
def token_estimate(s, d):
    return notes(s, d).select("stem", "word_count", "token_estimate")


@query(f"{N} SELECT source, sum(floor(words * 1.3::DOUBLE)::INT)::BIGINT AS tokens, count(*) AS n FROM notes GROUP BY ROLLUP (source)")
def corpus_token_totals(s, d):
    f = note_files(s, d)
    words = T.word_count(F.col("text"))
    return f.select("source", T.token_estimate(words).alias("t")).rollup("source").agg(F.sum("t").alias("tokens"), n())


@query(f"{N} SELECT min(created) AS first_day, max(created) AS last_day, count(*) AS n FROM notes")
def date_range(s, d):
    return notes(s, d).agg(F.min("created_at").alias("first_day"), F.max("created_at").alias("last_day"), n())


@query(f"{N} SELECT stem AS src, unnest([lang, source, prev]) AS dst FROM notes")
def extract_wikilinks(s, d):
    return C.links(notes(s, d))


@query(f"{N} SELECT stem AS src, prev AS dst FROM notes WHERE prev NOT IN (SELECT stem FROM notes)")
def validate_links(s, d):
    return C.broken_links(notes(s, d), hubs(s, d))


@query(f"{N} SELECT dst AS hub, count(*) AS n_links FROM (SELECT unnest([lang, source]) AS dst FROM notes) GROUP BY dst")
def hub_connectivity(s, d):
    known = hubs(s, d).withColumnRenamed("name", "dst")
    return C.links(notes(s, d)).join(known, "dst", "left_semi").groupBy(F.col("dst").alias("hub")).agg(n("n_links"))


@query(f"{CONCEPTS} SELECT concept, n_notes, stem FROM (SELECT concept, stem, count(*) OVER (PARTITION BY concept) AS n_notes FROM concepts WHERE concept NOT IN (SELECT lang FROM documents UNION SELECT source FROM documents)) WHERE n_notes >= 3")
def hub_suggestions(s, d):
    return C.hub_suggestions(notes(s, d), hubs(s, d))


@query(f"{CONCEPTS} SELECT concept AS theme, count(*) AS n_notes, round(count(*)::DOUBLE / (SELECT count(*) FROM notes), 6) AS share, rank() OVER (ORDER BY count(*) DESC)::INT AS place, array_to_string(list_sort(list(stem))[1:3], ',') AS examples FROM concepts GROUP BY concept")
def theme_frequency(s, d):
    return C.theme_frequency(notes(s, d))


@query(f"{N}, t AS (SELECT DISTINCT stem, unnest([lang, source, size]) AS x FROM notes), c AS (SELECT x, count(*) AS n FROM t GROUP BY x), p AS (SELECT p.x AS a, q.x AS b, count(*) AS n_notes FROM t p JOIN t q ON p.stem = q.stem AND p.x < q.x GROUP BY ALL) SELECT a, b, n_notes, round(n_notes::DOUBLE * (SELECT count(*) FROM notes) / (ca.n::DOUBLE * cb.n), 6) AS lift FROM p JOIN c ca ON ca.x = a JOIN c cb ON cb.x = b")
def theme_cooccurrence(s, d):
    return C.theme_lift(notes(s, d))


@query(f"{N}, t AS (SELECT date_trunc('month', created)::DATE AS month, unnest([lang, source, size]) AS theme FROM notes), c AS (SELECT theme, month, count(*) AS n_notes FROM t GROUP BY ALL) SELECT theme, month, n_notes, round(n_notes::DOUBLE / (SELECT count(*) FROM notes WHERE date_trunc('month', created) = month), 6) AS share, n_notes - lag(n_notes) OVER (PARTITION BY theme ORDER BY month) AS change FROM c")
def theme_trend(s, d):
    """By month, the notes of a theme, their share of the month's notes, and the change from the theme's month before."""
    every = F.concat(F.array(F.lit(None).cast("string")), "themes")  # the row without a theme counts the note
    counts = stable(notes(s, d).select(F.trunc("created_at", "month").alias("month"), F.explode(every).alias("theme")).groupBy("theme", "month").agg(n("n_notes")))
    months = counts.where("theme is null").select("month", F.col("n_notes").alias("all_notes"))
    counted = counts.where("theme is not null")
    changed = counted.withColumn("change", F.col("n_notes") - F.lag("n_notes").over(Window.partitionBy("theme").orderBy("month")))
    return changed.join(months, "month").select("theme", "month", "n_notes", F.round(F.col("n_notes") / F.col("all_notes"), 6).alias("share"), "change")


@query(f"{N}, m AS (SELECT mood, unnest(['weekday', 'month']) AS unit, unnest([dayofweek(created)::INT + 1, month(created)::INT]) AS slot FROM notes WHERE mood IS NOT NULL) SELECT mood, unit, slot, count(*) AS n FROM m GROUP BY ALL")
def mood_cycle(s, d):
    """By weekday and by month, counted in one pass."""
    slots = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), f("created_at").alias("slot")) for u, f in (("weekday", F.dayofweek), ("month", F.month))])).alias("t")
    return notes(s, d).where("mood is not null").select("mood", slots).groupBy("mood", "t.unit", "t.slot").agg(n())


@query(f"{N}, c AS (SELECT created, count(mood) AS moods, count(*) AS n FROM notes GROUP BY created) SELECT created AS day, moods, round(avg(moods::DOUBLE / n) OVER (ORDER BY created RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS rolling FROM c")
def mood_rolling(s, d):
    """By day, the notes with a mood and the mean share of them over seven days; one row a day is all that the window sees."""
    days = notes(s, d).groupBy(F.col("created_at").alias("day")).agg(F.count("mood").alias("moods"), n())
    week = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.select("day", "moods", F.round(F.avg(F.col("moods") / F.col("n")).over(week), 6).alias("rolling"))


@query("WITH c AS (SELECT hour(ts)::INT AS hour, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT hour, event_type, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c")
def activity_by_hour(s, d):
    """Messages by hour of the day, and the hour's share of its kind."""
    counted = read(s, d, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(n())
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


@query(f"{N}, d AS (SELECT created - CASE WHEN doc_id % 365 % 30 >= 15 THEN 15 ELSE 0 END AS created, count(*) AS c FROM notes GROUP BY ALL), g AS (SELECT *, CASE WHEN created - lag(created) OVER (ORDER BY created) < 7 THEN 0 ELSE 1 END AS new FROM d), p AS (SELECT *, sum(new) OVER (ORDER BY created) AS phase FROM g) SELECT min(created) AS first_day, max(created) AS last_day, sum(c)::BIGINT AS n_notes FROM p GROUP BY phase")
def growth_phases(s, d):
    """The second half of every thirty days is moved to the first, so that there are gaps to find."""
    moved = F.date_sub("created", F.when(F.col("doc_id") % 365 % 30 >= 15, 15).otherwise(0))
    return C.growth_phases(note_files(s, d).select(moved.alias("created_at")))


@query(f"WITH g AS (SELECT source, count(*) AS n, {' + '.join(f'bool_or(contains(lower(text), {chr(39)}{h}{chr(39)}))::INT' for h in condense.HEDGES)} AS hedges FROM documents GROUP BY source) SELECT source, n, CASE WHEN n < 10 OR n < 50 OR hedges >= 3 THEN 'low' WHEN n < 200 OR hedges >= 1 THEN 'medium' ELSE 'high' END AS level, CASE WHEN n < 10 THEN 'very few notes' WHEN n < 50 THEN 'few notes' WHEN n < 200 THEN 'some notes' END AS warning FROM g")
def confidence_level(s, d):
    """By source: how far its notes carry an analysis, by their number and the hedging phrases in them, and the warning that goes with so few."""
    return condense.confidence_by(read(s, d, "documents"), "source", "text")


@query(f"{N}, r AS (SELECT stem, row_number() OVER (ORDER BY created, stem) - 1 AS i, count(*) OVER () AS n FROM notes), k AS (SELECT (j * (SELECT count(*) FROM notes)) // 100 AS i FROM range(100) t(j)) SELECT stem FROM r WHERE i IN (SELECT i FROM k)")
def stratified_select(s, d):
    return C.stratified_select(notes(s, d).select("stem", "created_at"), 100, "created_at", "stem").select("stem")


@query(f"{N}, r AS (SELECT stem, row_number() OVER (ORDER BY created, stem) - 1 AS i, count(*) OVER () AS n FROM notes) SELECT stem, i < greatest(1, floor(n * 0.1)) OR i >= n - greatest(1, floor(n * 0.1)) AS is_edge FROM r")
def edge_decile_flag(s, d):
    return C.edge_flag(notes(s, d).select("stem", "created_at"), "created_at", "stem").select("stem", "is_edge")


@query(f"{N}, t AS (SELECT stem, created, floor(words * 1.3::DOUBLE)::BIGINT AS tokens FROM notes), k AS (SELECT sum(tokens) // 110000 + 1 AS k, count(*) AS n FROM t), r AS (SELECT stem, row_number() OVER (ORDER BY created, stem) - 1 AS i FROM t) SELECT stem, least(i // greatest(1, n // k), k - 1)::BIGINT AS chunk FROM r, k")
def multipass_chunks(s, d):
    rows = notes(s, d).select("stem", "created_at", "token_estimate")
    return C.multipass_chunks(rows, "token_estimate", 110_000, "created_at", "stem").select("stem", F.col("chunk").cast("long"))


@query(f"{N} SELECT stem, (sum(floor(words * 1.3::DOUBLE)::BIGINT) OVER (ORDER BY created, stem) // 110000)::BIGINT AS chunk FROM notes")
def token_budget_pack(s, d):
    rows = notes(s, d).select("stem", "created_at", "token_estimate")
    return C.token_budget_pack(rows, "token_estimate", 110_000, "created_at", "stem").select("stem", "chunk")


@query(f"{S} SELECT capture_id, status, output_file, error_message FROM state")
def current_capture_state(s, d):
    return C.current_state(capture_events(s, d))


@query(f"{S} SELECT status, count(*) AS n FROM state GROUP BY ROLLUP (status)")
def queue_stats(s, d):
    return C.current_state(capture_events(s, d)).rollup("status").agg(n())


@query(f"{S} SELECT capture_id, 'pending' AS status FROM state WHERE status = 'failed'")
def requeue_failed(s, d):
    return C.append_status(C.current_state(capture_events(s, d)), "failed", "pending")


@query(f"{S} SELECT capture_id, 'pending' AS status FROM state WHERE status = 'processing'")
def reset_stuck(s, d):
    return C.append_status(C.current_state(capture_events(s, d)), "processing", "pending")


@query(f"{S} SELECT capture_id, CASE WHEN kind IN ('photo', 'captioned') THEN 1 WHEN kind = 'command' THEN 3 ELSE 2 END AS priority FROM state WHERE status = 'pending' ORDER BY 2, ts, 1 LIMIT 500")
def pending_by_priority(s, d):
    state = C.current_state(capture_events(s, d)).where("status = 'pending'")
    rows = state.join(messages(s, d), F.col("capture_id") == F.col("message_id")).withColumn("priority", C.priority(F.col("kind"), F.col("k")))
    return rows.orderBy("priority", "ts", "capture_id").limit(500).select("capture_id", "priority")


@query(f"{S} SELECT status, capture_id, row_number() OVER (PARTITION BY status ORDER BY capture_id) - 1 AS place FROM state")
def captures_by_status(s, d):
    """Captures of each status in the order of their ids; the place comes from a global index, so a common status is no hot group."""
    placed = row_index(C.current_state(capture_events(s, d)).select("status", "capture_id"), "status", "capture_id", name="at")
    first = placed.groupBy("status").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "status").select("status", "capture_id", (F.col("at") - F.col("first")).alias("place"))


@query(f"{S} SELECT capture_id, status AS old, CASE WHEN capture_id % 2 = 0 THEN 'done' ELSE 'pending' END AS status FROM state WHERE status = 'written'")
def recover_written(s, d):
    """Written captures whose file exists (here: even ids) are done, the others pending again."""
    state = C.current_state(capture_events(s, d)).where("status = 'written'")
    there = messages(s, d).where("message_id % 2 = 0").select(F.concat(F.lit("notes/"), F.col("message_id").cast("string"), F.lit(".md")).alias("output_file"), F.lit(True).alias("there"))
    return state.join(there, "output_file", "left").select("capture_id", F.col("status").alias("old"), F.when(F.col("there"), "done").otherwise("pending").alias("status"))


@query(f"{M} SELECT CASE kind WHEN 'document' THEN 'sources' WHEN 'command' THEN 'inbox' ELSE 'notes' END AS folder, count(*) AS n FROM messages GROUP BY ALL")
def route_folder(s, d):
    return messages(s, d).groupBy(C.folder(F.col("kind")).alias("folder")).agg(n())


@query(f"{M} SELECT message_id, kind FROM messages WHERE chat_id = 7")
def filter_allowlist(s, d):
    return messages(s, d).where(F.col("chat_id") == 7).select("message_id", "kind")


@query(f"{M} SELECT a.message_id AS image_id, a.chat_id, (SELECT arg_min(b.message_id, (b.ts, b.message_id)) FROM messages b WHERE b.chat_id = a.chat_id AND b.kind IN ('text', 'captioned') AND (b.ts, b.message_id) > (a.ts, a.message_id)) AS text_id FROM messages a WHERE kind = 'photo'")
def next_text_for_image(s, d):
    return C.next_text(messages(s, d))


@query(f"{M} SELECT chat_id, count(*) FILTER (kind = 'photo') AS n FROM messages GROUP BY ALL")
def pending_image_count(s, d):
    return messages(s, d).groupBy("chat_id").agg(F.count_if(F.col("kind") == "photo").alias("n"))


@query(f"{M}, p AS (SELECT *, ts::DATE AS day, CASE WHEN k % 2 = 0 THEN '.jpg' ELSE '.png' END AS extension FROM messages WHERE kind = 'photo'), e AS (SELECT day, extension, max(message_id % 400) AS last FROM p WHERE message_id % 10 = 0 AND message_id % 30 <> 0 GROUP BY ALL) SELECT message_id, 'image-' || printf('%03d', coalesce(last, 0) + row_number() OVER (PARTITION BY day, extension ORDER BY ts, message_id)) || extension AS name FROM p LEFT JOIN e USING (day, extension) WHERE message_id % 10 <> 0")
def number_images(s, d):
    """Every tenth photo is there already, numbered by its id, some under other names."""
    rows = messages(s, d).where("kind = 'photo'").select("message_id", "ts", F.to_date("ts").alias("day"), F.when(F.col("k") % 2 == 0, ".jpg").otherwise(".png").alias("extension"))
    number = F.format_string("image-%03d", F.col("message_id") % 400)
    there = rows.where("message_id % 10 = 0").select("day", "extension", F.concat(F.when(F.col("message_id") % 30 == 0, "image-x").otherwise(number), "extension").alias("name"))
    return C.number_images(rows.where("message_id % 10 <> 0"), there).select("message_id", "name")


@query(f"{M} SELECT message_id, year(ts)::INT AS year FROM messages WHERE message_id % 20 <> 0")
def dedup_against_queue(s, d):
    """Messages not queued before; every twentieth was."""
    m = messages(s, d)
    return m.join(m.where("message_id % 20 = 0").select("message_id"), "message_id", "left_anti").select("message_id", F.year("ts").alias("year"))


def archive(s, d):
    """A social-media archive: one JSON object with a classic date for each event."""
    e = read(s, d, "events")
    made = F.date_format("ts", "MMM dd HH:mm:ss '+0000' yyyy")
    reply = F.when(F.col("event_type") == "click", F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")))
    body = F.to_json(F.struct(F.struct(F.col("event_id").cast("string").alias("id_str"), F.concat(F.lit("Mon "), made).alias("created_at"), F.concat(F.lit("saw "), "event_type", F.lit(" https://t.co/"), F.col("event_id").cast("string")).alias("full_text"), reply.alias("in_reply_to_screen_name")).alias("tweet")))
    return e.select(body.alias("json"))


def tweets(s, d):
    kind = "tweet struct<id_str:string,created_at:string,full_text:string,in_reply_to_screen_name:string>"
    t = archive(s, d).select(F.from_json("json", kind).alias("j")).select("j.tweet.*")
    dated = F.regexp_replace("created_at", r"^\w{3} (\w{3}) (\d{2}) (\S+) (\S+) (\d{4})$", "$5 $1 $2 $3 $4")
    return t.select(F.col("id_str").alias("tweet_id"), F.try_to_timestamp(dated, F.lit("yyyy MMM dd HH:mm:ss xx")).alias("created_at"), F.col("full_text").alias("text"), F.col("in_reply_to_screen_name").alias("reply_to"))


@query("SELECT event_id::VARCHAR AS tweet_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS created_at, 'saw ' || event_type AS bare, CASE WHEN event_type = 'click' THEN 'user' || (user_id % 10) END AS reply_to FROM events")
def scan_tweet_archive(s, d):
    """All events written as an export of several script files, and read back in byte ranges."""
    path, part = shared_folder(s, "export"), F.pmod(F.xxhash64("json"), F.lit(int(s.conf.get("spark.sql.shuffle.partitions"))))
    posts = archive(s, d).select(part.alias("part"), F.lit(1).alias("place"), F.concat("json", F.lit(",")).alias("line"))
    parts = posts.select("part").distinct()
    head = parts.select("part", F.lit(0).alias("place"), F.concat(F.lit("window.YTD.tweets.part"), F.col("part").cast("string"), F.lit(" = [")).alias("line"))
    foot = parts.select("part", F.lit(2).alias("place"), F.lit("];").alias("line"))
    posts.union(head).union(foot).repartition("part").sortWithinPartitions("part", "place").select("line").write.text(path)
    found = files.scan_archive(s, f"{path}/*.txt")
    return found.select("tweet_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), T.strip(T.strip_urls(F.col("text"))).alias("bare"), "reply_to")


@query("SELECT year(ts)::INT AS year, count(*) AS n FROM events GROUP BY ALL")
def tweets_by_year(s, d):
    return tweets(s, d).groupBy(F.year("created_at").alias("year")).agg(n()).orderBy("year")


@query("SELECT 'user' || (user_id % 10) AS reply_to, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL")
def mention_edges(s, d):
    return tweets(s, d).where("reply_to is not null").groupBy("reply_to").agg(n())


@query("SELECT event_id::VARCHAR AS tweet_id, 'https://t.co/' || event_id AS url FROM events")
def extract_first_url(s, d):
    return tweets(s, d).select("tweet_id", T.first_url(F.col("text")).alias("url"))


@query("SELECT event_id::VARCHAR AS tweet_id, CASE WHEN event_id % 20 = 0 THEN 'markdown' ELSE 'archive' END AS origin FROM events")
def union_tweets_distinct(s, d):
    """Markdown before archive; every twentieth tweet is in both."""
    a = tweets(s, d).select("tweet_id", F.lit("archive").alias("origin"), F.lit(1).alias("prio"))
    m = a.where(F.col("tweet_id").cast("long") % 20 == 0).select("tweet_id", F.lit("markdown").alias("origin"), F.lit(0).alias("prio"))
    return m.unionByName(a).groupBy("tweet_id").agg(F.min_by("origin", "prio").alias("origin"))


@query("SELECT count(*) AS total, count(*) FILTER (day(ts) > 10) AS added, count(*) FILTER (day(ts) <= 10) AS skipped, 0::BIGINT AS failed, count(*) AS queued FROM events")
def import_stats(s, d):
    """The archive of the first ten days is imported, then the whole archive, into one queue; what the second import observed."""
    path = shared_folder(s, "imported")
    whole = tweets(s, d).select("tweet_id", "created_at", "text")
    metered.import_posts(whole.where(F.dayofmonth("created_at") <= 10), None, path)
    queue = s.read.schema(whole.schema).parquet(path)
    found = metered.import_posts(whole, queue, path)
    return s.read.schema(whole.schema).parquet(path).agg(F.count(F.lit(1)).alias("queued")).select(*[F.lit(found[k]).cast("long").alias(k) for k in ("total", "added", "skipped", "failed")], "queued")


@query("SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS normal_md5 FROM documents")
def normalize_text(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal_md5"))


PAIRS_SQL = "SELECT doc_id, doc_id % 5 NOT IN (2, 3, 4) AS ok, CASE doc_id % 5 WHEN 2 THEN 'corruption' WHEN 3 THEN 'corruption' WHEN 4 THEN 'verbatim' END AS reason FROM documents"


def note_pairs(s, d):
    """Captured text and stored note: clean, fenced, with entities, with escapes, or rewritten, by doc_id modulo 5."""
    f = note_files(s, d)
    c, k = F.col("content"), F.col("doc_id") % 5
    spoiled = F.when(k == 1, F.concat(F.lit("```markdown\n"), c, F.lit("\n```"))).when(k == 2, F.concat(c, F.lit("&nbsp;"), c)).when(k == 3, F.concat(c, F.lit("\n\\[x\\]"))).when(k == 4, F.replace(c, F.col("text"), F.lit("something else")))
    return f.select("doc_id", F.col("text").alias("body"), F.coalesce(spoiled, c).alias("markdown"))


@query(PAIRS_SQL)
def validate_output(s, d):
    return C.validate(note_pairs(s, d))


@query(f"SELECT reason, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY ALL")
def corpus_quality_report(s, d):
    """How many notes fail which check."""
    return C.validate(note_pairs(s, d)).groupBy("reason").agg(n())


@query(f"WITH p AS ({PAIRS_SQL}) SELECT doc_id, 'lenient' AS mode, true AS ok, reason FROM p UNION ALL SELECT doc_id, 'off', true, NULL FROM p")
def validate_output_modes(s, d):
    """The same notes where a failed check is only noted, and where none is made."""
    return C.validate(note_pairs(s, d), "lenient").withColumn("mode", F.lit("lenient")).unionByName(C.validate(note_pairs(s, d), "off").withColumn("mode", F.lit("off")))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, 'https?://\\S+', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS prose FROM documents) SELECT doc_id, doc_id % 4 <> 3 OR length(prose) < 8 AS ok, CASE WHEN doc_id % 4 = 3 AND length(prose) >= 8 THEN 'verbatim' END AS reason FROM t")
def validate_sources(s, d):
    """Saved links: a url alone; the text as the reason of capture; url and text as page content; and a text that stands only in a
    section behind the one that counts."""
    k, text = F.col("doc_id") % 4, F.col("text")
    url = F.concat(F.lit("https://example.com/a/"), F.col("doc_id").cast("string"))
    head = F.lit("---\ntype: source\n---\n# Link\n\n")
    body = F.when(k == 0, url).when(k == 2, F.concat(url, F.lit(" "), text)).otherwise(text)
    note = F.when(k == 0, head).when(k == 1, F.concat(head, F.lit("## Why This Was Captured\n"), text)).when(k == 2, F.concat(head, F.lit("## Page Content\n"), text))
    note = F.coalesce(note, F.concat(head, F.lit("## Raw Capture\n"), text, F.lit("\n\n## Why This Was Captured\nsee above\n")))
    kind = F.when(k == 2, "source").otherwise(F.when(F.col("doc_id") % 8 < 4, "source").otherwise("pdf"))
    return C.validate(read(s, d, "documents").select("doc_id", body.alias("body"), note.alias("markdown"), F.when(k == 2, "source").otherwise(kind).alias("kind")))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://[^/?#]+')")
def filter_valid_url(s, d):
    host = F.try_parse_url("url", F.lit("HOST"))
    return read(s, d, "pages").where(F.try_parse_url("url", F.lit("PROTOCOL")).isin("http", "https") & host.isNotNull()).select("page_id", host.alias("host"))


def _range_rows(blocks: str, closed: bool) -> str:
    """Blocks of IPv4 addresses as SQL rows of first, last, bits, closed."""
    nets = map(ip_network, blocks.split())
    return ", ".join(f"({int(n[0])}::BIGINT, {int(n[-1])}::BIGINT, {n.prefixlen}, {closed})" for n in nets)


@query(f"WITH h AS (SELECT doc_id, ('0x' || left(md5(text), 8))::BIGINT AS a FROM documents WHERE text IS NOT NULL), b(lo, hi, bits, closed) AS (VALUES {_range_rows(H.CLOSED_4, True)}, {_range_rows(H.OPEN_4, False)}) SELECT doc_id, NOT coalesce(arg_max(closed, bits), false) AS public FROM h LEFT JOIN b ON a BETWEEN lo AND hi GROUP BY doc_id, a")
def filter_public_host(s, d):
    """Addresses made of the digests of all texts: IPv4, every other one mapped into IPv6, judged by the table of blocks."""
    digest = F.md5("text")
    part = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10)
    four = F.concat_ws(".", *map(part, range(4)))
    host = F.when(F.col("doc_id") % 2 == 0, four).otherwise(F.concat(F.lit("[::ffff:"), four, F.lit("]")))
    rows = read(s, d, "documents").where("text is not null").select("doc_id", host.alias("host"))
    return H.judge_hosts(rows, H.special_blocks(s)).select("doc_id", "public")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_metadata(s, d):
    return read(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query(f"{N}, w AS (SELECT stem, words, row_number() OVER (PARTITION BY source ORDER BY created, stem) AS i, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY created, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM notes) SELECT stem FROM w WHERE before < 100000")
def priority_pack(s, d):
    """Notes of each source in date order while the characters before them stay under 100 000."""
    f = note_files(s, d).select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), "source", "created", F.length("text").alias("n"))
    return earlier_in_group(f, F.col("n"), ["source"], "created", "stem", name="before").where("before < 100000").select("stem")


@query(f"{N} SELECT stem FROM notes ORDER BY stem DESC LIMIT 500")
def recent_notes(s, d):
    return notes(s, d).select("stem").orderBy(F.desc("stem")).limit(500)


@query(f"{N}, t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS term FROM benchmark) WHERE length(term) > 1) SELECT term, row_number() OVER (PARTITION BY term ORDER BY stem)::INT AS rank, stem FROM t JOIN notes ON contains(lower(stem), lower(term)) OR contains(lower(coalesce(text, '')), lower(term)) QUALIFY rank <= 5")
def search_notes(s, d):
    """The first five notes for each word of the benchmark, by the trigram index."""
    terms = read(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("term")).where("length(term) > 1")
    files = note_files(s, d).select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), "text")
    return search.search(search.build_index(files, text="text"), terms)


_TERMS = ("Erthe", "note-1", "2024-03", "no such words")


@query(f"{N}, t AS (SELECT unnest({list(_TERMS)}) AS term) SELECT term, row_number() OVER (PARTITION BY term ORDER BY stem)::INT AS rank, stem FROM t JOIN notes ON contains(lower(stem), lower(term)) OR contains(lower(coalesce(text, '')), lower(term)) QUALIFY rank <= 5")
def search_terms(s, d):
    """The first five notes by name for each term, found in names or texts."""
    return C.search_terms(notes(s, d), _TERMS)


@query(f"{N} SELECT doc_id, lang || CASE WHEN row_number() OVER (PARTITION BY created, lang ORDER BY doc_id) > 1 THEN '-' || (row_number() OVER (PARTITION BY created, lang ORDER BY doc_id)) ELSE '' END AS name FROM notes")
def unique_note_names(s, d):
    rows = earlier_in_group(note_files(s, d).select("doc_id", "created", "lang"), F.lit(1), ["created", "lang"], "doc_id", name="i")
    i = F.col("i") + 1
    return rows.select("doc_id", F.concat("lang", F.when(i > 1, F.concat(F.lit("-"), i.cast("string"))).otherwise(F.lit(""))).alias("name"))


@query("""WITH w AS (SELECT 'private' AS c, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents UNION ALL SELECT 'public', unnest(regexp_extract_all(lower(text), '\\p{L}+')) FROM conversations WHERE role = 'user'),
 k AS (SELECT term, count(*) FILTER (c = 'private') AS private, count(*) FILTER (c = 'public') AS public FROM w GROUP BY term),
 p AS (SELECT *, 500.0::DOUBLE * (private + public) / (n1 + n2) AS a FROM k, (SELECT sum(private)::BIGINT AS n1, sum(public)::BIGINT AS n2 FROM k))
 SELECT term, private, public, round((ln((private + a) / (n1 + 500.0::DOUBLE - private - a)) - ln((public + a) / (n2 + 500.0::DOUBLE - public - a))) / sqrt(1 / (private + a) + 1 / (public + a)), 4) AS z FROM p""")
def channel_contrast(s, d):
    """Words of notes (all documents) against words of posts (what users say)."""
    notes = read(s, d, "documents").select(F.lit("private").alias("channel"), "text")
    posts = read(s, d, "conversations").where("role = 'user'").select(F.lit("public").alias("channel"), "text")
    return X.channel_contrast(notes.unionByName(posts), "private", "public")


_Q = (0.5, 0.9, 0.99)


@query(f"""{N}, w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM notes), k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL),
 r AS (SELECT lang, string_agg(term || ':' || c, ',' ORDER BY c DESC, term) AS recurring FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, term) <= 10) GROUP BY lang),
 o AS (SELECT lang, words, row_number() OVER (PARTITION BY lang ORDER BY words) AS place, count(*) OVER (PARTITION BY lang) AS n FROM notes),
 a AS (SELECT lang, count(*) AS n, sum(words)::BIGINT AS words, round(avg(words), 6) AS mean_words, count(*) FILTER (contains(text, '?')) AS questions FROM notes GROUP BY ALL),
 p AS (SELECT lang, {', '.join(f'min(words) FILTER (place >= greatest(1, ceil(n * {q}::DOUBLE)))::BIGINT AS p{int(q * 100)}' for q in _Q)} FROM o GROUP BY lang)
 SELECT a.*, p50, p90, p99, recurring FROM a JOIN p ON p.lang IS NOT DISTINCT FROM a.lang LEFT JOIN r ON r.lang IS NOT DISTINCT FROM a.lang""")
def vocabulary_profile(s, d):
    """By language, from sketches of each source that are merged: texts, words, questions, quantiles of the length, and the ten words that
    recur most, exact."""
    texts = read(s, d, "documents").select("lang", "source", "text")
    sketches = stable(profile.merged(profile.text_sketches(texts, ["lang", "source"]), ["lang"]))
    lang = lambda df: df.withColumnRenamed("lang", "_lang")
    lengths = lang(profile.length_quantiles(texts, ["lang"], _Q, sketches=sketches)).groupBy("_lang").agg(*[F.max(F.when(F.col("q") == q, F.col("length"))).alias(f"p{int(q * 100)}") for q in _Q])
    words = lang(profile.recurring_words(texts, ["lang"], sketches=sketches)).groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "n"))).alias("w"))
    said = F.array_join(F.transform("w", lambda x: F.concat(x["term"], F.lit(":"), x["n"].cast("string"))), ",")
    rows = sketches.select("lang", "n", F.col("n_words").alias("words"), F.round(F.col("n_words") / F.col("n"), 6).alias("mean_words"), F.col("n_questions").alias("questions"))
    rows = rows.join(lengths, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").join(words.select("_lang", said.alias("recurring")), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return rows.drop("_lang")


_MARK = "('0x' || substr(md5(stem || chr(10) || left(text, 100)), 1, 8))::BIGINT"


@query(f"{N} SELECT count(*) AS n, sum({_MARK})::BIGINT AS total, bit_xor({_MARK}) AS mixed FROM notes")
def corpus_fingerprint(s, d):
    """Whatever the order of the notes: of their stems and first hundred characters."""
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    mark = F.conv(F.substring(F.md5(F.concat(stem, F.lit("\n"), F.substring("text", 1, 100))), 1, 8), 16, 10).cast("long")
    return note_files(s, d).agg(n(), F.sum(mark).alias("total"), F.bit_xor(mark).alias("mixed"))


def _spelled(sql: str) -> str:
    for letter, ascii_ in T.SPELLED.items():
        sql = f"replace({sql}, '{letter}', '{ascii_}')"
    return sql


_SPELLED = _spelled("strip_accents(" + _spelled("lower(regexp_replace(regexp_replace(text, '&(amp|lt|gt|quot|apos|nbsp);', '-', 'g'), '[\u2018\u2019ъьЪЬ]', '', 'g'))") + ")")
_SLUG = f"trim(regexp_replace(regexp_replace({_SPELLED}, '([0-9]),([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"WITH w AS (SELECT doc_id, coalesce({_SLUG}, '') AS w FROM documents), f AS (SELECT doc_id, w, list_reduce(string_split(w, '-'), lambda a, x: CASE WHEN length(a) + length(x) < 50 THEN a || x || '-' WHEN length(a) + length(x) = 50 THEN a || x ELSE a END, '') AS f FROM w) SELECT doc_id, coalesce(nullif(rtrim(CASE WHEN length(w) < 50 THEN w WHEN contains(w, '-') AND f <> '' THEN f ELSE w[:50] END, '-'), ''), 'untitled') AS slug FROM f")
def slugify(s, d):
    """Of the whole text of every document, at most 50 characters."""
    return read(s, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(ORACLE_SQL["slugify"])
def slugify_documents(s, d):
    return slugify(s, d)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'photo' WHEN event_id % 5 = 1 THEN 'document' WHEN event_id % 5 = 2 THEN 'command' ELSE 'text' END AS kind FROM events WHERE event_id % 5 <> 4")
def dispatch_message(s, d):
    """Photos before documents before commands before text; updates with nothing are dropped."""
    k = F.col("event_id") % 5
    rows = read(s, d, "events").select("event_id", F.when(k == 0, F.array(F.lit("p"))).alias("photo"), F.when(k < 2, F.lit("d")).alias("document"), F.when(k < 3, "/start").when(k == 3, F.col("event_type")).otherwise(" ").alias("text"))
    return C.dispatch(rows).select("event_id", "kind")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'too long' WHEN text IS NULL OR trim(text, ' \n\t') = '' THEN 'empty' END AS reason FROM conversations")
def admit_capture(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", C.admit(F.col("text"), 300).alias("reason"))
