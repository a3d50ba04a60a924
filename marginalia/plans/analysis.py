"""Queries over messages, pages, samples, condensed analyses and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import messages as M, pages as P, text as T
from ..operators import catalog as C, condense, runs, sampling
from ..sources.sinks import shared_folder
from ..sources.standins import NOTES_SQL, note_files, read
from ..streaming import captures
from .registry import ORACLE_SQL, query

N = f"WITH {NOTES_SQL}"


def notes(s: SparkSession, d: str) -> DataFrame:
    return C.parse_notes(note_files(s, d))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Reflection' WHEN 2 THEN 'Idea' ELSE 'Thought' END AS type, CASE turn % 4 WHEN 0 THEN 'calm' WHEN 2 THEN 'late' END AS mood, array_to_string({_LINES}, chr(10)) AS body FROM conversations")
def parse_message(s, d):
    """Turns behind a type prefix and mood lines; the last mood counts."""
    k, t = F.col("turn") % 4, F.coalesce("text", F.lit(""))
    made = F.when(k == 0, F.concat(F.lit("reflection: "), t, F.lit("\nMood: calm"))).when(k == 2, F.concat(F.lit("IDEA:\nmood: early\n"), t, F.lit("\n MOOD:  late "))).otherwise(t)
    rows = read(s, d, "conversations").withColumn("text", made)
    lines = M.message_lines(F.col("text"))
    return rows.select("conv_id", "turn", M.message_type(F.col("text")).alias("type"), M.message_field(lines, "mood").alias("mood"), M.message_body(lines).alias("body"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'A & B ' || page_id ELSE replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&amp;', '&') END AS title, CASE page_id % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' END AS author, CASE page_id % 3 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2024-06-01' END AS date, CASE page_id % 3 WHEN 1 THEN 'said' END AS description, CASE page_id % 3 WHEN 0 THEN 'Site' END AS site_name FROM pages")
def extract_page_metadata(s, d):
    """Pages with Open Graph tags, with JSON-LD and a time element, or as they are."""
    og = F.concat(F.lit('<meta content="A &amp; B '), F.col("page_id").cast("string"), F.lit('" property="og:title"><meta name="author" content="Ann"><meta property="article:published_time" content="2024-05-01"><meta property="og:site_name" content="Site">'))
    ld = F.lit('<script type="application/ld+json">{"author": {"name": "Bob"}}</script><meta name="description" content=\'said\'><time class="x" datetime="2024-06-01">June</time>')
    head = F.when(F.col("page_id") % 3 == 0, og).when(F.col("page_id") % 3 == 1, ld).otherwise(F.lit(""))
    rows = read(s, d, "pages").withColumn("html", F.concat(head, "html"))
    return P.page_metadata(rows).select("page_id", "title", "author", "date", "description", "site_name")


@query()
def extract_pages(s, d):
    """Metadata and main content as markdown; tested on small pages."""
    return P.extract_pages(read(s, d, "pages")).select("page_id", "title", "domain", "markdown_content", "success", "error")


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ' || chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{4,}', repeat(chr(10), 3), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM pages")
def clean_markdown(s, d):
    """The html of every page with a blank and a line break for each tag."""
    made = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " \n")
    return read(s, d, "pages").select("page_id", F.md5(P.clean_markdown(made)).alias("text_md5"))


_SCORE = "round((CASE WHEN contains(lower(text), 'feel') OR contains(lower(text), 'emotion') OR contains(lower(text), 'anxious') OR contains(lower(text), 'happy') OR contains(lower(text), 'sad') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN mood IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 1.5::DOUBLE + ln(words + 1.0::DOUBLE) * 0.3::DOUBLE, 6)"


@query(f"{N} SELECT stem, {_SCORE} AS score FROM notes")
def note_score(s, d):
    return sampling.scored(notes(s, d)).select("stem", "score")


def _sample_sql(ratio: str) -> str:
    return f"""{N}, a AS (SELECT stem, created, {_SCORE} AS score, row_number() OVER (ORDER BY created, stem) - 1 AS i, count(*) OVER () AS n FROM notes),
 e AS (SELECT *, i < greatest(1, floor(n * 0.1::DOUBLE)) OR i >= n - greatest(1, floor(n * 0.1::DOUBLE)) AS edge FROM a), c AS (SELECT greatest(1, floor(count(*) * {ratio}))::BIGINT - count(*) FILTER (edge) AS c FROM e),
 r AS (SELECT stem, row_number() OVER (ORDER BY score DESC, created, stem) - 1 AS i, count(*) OVER () AS n FROM e WHERE NOT edge), k AS (SELECT (j * (SELECT max(n) FROM r)) // (SELECT c FROM c) AS i FROM range((SELECT greatest(c, 0) FROM c)) t(j))
 SELECT stem FROM e WHERE edge UNION ALL SELECT stem FROM r WHERE i IN (SELECT i FROM k)"""


@query(_sample_sql("0.4::DOUBLE"))
def stratified_temporal_sample(s, d):
    rows = sampling.scored(notes(s, d)).select("stem", "created_at", "score")
    return sampling.stratified_temporal_sample(rows, 0.4).select("stem")


def typed_items(s: SparkSession, d: str) -> DataFrame:
    """``id, source_type, created_at, score, token_estimate``: documents as notes and reflections, what users say as posts, pages as
    images (one in seven without a date), languages as hubs."""
    day = lambda i: F.date_add(F.lit("2024-01-01").cast("date"), (F.col(i) % 365).cast("int"))
    kind = F.when(F.col("source") == "src0", "reflection").otherwise("note")
    of = note_files(s, d).select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), kind.alias("source_type"))
    written = sampling.scored(notes(s, d)).join(of, "stem").select(F.col("stem").alias("id"), "source_type", "created_at", "score", "token_estimate")
    posts = read(s, d, "conversations").where("role = 'user'").select(F.concat_ws("-", F.lit("post"), "conv_id", "turn").alias("id"), F.lit("tweet").alias("source_type"), day("conv_id").alias("created_at"), T.token_estimate(T.word_count(F.col("text"))).alias("token_estimate"))
    images = read(s, d, "pages").select(F.concat(F.lit("image-"), "page_id").alias("id"), F.lit("image").alias("source_type"), F.when(F.col("page_id") % 7 != 0, day("page_id")).alias("created_at"), F.lit(1000).alias("token_estimate"))
    hubs = read(s, d, "documents").where("lang is not null").select(F.concat(F.lit("hub-"), "lang").alias("id"), F.lit("hub").alias("source_type"), F.lit(0).alias("token_estimate")).distinct()
    return written.unionByName(posts, allowMissingColumns=True).unionByName(images, allowMissingColumns=True).unionByName(hubs, allowMissingColumns=True)


_DAY = "(DATE '2024-01-01' + ({} % 365)::INT)::DATE"
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"
TYPED_WITH = f"""{N}, items AS (SELECT stem AS id, CASE WHEN source = 'src0' THEN 'reflection' ELSE 'note' END AS source_type, created AS created_at, {_SCORE} AS score, floor(words * 1.3::DOUBLE)::INT AS tokens FROM notes
 UNION ALL SELECT 'post-' || conv_id || '-' || turn, 'tweet', {_DAY.format('conv_id')}, NULL, floor({_WORDS} * 1.3::DOUBLE)::INT FROM conversations WHERE role = 'user'
 UNION ALL SELECT 'image-' || page_id, 'image', CASE WHEN page_id % 7 <> 0 THEN {_DAY.format('page_id')} END, NULL, 1000 FROM pages UNION ALL SELECT DISTINCT 'hub-' || lang, 'hub', NULL::DATE, NULL, 0 FROM documents WHERE lang IS NOT NULL),
 z AS (SELECT source_type, count(*) AS n, greatest(1, floor(count(*) * (SELECT 50000::DOUBLE / sum(tokens) * 0.95::DOUBLE FROM items)))::BIGINT AS target, greatest(1, floor(count(*) * 0.1::DOUBLE))::BIGINT AS edge FROM items GROUP BY 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY created_at NULLS FIRST, id) - 1 AS spot FROM items JOIN z USING (source_type)), e AS (SELECT *, spot < edge OR spot >= n - edge AS is_edge FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY score DESC, created_at NULLS FIRST, id) - 1 AS rank, n - least(n, 2 * edge) AS rest, target - least(n, 2 * edge) AS wanted FROM e WHERE source_type IN ('note', 'reflection') AND NOT is_edge),
 i AS (SELECT *, (rank * wanted + rest - 1) // rest AS i FROM r WHERE wanted > 0), t AS (SELECT *, (spot * target + n - 1) // n AS i FROM e WHERE source_type IN ('tweet', 'image'))"""
TYPED_KEPT = "SELECT id, source_type FROM e WHERE source_type = 'hub' OR source_type IN ('note', 'reflection') AND is_edge UNION ALL SELECT id, source_type FROM i WHERE wanted >= rest OR i < wanted AND i * rest // wanted = rank UNION ALL SELECT id, source_type FROM t WHERE target >= n OR i < target AND i * n // target = spot"


@query(f"{TYPED_WITH} {TYPED_KEPT}")
def sample_if_needed(s, d):
    """Over all types, with a limit of 50,000 tokens, which every set of tables passes."""
    return sampling.sample_types(typed_items(s, d), 50_000).select("id", "source_type")


@query(_sample_sql("(50000::DOUBLE / (SELECT sum(floor(words * 1.3::DOUBLE)::BIGINT) FROM notes) * 0.95::DOUBLE)"))
def sample_notes_if_needed(s, d):
    """Notes alone, with a limit of 50,000 tokens."""
    rows = sampling.scored(notes(s, d)).select("stem", "created_at", "score", "token_estimate")
    return sampling.sample_if_needed(rows, 50_000).select("stem")


_KEPT = _sample_sql("(50000::DOUBLE / (SELECT sum(floor(words * 1.3::DOUBLE)::BIGINT) FROM notes) * 0.95::DOUBLE)")


@query(f"{N}, kept AS ({_KEPT}) SELECT source, count(*) AS original, count(kept.stem) AS sampled, round(count(kept.stem)::DOUBLE / count(*), 6) AS retention FROM notes LEFT JOIN kept USING (stem) GROUP BY source")
def sampling_report(s, d):
    """By source, the notes, those that the sampler keeps of 50,000 tokens, and the share that stays."""
    rows = sampling.scored(notes(s, d)).select("stem", "created_at", "score", "token_estimate")
    kept = sampling.sample_if_needed(rows, 50_000).select("stem", F.lit(1).alias("kept"))
    both = note_files(s, d).select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), "source").join(kept, "stem", "left")
    n = F.count(F.lit(1))
    return both.groupBy("source").agg(n.alias("original"), F.count("kept").alias("sampled"), F.round(F.count("kept") / n, 6).alias("retention"))


@query(ORACLE_SQL["sampling_report"])
def sampled_counts(s, d):
    return sampling_report(s, d)


_HEDGED = "CASE doc_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END"


@query(f"WITH t AS (SELECT doc_id, count(*) OVER (PARTITION BY source) AS items, {_HEDGED} AS h FROM documents) SELECT doc_id, CASE WHEN items < 50 OR h >= 3 THEN 'low' WHEN items < 200 OR h >= 1 THEN 'medium' ELSE 'high' END AS level FROM t")
def analysis_confidence(s, d):
    """Every document as an analysis of its source, some with hedging phrases."""
    t = read(s, d, "documents")
    said = F.when(F.col("doc_id") % 4 == 1, "It is Unclear. ").when(F.col("doc_id") % 4 == 2, "speculative; limited evidence; insufficient data. ").otherwise("")
    items = t.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    joined = t.withColumn("said", F.concat(said, "text")).join(items, t["source"].eqNullSafe(items["source"]))
    return joined.select("doc_id", condense.confidence(F.col("items"), F.col("said")).alias("level"))


def analyses(s: SparkSession, d: str) -> DataFrame:
    """``run_id, dimension, content, confidence``: all documents as the analyses of runs of 23 dimensions; a null text is an empty analysis."""
    dims = condense.DIMENSIONS
    i = F.col("doc_id") % len(dims)
    level = F.when(F.col("doc_id") % 5 == 0, "low").when(F.col("doc_id") % 5 == 1, "medium").when(F.col("doc_id") % 5 == 2, "high")
    return read(s, d, "documents").select(F.expr(f"doc_id div {len(dims)}").alias("run_id"), F.element_at(F.array(*map(F.lit, dims)), (i + 1).cast("int")).alias("dimension"), F.coalesce("text", F.lit("")).alias("content"), level.alias("confidence"))


_D = len(condense.DIMENSIONS)
_DEFS = ", ".join(f"('{c}', {i}, '{x}', {condense.DIMENSIONS.index(x)})" for c, xs in condense.CATEGORIES.items() for i, x in enumerate(xs))
A = f"WITH defs(category, pos, dimension, i) AS (VALUES {_DEFS}), analyses AS (SELECT doc_id // {_D} AS run_id, doc_id % {_D} AS i, coalesce(text, '') AS content, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level FROM documents)"


@query(f"{A} SELECT run_id, category, string_agg(dimension, ',' ORDER BY pos) AS sources, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5, ['low', 'medium', 'high'][min(level)] AS confidence FROM analyses JOIN defs USING (i) GROUP BY ALL")
def gather_category_sources(s, d):
    found = condense.gather_sources(analyses(s, d), condense.category_defs(s))
    return found.select("run_id", "category", "sources", F.md5("content").alias("content_md5"), "confidence")


@query(f"{A} SELECT run_id, 1 + count(DISTINCT category) AS files, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM analyses JOIN defs USING (i) GROUP BY run_id")
def condensation_totals(s, d):
    found = condense.gather_sources(analyses(s, d), condense.category_defs(s))
    return found.groupBy("run_id").agg((F.count(F.lit(1)) + 1).alias("files"), F.sum(T.word_count(F.col("content"))).alias("words"))


@query(f"{A} SELECT r.run_id, dimension FROM (SELECT DISTINCT run_id FROM analyses) r, defs d WHERE NOT EXISTS (SELECT 1 FROM analyses a WHERE a.run_id = r.run_id AND a.i = d.i)")
def pending_dimensions(s, d):
    return condense.pending_dimensions(analyses(s, d))


_PHASE_ROWS = ", ".join(f"({i}, '{p}', '{x}')" for i, (p, xs) in enumerate(runs.PHASES.items()) for x in xs)
_N_DIMS = len(runs.ROWS)


@query(f"""WITH phases(position, phase, dimension) AS (VALUES {_PHASE_ROWS}), numbered AS (SELECT *, row_number() OVER (ORDER BY position, dimension) - 1 AS i FROM phases),
 d AS (SELECT doc_id // {_N_DIMS} AS run_id, doc_id % {_N_DIMS} AS i, length(text) < 200 OR text IS NULL AS failed FROM documents), r AS (SELECT DISTINCT run_id, run_id % 4 <> 0 AS same, run_id % 3 - 1 AS reached FROM d),
 f AS (SELECT r.*, p.*, r.same AND (p.position <= reached OR coalesce(NOT d.failed, false)) AS done FROM r CROSS JOIN numbered p LEFT JOIN d ON d.run_id = r.run_id AND d.i = p.i),
 g AS (SELECT run_id, same, position, phase, count(*) FILTER (done) AS n_done, count(*) FILTER (NOT done) AS n_left, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (NOT done), '') AS pending FROM f GROUP BY ALL)
 SELECT run_id, position, phase, CASE WHEN NOT same THEN 'restart' WHEN n_left = 0 THEN 'done' WHEN position = min(CASE WHEN n_left > 0 THEN position END) OVER (PARTITION BY run_id) THEN 'resume' ELSE 'wait' END AS action, n_done, n_left, pending FROM g""")
def resume_plan(s, d):
    """Documents as saved results, first failed attempts and then the real ones, those under 200 characters failed for good; checkpoints
    of three phases by turns, the first of them outdated; every fourth run's corpus was edited since, or has no checkpoint."""
    names = [(i, p, x) for i, (p, xs) in enumerate(runs.PHASES.items()) for x in xs]
    phases = s.createDataFrame(names, "position int, phase string, dimension string")
    ordered = [x for _, _, x in sorted(names, key=lambda r: (r[0], r[2]))]
    docs = read(s, d, "documents").select(F.expr(f"doc_id div {_N_DIMS}").alias("run_id"), F.element_at(F.array(*map(F.lit, ordered)), (F.col("doc_id") % _N_DIMS + 1).cast("int")).alias("dimension"), F.coalesce("text", F.lit("")).alias("content"))
    error = F.when(F.length("content") < 200, "too short")
    saved = docs.select("run_id", "dimension", F.lit(2).alias("seq"), error.alias("error")).union(docs.select("run_id", "dimension", F.lit(1), F.lit("timed out")))
    now, run = condense.corpus_mark(docs), F.col("run_id")
    edited = docs.withColumn("content", F.when(run % 4 == 0, F.concat("content", F.lit("#"))).otherwise(F.col("content")))
    marks = condense.corpus_mark(edited).where("run_id % 8 <> 0")
    checkpoints = marks.select("run_id", F.lit(2).alias("seq"), (run % 3 - 1).cast("int").alias("position"), "mark").union(marks.select("run_id", F.lit(1), F.lit(9), F.lit("old")))
    plan = condense.resume_plan(phases, saved, checkpoints, now)
    return plan.select("run_id", "position", "phase", "action", "n_done", "n_left", F.array_join("pending", ",").alias("pending"))


def profiles(s: SparkSession, d: str) -> DataFrame:
    """A profile in JSON for each document, every second in a code fence, every seventh broken."""
    field = lambda v: F.to_json(F.struct(v.alias("value"), F.lit("high").alias("confidence")))
    text = F.concat(F.lit('{"basics": {"lang": '), field(F.col("lang")), F.lit(', "source": '), field(F.when(F.col("doc_id") % 3 == 0, "Not provided").otherwise(F.col("source"))), F.lit('}, "more": {"size": null}}'))
    wrapped = F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), text, F.lit("\n```"))).otherwise(text)
    return read(s, d, "documents").select("doc_id", wrapped.alias("profile"))


@query("SELECT doc_id, unnest(['basics', 'basics', 'more']) AS section, unnest(['lang', 'source', 'size']) AS field, unnest([lang, CASE WHEN doc_id % 3 = 0 THEN 'Not provided' ELSE source END, NULL]) AS value, unnest(['high', 'high', NULL]) AS confidence FROM documents WHERE doc_id % 7 <> 0")
def flatten_profile_fields(s, d):
    return condense.profile_fields(profiles(s, d), "doc_id", "profile")


@query("WITH t AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 7 <> 0) SELECT 'basics' AS section, 'lang' AS field, count(lang) AS filled, count(*) AS total FROM t UNION ALL SELECT 'basics', 'source', count(source) FILTER (doc_id % 3 <> 0), count(*) FROM t UNION ALL SELECT 'more', 'size', 0, count(*) FROM t")
def field_fill_counts(s, d):
    rows = condense.profile_fields(profiles(s, d), "doc_id", "profile")
    return rows.groupBy("section", "field").agg(F.count_if(condense.filled(F.col("value"))).alias("filled"), F.count(F.lit(1)).alias("total"))


@query("SELECT event_id AS message_id, user_id AS chat_id, CASE WHEN event_id % 3 = 0 THEN 'Idea' ELSE 'Thought' END AS type, event_type || ' ' || event_id AS body FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 11 <> 0")
def stream_capture_ingest(s, d):
    """The table of events read as a stream until nothing is left, into a sink that commits once; blank bodies are refused."""
    rows = s.readStream.schema(read(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    said = F.when(F.col("event_id") % 11 == 0, F.lit("Mood: calm")).otherwise(F.concat(F.when(F.col("event_id") % 3 == 0, "idea: ").otherwise(""), "event_type", F.lit(" "), F.col("event_id").cast("string")))
    updates = rows.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "text").when(F.col("event_type") == "purchase", "captioned").otherwise("photo").alias("kind"), said.alias("text"))
    made = captures.ingest(captures.dedup_messages(updates, "40 days"))
    out, marks = shared_folder(s, "captures"), shared_folder(s, "captures-checkpoint")
    captures.write_once(made, out, marks).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(out).where("reason is null").select("message_id", "chat_id", "type", "body")
