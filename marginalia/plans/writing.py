"""Queries that build notes: heads of pages, names, dates, links added to notes, new hubs, citations, attention."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import notes as W
from ..operators import catalog as C, words as X
from ..sources.standins import NOTES_SQL, note_files, read
from .registry import query

N = f"WITH {NOTES_SQL}"
_WORDS = r"len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))"


@query(f"WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) AS i FROM documents), r AS (SELECT *, sum({_WORDS}) OVER (PARTITION BY doc_id ORDER BY i) AS w FROM p) SELECT doc_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY i) FILTER (i = 1 OR w <= 300)) AS head_md5, bool_or(i > 1 AND w > 300) AS truncated FROM r GROUP BY doc_id")
def head_by_words(s, d):
    rows = read(s, d, "documents").withColumn("h", W.head_by_words(F.col("text"), 300))
    return rows.select("doc_id", F.md5("h.head").alias("head_md5"), "h.truncated")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:00') ELSE strftime(ts, '%Y-%m-%dT00:00:00') END AS created FROM events")
def parse_pdf_date(s, d):
    made = F.concat(F.lit("D:"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyyMMdd")))
    return read(s, d, "events").select("event_id", W.pdf_date(made).alias("created"))


@query("SELECT o_orderkey, date_sub('year', o_orderdate::DATE, DATE '2024-02-29')::INT AS years FROM orders")
def age_from_birth_date(s, d):
    """Order dates as dates of birth."""
    return read(s, d, "orders").select("o_orderkey", W.age(F.col("o_orderdate").cast("date"), F.lit("2024-02-29").cast("date")).alias("years"))


@query("WITH t AS (SELECT page_id, translate(trim(coalesce(url, '')), '<>:\"/\\|?*', '_________') AS x FROM pages) SELECT page_id, CASE WHEN length(x) <= 30 THEN x ELSE left(x, 30) END || '.html' AS name FROM t")
def sanitize_filename(s, d):
    """File names of at most 35 characters from urls."""
    return read(s, d, "pages").select("page_id", W.safe_filename(F.concat(F.trim(F.coalesce("url", F.lit(""))), F.lit(".html")), 35).alias("name"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'image/png' WHEN 'click' THEN 'image/webp' ELSE 'image/jpeg' END AS type FROM events")
def media_type(s, d):
    path = F.concat(F.lit("a.b/"), F.col("event_id").cast("string"), F.when(F.col("event_type") == "view", ".PNG").when(F.col("event_type") == "click", ".webp").otherwise(""))
    return read(s, d, "events").select("event_id", W.media_type(path).alias("type"))


@query("SELECT doc_id, md5(rtrim(text, ' \n\t\r') || chr(10) || chr(10) || '## Page' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '---' || chr(10) ELSE '' END) AS note_md5 FROM documents")
def insert_before_rule(s, d):
    note = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n\n---\n").otherwise(""))
    return read(s, d, "documents").select("doc_id", F.md5(W.insert_before_rule(note, F.lit("## Page"))).alias("note_md5"))


@query(f"{N} SELECT stem, CASE WHEN prev = '2000-01-01--gone' THEN lang ELSE 'Atlas' END AS first_link FROM notes")
def link_notes_to_hub(s, d):
    """A hub linked from every note whose link to the note before it works: notes, targets and a rewrite of the text."""
    parsed = C.parse_notes(note_files(s, d))
    targets = parsed.where(~F.array_contains("hub_links", "2000-01-01--gone")).select("path", F.lit("Atlas").alias("hub"))
    joined = note_files(s, d).join(targets, "path", "left")
    linked = joined.withColumn("content", F.when(F.col("hub").isNull(), F.col("content")).otherwise(W.upsert_link(F.col("content"), F.col("hub"))))
    return C.parse_notes(linked).select("stem", F.get("hub_links", F.lit(0)).alias("first_link"))


@query(f"{N}, c AS (SELECT concept, min(created) AS first_day, count(DISTINCT stem) AS n FROM (SELECT stem, created, unnest([lang, source, size]) AS concept FROM notes) GROUP BY concept) SELECT concept AS name, md5(array_to_string(['---', 'type: hub', 'status: empty', 'created_at: ' || strftime(first_day, '%Y-%m-%d'), '---', '', '# ' || concept, '', '## What This Hub Is', 'A conceptual gathering place for notes that touch on this concept.', '', 'This hub does not assert a single definition or viewpoint.', '', '## What This Hub Is Not', '- Not a summary', '- Not a conclusion', '- Not authoritative', '', '## Open Questions', '- (leave empty)', '', '## Linked Notes', '- (leave empty)', ''], chr(10))) AS stub_md5 FROM c WHERE n >= 3")
def hub_stub(s, d):
    """Stubs for concepts of at least three notes, dated by the first of them."""
    notes = C.parse_notes(note_files(s, d))
    found = notes.select("created_at", F.explode(F.array_distinct(F.concat("themes", "tags"))).alias("name")).groupBy("name").agg(F.min("created_at").alias("day"), F.count(F.lit(1)).alias("n"))
    return found.where("n >= 3").select("name", F.md5(W.hub_stub(F.col("name"), F.col("day"))).alias("stub_md5"))


@query(f"{N} SELECT a.stem, string_agg(b.stem || ' ' || strftime(b.created, '%Y-%m-%d'), ',' ORDER BY b.stem) AS cited FROM notes a JOIN notes b ON a.prev = b.stem GROUP BY a.stem")
def citation_section(s, d):
    """Links that are notes, with their dates; the first ten of each note."""
    notes = C.parse_notes(note_files(s, d))
    known = notes.select(F.col("stem").alias("dst"), "created_at")
    found = C.links(notes).join(known, "dst")
    top = found.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("i <= 10")
    return top.groupBy(F.col("src").alias("stem")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "created_at"))), lambda x: F.concat(x["dst"], F.lit(" "), x["created_at"].cast("string"))), ",").alias("cited"))


@query(f"{N}, t AS (SELECT source, size, count(*) AS n FROM notes GROUP BY ALL) SELECT source, size AS theme, round((n::DOUBLE / sum(n) OVER (PARTITION BY source)) / (sum(n) OVER (PARTITION BY size)::DOUBLE / sum(n) OVER ()), 6) AS skew FROM t")
def attention_skew(s, d):
    """A theme's share within a source over its share in all notes."""
    size = F.when(F.length("text") < 1000, "short").when(F.length("text") < 5000, "medium").otherwise("long")
    counted = note_files(s, d).groupBy("source", size.alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda *keys: F.sum("n").over(Window.partitionBy(*keys))
    return counted.select("source", "theme", F.round(F.col("n") / share("source") / (share("theme") / share()), 6).alias("skew"))


_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '\\p{{L}}+')"


@query(f"WITH w AS (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, (VALUES (1, 2), (2, 3), (5, 4), (3, 5)) x(i, k) WHERE len(w) >= i + k - 1), d AS (SELECT ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS t FROM documents) SELECT phrase FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE contains(t, ' ' || phrase || ' '))")
def theme_absence(s, d):
    """Phrases of two to five words, taken from all items of the benchmark, that no document has."""
    w = X.tokens(F.col("text"))
    some = F.array(*[F.when(F.size(w) >= i + k - 1, F.array_join(F.slice(w, i, k), " ")) for i, k in ((1, 2), (2, 3), (5, 4), (3, 5))])
    lexicon = read(s, d, "benchmark").select(F.explode(some).alias("phrase")).where("phrase is not null")
    return X.phrase_counts(read(s, d, "documents"), lexicon).where("n_docs = 0").select("phrase")
