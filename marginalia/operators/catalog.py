"""Operators over notes, links, hubs, captures, messages and tweets: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import markup as W, text as T
from .order import earlier_in_group, evenly, row_index, running_total, stable


def parse_notes(files: DataFrame, *more: Column) -> DataFrame:
    """Typed note rows from ``path, content``, and whatever else is asked for."""
    b = T.body(F.col("content"))
    raw = T.section(b, "Raw Capture")
    words = T.word_count(raw)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.select(
        "path", stem.alias("stem"), T.title(b).alias("title"), raw.alias("raw_capture"), T.bullets(T.section(b, "Themes")).alias("themes"), T.front_list(F.col("content"), "tags").alias("tags"),
        T.wikilinks(T.section(b, "Related Hub Notes")).alias("hub_links"), T.front_value(F.col("content"), "mood").alias("mood"), F.to_date(T.front_value(F.col("content"), "captured_at")).alias("created_at"),
        words.alias("word_count"), T.token_estimate(words).alias("token_estimate"), *more)


def parse_hubs(files: DataFrame) -> DataFrame:
    """``path, title, status, created_at, linked_notes`` from ``path, content``; the title falls back to the stem."""
    c, b = F.col("content"), T.body(F.col("content"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.select("path", F.coalesce(T.title(b), stem).alias("title"), F.coalesce(T.front_value(c, "status"), F.lit("unknown")).alias("status"),
                        F.try_to_timestamp(F.substring(T.front_value(c, "created_at"), 1, 10)).cast("date").alias("created_at"), W.note_links(b).alias("linked_notes"))


def created_at(content: Column, stem: Column, changed: Column) -> Column:
    """When a note was made: the first frontmatter field that is a time, the day its name begins with, or the file's own time. Offsets are dropped."""
    def field(name: str) -> Column:
        bare = F.regexp_replace(T.front_value(content, name), r"(?:Z|[+-]\d\d:?\d\d)$", "")
        return F.try_to_timestamp(F.when(bare.rlike(r"^\d{4}-\d\d-\d\d"), bare).otherwise(T.front_value(content, name)))

    return F.coalesce(*map(field, ("created_at", "captured_at", "date")), F.try_to_timestamp(F.nullif(F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), changed)


def transcript(items: DataFrame) -> DataFrame:
    """``part, id, line``: notes, then reflections, then posts, each by time; sorted over the cluster, for ``write.text``."""
    kind, at = F.col("source_type"), F.col("created_at")
    mood = F.when((kind == "reflection") & F.col("mood").isNotNull(), F.concat(F.lit("\n[Mood]: "), "mood")).otherwise("")
    note = F.concat(F.lit("--- [["), "id", F.lit("]] ("), F.date_format(at, "yyyy-MM-dd"), F.lit(") ---\n"), "text", mood)
    line = F.when(kind == "tweet", F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(": "), "text")).otherwise(note)
    part = F.when(kind == "note", 1).when(kind == "reflection", 2).otherwise(3)
    return items.select(part.alias("part"), "created_at", "id", line.alias("line")).orderBy("part", "created_at", "id")


def fence_repair(files: DataFrame) -> DataFrame:
    """Add ``fixed, outcome``: the content without a fence around it; ``fixed``, ``skipped`` or, where it cannot be read, ``error``."""
    bare = T.without_fence(F.col("content"))
    wrapped = T.strip(F.regexp_replace("content", "^\ufeff", "")).rlike(r"^```(?:markdown|md)?[ \t]*\n")
    return files.withColumn("fixed", bare).withColumn("outcome", F.when(F.col("content").isNull(), "error").when(wrapped, "fixed").otherwise("skipped"))


def links(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("stem").alias("src"), F.explode("hub_links").alias("dst"))


def note_names(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("stem").alias("name")).union(notes.where("title is not null").select("title")).distinct()


def broken_links(notes: DataFrame, hubs: DataFrame) -> DataFrame:
    known = note_names(notes).union(hubs.select("name"))
    return links(notes).join(known.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst")


def concepts(notes: DataFrame) -> DataFrame:
    return notes.select("stem", F.explode(F.array_distinct(F.concat("themes", "tags"))).alias("concept"))


def hub_suggestions(notes: DataFrame, hubs: DataFrame, least: int = 3) -> DataFrame:
    """``concept, n_notes, stem``: concepts of at least ``least`` notes that are no hub yet, a row for each of their notes.

    The list of a concept's notes stays rows, so that one that half of all notes share is no single value.
    """
    found = concepts(notes).join(hubs.withColumnRenamed("name", "concept"), "concept", "left_anti")
    counted = found.groupBy("concept").agg(F.count(F.lit(1)).alias("n_notes")).where(F.col("n_notes") >= least)
    return found.join(counted, "concept").select("concept", "n_notes", "stem")


def theme_pairs(notes: DataFrame) -> DataFrame:
    """Pairs of themes of one note; a note's few themes are paired inside its row, without a join."""
    pairs = F.flatten(F.transform("themes", lambda a: F.transform(F.filter("themes", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return notes.select(F.explode(F.array_distinct(pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_notes"))


def current_state(events: DataFrame) -> DataFrame:
    """Fold a capture's history: last status, file kept through later statuses unless reset, error of a failed one."""
    last = F.max_by("status", "seq")
    file = F.max_by("output_file", F.when(F.col("output_file").isNotNull() | (F.col("status") == "pending"), F.col("seq")))
    return events.groupBy("capture_id").agg(last.alias("status"), file.alias("output_file"), F.max_by("error_message", "seq").alias("error_message"))


def append_status(state: DataFrame, old: str, new: str) -> DataFrame:
    """Events that move every capture of one status to another."""
    return state.where(F.col("status") == old).select("capture_id", F.lit(new).alias("status"))


def dispatch(updates: DataFrame) -> DataFrame:
    """Add ``kind`` to updates with ``photo, document, text``: the first of photo, document, command, text; those without any are dropped."""
    said = F.coalesce(T.strip(F.col("text")), F.lit(""))
    kind = F.when(F.coalesce(F.size("photo"), F.lit(0)) > 0, "photo").when(F.col("document").isNotNull(), "document").when(said.startswith("/"), "command").when(said != "", "text")
    return updates.withColumn("kind", kind).where("kind is not null")


def priority(kind: Column, k: Column) -> Column:
    return F.when(kind.isin("photo", "captioned"), 1).when(kind == "command", 3).otherwise(2)


def admit(body: Column, longest: int = 100_000) -> Column:
    """Why a body is refused; null if it is admitted."""
    return F.when(F.coalesce(T.strip(body), F.lit("")) == "", "empty").when(F.length(body) > longest, "too long")


# Folders of capture types.
FOLDERS = {"text": "notes", "captioned": "notes", "photo": "notes", "document": "sources"}


def folder(kind: Column) -> Column:
    found = F.lit("inbox")
    for k, v in FOLDERS.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def next_text(messages: DataFrame) -> DataFrame:
    """Each pending photo with the first later text of its chat; captioned photos are texts, commands and documents are not.

    A chat is cut into ranges of time, so that no task holds all of a hot one; a photo without a text in its own range
    takes the first of the later ranges. Messages without a time come before all others.
    """
    parts = max(2, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = messages.where(F.col("kind").isin("photo", "text", "captioned")).select("chat_id", "ts", "message_id", "kind")
    rows = stable(rows.repartitionByRange(parts, "chat_id", "ts", "message_id").withColumn("_part", F.spark_partition_id()))
    is_text = F.col("kind") != "photo"
    inside = Window.partitionBy("_part", "chat_id").orderBy(F.desc("ts"), F.desc("message_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    photos = rows.withColumn("near", F.last(F.when(is_text, F.col("message_id")), ignorenulls=True).over(inside)).where("kind = 'photo'")
    ranges = rows.groupBy("_part", "chat_id").agg(F.min(F.when(is_text, F.struct("ts", "message_id"))).alias("first"))
    later = Window.partitionBy("chat_id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_part").alias("_p"), F.col("chat_id").alias("_c"), F.last("first.message_id", ignorenulls=True).over(later).alias("far"))
    found = photos.join(ranges, (F.col("_part") == F.col("_p")) & F.col("chat_id").eqNullSafe(F.col("_c")))
    return found.select(F.col("message_id").alias("image_id"), "chat_id", F.coalesce("near", "far").alias("text_id"))


def stratified_select(df: DataFrame, count: int, *order: Column | str) -> DataFrame:
    rows = row_index(df, *order)
    return rows.where(evenly(F.col("row_index"), F.col("row_count"), F.lit(count))).drop("row_index", "row_count")


def edge_flag(df: DataFrame, *order: Column | str) -> DataFrame:
    rows = row_index(df, *order)
    edge = F.greatest(F.lit(1).cast("long"), F.floor(F.col("row_count") * 0.1))
    return rows.withColumn("is_edge", (F.col("row_index") < edge) | (F.col("row_index") >= F.col("row_count") - edge)).drop("row_index", "row_count")


def multipass_chunks(df: DataFrame, tokens: str, limit: int, *order: Column | str) -> DataFrame:
    """``k = tokens div limit + 1`` chunks of ``n div k`` rows in order; the last takes the rest. ``df`` is made once."""
    df = stable(df)
    rows = row_index(df, *order)
    total = df.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("_tokens"))
    k = F.expr(f"_tokens div {limit} + 1")
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.col("row_count") / k))
    return rows.join(F.broadcast(total)).withColumn("chunk", F.least(F.floor(F.col("row_index") / each), k - 1)).drop("row_index", "row_count", "_tokens")


def token_budget_pack(df: DataFrame, tokens: str, limit: int, *order: Column | str) -> DataFrame:
    rows = running_total(df, tokens, *order)
    return rows.withColumn("chunk", F.expr(f"running div {limit}")).drop("running")


def growth_phases(days: DataFrame, gap: int = 7) -> DataFrame:
    """Bursts of activity: days less than ``gap`` days apart belong together."""
    spans = days.groupBy(F.session_window(F.col("created_at").cast("timestamp"), f"{gap} days").alias("w")).agg(F.count(F.lit(1)).alias("n_notes"), F.min("created_at").alias("first_day"), F.max("created_at").alias("last_day"))
    return spans.select("first_day", "last_day", "n_notes")


# The sections that may preserve what was captured, by kind; the first that is there counts.
PRESERVED = {
    "telegram": ("## Raw Capture",),
    "image": ("## Raw Capture",),
    "source": ("## Why This Was Captured", "## Page Content", "## Raw Capture"),
    "pdf": ("## Why This Was Captured", "## Extracted PDF Text", "## Raw Capture"),
}
LEAST_PROSE = 8


def checks(pairs: DataFrame) -> DataFrame:
    """``doc_id, body, markdown`` and perhaps ``kind`` to ``front_ok, clean_ok, verbatim_ok``, after a fence around the note is taken off.

    The body must stand, white space and case apart, in the section that preserves its kind (chat, where there is none). Of
    sources and documents the urls are left out, and what is then shorter than a few characters has nothing to preserve;
    so has an empty body.
    """
    kind = F.coalesce("kind", F.lit("telegram")) if "kind" in pairs.columns else F.lit("telegram")
    rows = pairs.select("doc_id", F.coalesce("body", F.lit("")).alias("body"), T.without_fence(F.col("markdown")).alias("m"), kind.alias("kind"))
    m, body = F.col("m"), F.col("body")
    lines = F.transform(F.split(m, "\n", 41), T.strip)  # forty lines and the rest
    front = (lines[0] == "---") & (F.array_position(F.slice(lines, 2, 39), "---") > 0)
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    corrupt = (count(m, "&nbsp;") > count(body, "&nbsp;")) | (count(m, r"\\[\[\]_*#]") > count(body, r"\\[\[\]_*#]"))
    prose = T.strip(T.strip_urls(body))
    kept = F.lit(None).cast("string")
    for name, headings in PRESERVED.items():
        kept = F.when(F.col("kind") == name, T.section(T.body(m), "Raw Capture") if len(headings) == 1 else W.first_section(m, headings)).otherwise(kept)
    quoting = F.col("kind").isin("source", "pdf")
    wanted = F.when(quoting, prose).otherwise(T.strip(body))
    nothing = (wanted == "") | quoting & (F.length(wanted) < LEAST_PROSE)
    verbatim = nothing | F.coalesce(F.contains(T.normalize(kept), T.normalize(wanted)), F.lit(False))
    return rows.select("doc_id", front.alias("front_ok"), (~corrupt).alias("clean_ok"), verbatim.alias("verbatim_ok"))


def validate(pairs: DataFrame, mode: str = "strict") -> DataFrame:
    """``doc_id, ok, reason``: the first check that fails, frontmatter, then corruption, then verbatim text.

    ``strict`` refuses such a note, ``lenient`` lets it pass and says why not, ``off`` checks nothing.
    """
    if mode not in ("strict", "lenient", "off"):
        raise ValueError(f"no mode {mode!r}")
    if mode == "off":
        return pairs.select("doc_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    reason = F.when(~F.col("front_ok"), "frontmatter").when(~F.col("clean_ok"), "corruption").when(~F.col("verbatim_ok"), "verbatim")
    return checks(pairs).select("doc_id", F.lit(True).alias("ok") if mode == "lenient" else reason.isNull().alias("ok"), reason.alias("reason"))


def number_images(images: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``name``: ``image-001.jpg`` and so on by ``day`` and ``extension``, in order of ``ts, message_id``, after the largest number
    that ``existing`` (day, extension, name) has there; other names there do not count.

    Positions are counted by ranges of day, extension and order, so that a busy hour is not one task.
    """
    taken = F.try_to_number(F.nullif(F.regexp_extract("name", r"^image-(\d{1,9})(?:-|\.|$)", 1), F.lit("")), F.lit("999999999")).cast("long")
    last = existing.groupBy("day", "extension").agg(F.max(taken).alias("last"))
    placed = earlier_in_group(images, F.lit(1), ["day", "extension"], "ts", "message_id", name="_before").join(last, ["day", "extension"], "left")
    number = F.coalesce("last", F.lit(0)) + F.col("_before") + 1
    return placed.withColumn("name", F.concat(F.format_string("image-%03d", number), "extension")).select(*images.columns, "name")


def theme_frequency(notes: DataFrame, examples: int = 3) -> DataFrame:
    """``theme, n_notes, share, place, examples``: in how many notes and in which share of them, its place (ties share one), and the first
    notes that have it.

    Places come from how many themes have each count, a table of far fewer rows than themes.
    """
    found = concepts(notes).withColumnRenamed("concept", "theme")
    counted = found.groupBy("theme").agg(F.count(F.lit(1)).alias("n_notes"))
    sizes = counted.groupBy("n_notes").agg(F.count(F.lit(1)).alias("themes"))
    places = sizes.select("n_notes", (1 + F.coalesce(F.sum("themes").over(Window.orderBy(F.desc("n_notes")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int").alias("place"))
    first = found.withColumn("i", F.row_number().over(Window.partitionBy("theme").orderBy("stem"))).where(F.col("i") <= examples)
    named = first.groupBy("theme").agg(F.array_join(F.array_sort(F.collect_list("stem")), ",").alias("examples"))
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    return counted.join(places, "n_notes").join(named, "theme").join(F.broadcast(total)).select("theme", "n_notes", F.round(F.col("n_notes") / F.col("total"), 6).alias("share"), "place", "examples")


def theme_lift(notes: DataFrame) -> DataFrame:
    """``a, b, n_notes, lift``: pairs of themes of one note, and how much more often they meet than if they were independent."""
    single = notes.select(F.explode(F.array_distinct("themes")).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    both = theme_pairs(notes).join(single.select(F.col("theme").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("theme").alias("b"), F.col("n").alias("n_b")), "b")
    lift = F.col("n_notes").cast("double") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
    return both.join(F.broadcast(total)).select("a", "b", "n_notes", F.round(lift, 6).alias("lift"))


def search_terms(notes: DataFrame, terms: Sequence[str], limit: int = 5, name: str = "stem", text: str = "raw_capture") -> DataFrame:
    """``term, rank, <name>``: the first ``limit`` notes by name whose name or text holds the term, case aside.

    One scan whatever the number of terms; each task keeps at most ``limit`` rows a term before the shuffle. Repeated terms count once,
    empty ones match every note; a note of null text can match by name. No terms or no notes give no rows.
    """
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]).cast("array<string>")
    holds = lambda c, t: F.coalesce(F.lower(F.col(c)).contains(F.lower(t)), F.lit(False))
    found = notes.select(name, F.explode(F.filter(wanted, lambda t: holds(name, t) | holds(text, t))).alias("term"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(name))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("term", "rank", name)
