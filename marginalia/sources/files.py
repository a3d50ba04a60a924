"""Readers of catalog folders, archives and finished runs. All of them read files in parallel and parse them as columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import archive as A, text as T
from ..functions.markup import IMAGES
from ..operators import catalog as C
from ..operators.condense import DIMENSIONS
from ..operators.order import stable

# Where an export may keep its posts, first match counts; phases of a run.
ARCHIVE_FILES = ("data/tweets.js", "data/tweet.js", "tweet.js", "tweets.js")
VAULT = ("notes", "reflections", "sources", "tweets")
CAPTURES = """id long, telegram_message_id long, tweet_id string, chat_id long, captured_at timestamp_ntz, type string, surface string, mood string, energy string, confidence string, trigger string, context string, body string,
 attachments array<struct<type:string,url:string>>, image_paths array<string>, document_paths array<string>"""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def markdown_files(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, content, mtime, folder`` of the markdown files right inside the folders; folders that are not there are passed over."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        return spark.createDataFrame([], "path string, content string, mtime timestamp, folder string")
    rows = spark.read.text(there, wholetext=True, pathGlobFilter="*.md")
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime"), F.element_at(F.split(path, "/"), -2).alias("folder"))


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    return markdown_files(spark, *[f"{root}/{f}" for f in VAULT])


def scan_notes(spark: SparkSession, folder: str, source_type: str = "note") -> DataFrame:
    """Parsed notes with ``source_type`` and the time they were made, from their text, their name or the file."""
    files = markdown_files(spark, folder)
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    made = C.created_at(F.col("content"), stem, F.col("mtime")).alias("made_at")
    return C.parse_notes(files, made).drop("created_at").withColumnRenamed("made_at", "created_at").withColumn("source_type", F.lit(source_type))


def scan_reflections(spark: SparkSession, folder: str) -> DataFrame:
    return scan_notes(spark, folder, "reflection")


def scan_tweets_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``tweet_id, created_at, text, path``; the id falls back to the stem."""
    files = markdown_files(spark, folder)
    stem, c = F.regexp_extract("path", r"([^/]+)\.md$", 1), F.col("content")
    text = F.coalesce(F.nullif(T.section(T.body(c), "Raw Capture"), F.lit("")), T.body(c))
    return files.select(F.coalesce(T.front_value(c, "tweet_id"), stem).alias("tweet_id"), C.created_at(c, stem, F.col("mtime")).alias("created_at"), text.alias("text"), "path")


def scan_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return C.parse_hubs(markdown_files(spark, folder))


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, format, size_bytes, created_at, token_estimate`` of image files at any depth; their bytes are not read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "path string, format string, size_bytes long, created_at timestamp, token_estimate int")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.where(kind.isin(*IMAGES)).select("path", kind.alias("format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"), F.lit(1000).alias("token_estimate"))


def content_folders(root: str, notes: bool = True, reflections: bool = True, tweets: bool = True, images: bool = True, hubs: str = "metadata_only") -> dict[str, str]:
    """The folders that a run reads; sources never, hubs only for their metadata."""
    wanted = {"notes": notes, "reflections": reflections, "tweets": tweets, "images": images, "hubs": hubs == "metadata_only"}
    return {name: f"{root}/{name}" for name, on in wanted.items() if on}


def scan_content(spark: SparkSession, root: str, **flags) -> dict[str, DataFrame]:
    """A table for each folder that a run reads."""
    readers = {"notes": scan_notes, "reflections": scan_reflections, "tweets": scan_tweets_markdown, "images": scan_images, "hubs": scan_hubs}
    return {name: readers[name](spark, folder) for name, folder in content_folders(root, **flags).items()}


def archive_file(spark: SparkSession, root: str) -> str | None:
    """The first of the places where an export keeps its posts; none if there is no such file."""
    return next((f"{root}/{f}" for f in ARCHIVE_FILES if exists(spark, f"{root}/{f}")), None)


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element, json``: the objects of a JSON array in one or more files, numbered in each, whatever stands around the array.

    Files are read in byte ranges, as pieces that end at a closing brace, so a large export is many tasks' work. Whether a piece
    begins inside a string depends on all quotes before it, and how deep it is on all brackets before it that are in no
    string: both are running sums over the pieces, by range of bytes and then over ranges, one small row each. A piece
    that closes the brace of an element, and those since the one before it, are that element. No escape reaches
    over a brace, so a piece's own marks are known without its neighbours.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    marks = F.split(bare, '"', -1)
    depth = lambda odd: F.aggregate(
        F.filter(marks, lambda x, i: i % 2 == odd), F.lit(0), lambda n, x: n + 2 * F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"[\[{\]}]")))
    quotes = (F.size(marks) - 1) % 2
    # outside: the brace at the piece's end closes something if the piece ends outside a string
    pieces = stable(raw.withColumn("quotes", quotes).withColumn("outside", depth(0) - F.when(quotes == 0, 1).otherwise(0)).withColumn("inside", depth(1) - F.when(quotes == 1, 1).otherwise(0)))
    within = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranges = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def behind(rows: DataFrame, value: str) -> DataFrame:
        """``file, start, earlier``: the sum of ``value`` over all ranges before."""
        return rows.groupBy("file", "start").agg(F.sum(value).alias("_sum")).select("file", "start", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("earlier"))

    rows = pieces.join(behind(pieces, "quotes"), ["file", "start"]).withColumn("quoted", (F.col("earlier") + F.coalesce(F.sum("quotes").over(within), F.lit(0))) % 2)
    rows = rows.withColumn("step", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))).select("file", "start", "at", "piece", "step", ((F.col("quoted") + F.col("quotes")) % 2 == 0).alias("closes"))
    rows = stable(rows)
    rows = rows.join(behind(rows, "step"), ["file", "start"]).withColumn("ends", (F.col("closes") & (F.col("earlier") + F.sum("step").over(upto) == 1)).cast("int")).drop("earlier")
    rows = stable(rows)
    rows = rows.join(behind(rows, "ends"), ["file", "start"]).withColumn("element", F.col("earlier") + F.coalesce(F.sum("ends").over(within), F.lit(0)))
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "piece"))), lambda x: x["piece"]), "}"), F.lit("}"))
    found = rows.groupBy("file", "element").agg(joined.alias("json"), F.max("ends").alias("ends")).where("ends = 1")
    return found.select("file", "element", F.regexp_replace("json", r"^[^{]*", "").alias("json"))


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """``tweet_id, text, created_at`` and more of the posts of an export, with or without its script wrapper and its inner objects.

    The export may be of any size and in several files: see :func:`json_elements`. Posts without an id or text are dropped.
    """
    rows = json_elements(spark, path).select(F.from_json("json", f"struct<tweet:struct<{_typed(A.POST)}>,{_typed(A.POST)}>").alias("x"))
    plain = F.struct(*[F.col(f"x.{n}") for n in _names(A.POST)])
    post = rows.select(F.coalesce("x.tweet", plain).alias("post"))
    f = A.post_fields(F.col("post"))
    return post.select(*[c.alias(k) for k, c in f.items()], A.post_date(F.col("post.created_at")).alias("created_at")).where("coalesce(tweet_id, '') <> '' and text <> ''")


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _typed(schema: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _fields(schema))


def _names(schema: str) -> list[str]:
    return [f.name for f in _fields(schema)]


# Documents whose file name is not their dimension's name, by the folder of their phase.
NAMED_OTHERWISE = {
    "core-analysis": {
        "psychological-profile": "psychological", "emotional-landscape": "emotional", "intellectual-portrait": "intellectual", "ethical-framework": "ethical",
        "spiritual-dimensions": "spiritual", "philosophical-orientation": "philosophical", "visual-patterns": "visual",
    },
    "pattern-analysis": {"obsessions-and-avoidances": "obsessions_avoidances"},
}


def scan_analysis_docs(spark: SparkSession, run: str, phases: tuple[str, ...]) -> DataFrame:
    """``phase, dimension, title, confidence, generated_at, content, known``: the documents of a run.

    The dimension goes by folder and file name; names that are not listed are taken as they are, with underscores. Confidence
    is medium where none is stated; a time that cannot be read is null.
    """
    files = markdown_files(spark, *[f"{run}/{p}" for p in phases])
    c, stem = F.col("content"), F.regexp_extract("path", r"([^/]+)\.md$", 1)
    listed = F.create_map(*[F.lit(x) for folder, names in NAMED_OTHERWISE.items() for name, dimension in names.items() for x in (f"{folder}/{name}", dimension)])
    dimension = F.coalesce(F.try_element_at(listed, F.concat("folder", F.lit("/"), stem)), F.replace(stem, F.lit("-"), F.lit("_")))
    title = F.coalesce(T.title(T.body(c)), F.initcap(F.replace(stem, F.lit("-"), F.lit(" "))))
    confidence = F.coalesce(T.front_value(c, "confidence"), F.lit("medium"))
    made = F.try_to_timestamp(F.regexp_replace(T.front_value(c, "generated_at"), "['\"]", ""))
    return files.select(F.col("folder").alias("phase"), dimension.alias("dimension"), title.alias("title"), confidence.alias("confidence"), made.alias("generated_at"), T.body(c).alias("content"), dimension.isin(*DIMENSIONS).alias("known"))


def scan_manifest(spark: SparkSession, run: str) -> DataFrame:
    """The manifest of a run with ``run_date``: the month that its folder names, else when it was made."""
    rows = spark.read.option("multiLine", True).schema("generated_at string, total_tokens long, note_count long").json(f"{run}/manifest.json")
    month = run.rstrip("/").rsplit("/", 1)[-1]
    return rows.withColumn("run_date", F.coalesce(F.try_to_timestamp(F.lit(month), F.lit("yyyy-MM")), F.try_to_timestamp("generated_at")))


def scan_captures(spark: SparkSession, path: str) -> DataFrame:
    """The queue with its typed columns; those that older files lack are null."""
    return spark.read.schema(CAPTURES).parquet(path)


def scan_document_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc string, page_no int, page_text string").parquet(path)
