"""Canonical exact digests of documents, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import columns, fresh, materialise


def canonical(text: Column) -> Column:
    """Compatibility-composed Unicode, case folded, runs of white space as one blank, trimmed. Null is empty."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.regexp_replace(F.regexp_replace(again, r"(?U)\s+", " "), "^ | $", "")


def digest(canon: Column, seed: int = 0) -> tuple[Column, Column]:
    """128 bits as two numbers: xxhash64 of the canonical text from two seeds."""
    return F.xxhash64(F.lit(2 * seed), canon), F.xxhash64(F.lit(2 * seed + 1), canon)


def as_text(first: Column | str, second: Column | str) -> Column:
    """A digest as 32 hex digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (first, second)])


def clashing(rows: DataFrame) -> DataFrame:
    """The digests ``f1, f2`` under which ``canon`` has several values, byte by byte; usually none.

    Equal texts are reduced to one before and after the shuffle, so a text that a third of all rows share is one row of
    each task. Meant for rows of digests that occur more than once: a digest that occurs once needs no comparison.
    """
    return rows.groupBy("f1", "f2", "canon").agg(F.lit(1).alias("one")).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fingerprint(docs: DataFrame, text: str = "text", seeds: int = 4) -> DataFrame:
    """Add ``fingerprint``: equal for rows of equal canonical text and for no others.

    Digests alone are counted first; texts move only for digests that occur more than once, and are compared byte by
    byte. Should two texts share a digest, all digests are made again from other seeds. Null is the empty text; repeated
    rows share a fingerprint; an empty table stays empty. A column named fingerprint is replaced; columns of any other
    name stay as they are.
    """
    kept = [c for c in docs.columns if c != "fingerprint"]
    canon, first, second = fresh(docs.columns, "canon", "f1", "f2")
    for seed in range(seeds):
        f1, f2 = digest(F.col(canon), seed)
        rows = docs.withColumn(canon, canonical(F.col(text))).withColumn(first, f1).withColumn(second, f2)
        texts = rows.select(F.col(first).alias("f1"), F.col(second).alias("f2"), F.col(canon).alias("canon"))
        several = materialise(texts.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2"), "several")
        if several.isEmpty() or clashing(texts.join(several, ["f1", "f2"], "left_semi")).isEmpty():
            return rows.select(*columns(kept), as_text(first, second).alias("fingerprint"))
    raise ValueError(f"texts share 128-bit digests under {seeds} seeds")


def successors(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per row of ``docs`` and, as ``next``, its successor by ascending key; after the last comes the first.

    Columns: doc_id, n_chars, id, r1, r2 (the name of a text: its document and a 128-bit hash of its bytes), f1, f2
    (canonical digest), next (id, r1, r2, f1, f2 of the successor), several (others have this digest). Rows of one key,
    null keys included, follow by length and hash. Only numbers move, never texts. Rows are range-partitioned and
    written; a row's successor is the next in its partition, and each partition's last row looks to the first of the
    next one, a table of one row for each partition.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    f1, f2 = digest(F.col("canon"), seed)
    named = docs.select(F.col(key).alias("doc_id"), _name(key).alias("id"), whole.alias("text"), canonical(whole).alias("canon"))
    narrow = named.select("doc_id", "id", F.length("text").cast("long").alias("n_chars"), *_raw("text"), f1.alias("f1"), f2.alias("f2"))
    narrow = materialise(narrow, "narrow")  # the sample for the ranges would make all digests again
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(narrow.repartitionByRange(parts, "doc_id", "n_chars", "r1", "r2").withColumn("part", F.spark_partition_id()), "order")
    this = F.struct("id", "r1", "r2", "f1", "f2")
    inside = Window.partitionBy("part").orderBy("doc_id", "n_chars", "r1", "r2")
    heads = placed.groupBy("part").agg(F.min_by(this, F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "n_chars", "r1", "r2")).alias("head"))
    ahead = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(ahead), F.first("head").over(ahead)).alias("after"))
    rows = placed.withColumn("within", F.lead(this).over(inside)).join(heads, "part").withColumn("next", F.coalesce("within", "after"))
    several = placed.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2", F.lit(True).alias("several"))
    return rows.drop("part", "within", "after").join(several, ["f1", "f2"], "left")


def _name(key: str) -> Column:
    """A key as text, null told from all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _raw(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def fingerprint_with_edits(docs: DataFrame, seeds: int = 4) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A text is edited by replacing its last quarter with as many first characters of the next document's. An exact
    digest's likeness to another is 1 or 0. Texts are shuffled once, by document and hash, and that exchange serves both
    joins: every document sends heads to its predecessors (a quarter of their length each), then meets the head it got.
    Texts never lie in a window or a group; rows of null or repeated doc_id are dealt by their texts, and repeated rows
    share one text. Canonical texts are written only for digests that occur more than once, and compared byte by byte;
    should two differ, all digests are made again from other seeds. Null texts are empty; one document is its own next;
    an empty table gives no rows; other columns are ignored.
    """
    for seed in range(seeds):
        order = materialise(successors(docs, seed=seed), "next")
        whole = docs.select(_name("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        texts = whole.select("id", *_raw("text"), "text").groupBy("id", "r1", "r2").agg(F.first("text").alias("text"))
        asked = order.select(F.col("next.id").alias("id"), F.col("next.r1").alias("r1"), F.col("next.r2").alias("r2"), F.struct("doc_id", "n_chars", "id", "r1", "r2", "f1", "f2", F.col("next.f1").alias("n1"), F.col("next.f2").alias("n2"), "several").alias("by"))
        heads = texts.join(asked, ["id", "r1", "r2"]).select("by.*", F.expr("substring(text, 1, int(by.n_chars div 4))").alias("head"))
        both = texts.join(heads, ["id", "r1", "r2"]).withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 4))"), "head"))
        both = both.withColumn("edited_canon", canonical(F.col("edited")))
        e1, e2 = digest(F.col("edited_canon"), seed)
        found = materialise(both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f1", "f2", e1.alias("e1"), e2.alias("e2"), "n1", "n2", F.when(F.col("several"), canonical(F.col("text"))).alias("canon")), "digests")
        if clashing(found.where(F.col("canon").isNotNull())).isEmpty():
            same = lambda a, b: ((F.col("f1") == F.col(a)) & (F.col("f2") == F.col(b))).cast("double")
            return found.select("doc_id", "n_chars", "edited_sha256", as_text("f1", "f2").alias("fingerprint"), as_text("e1", "e2").alias("edited_fingerprint"), same("e1", "e2").alias("near_edited"), same("n1", "n2").alias("near_next"))
    raise ValueError(f"texts share 128-bit digests under {seeds} seeds")
