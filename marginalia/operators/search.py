"""Search for many terms at once through the words of notes, and through an inverted index of character trigrams, with verification, for terms that are no words."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import stable

GRAM = 3
#: Terms of at most so many letters are looked up in words; longer ones and those of other characters by their trigrams.
LONGEST = 32
#: Up to so many terms are broadcast.
BROADCAST = 500_000


@dataclass
class Index:
    """``notes``: note, name, text, words (the different runs of letters of name and text, case aside). Written once, read by every search.

    ``postings``: gram, note and ``sizes``: gram, n are written when the first search asks for a term that is no word.
    """

    notes: DataFrame
    name: str

    @cached_property
    def postings(self) -> DataFrame:
        """The trigrams of each note's name and text, and its shorter grams for terms that are shorter; each once a note."""
        low = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "text")]
        grams = F.array_distinct(F.concat(*[_grams(x, size) for x in low for size in range(1, GRAM + 1)]))
        return stable(self.notes.select("note", F.explode(grams).alias("gram")))

    @cached_property
    def sizes(self) -> DataFrame:
        return stable(self.postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def _grams(low: Column, size: int) -> Column:
    """All stretches of ``size`` characters, in one pass over the text."""
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1))


def build_index(notes: DataFrame, name: str = "stem", text: str = "raw_capture") -> Index:
    """One pass over the notes, which takes their words."""
    rows = notes.select(F.monotonically_increasing_id().alias("note"), F.col(name).alias("name"), F.col(text).alias("text"))
    words = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)) for c in ("name", "text")]
    return Index(stable(rows.withColumn("words", F.array_distinct(F.concat(*words)))), name)


def _by_words(index: Index, asked: DataFrame, limit: int) -> DataFrame:
    """``low, note, name``: for each of the words ``asked`` (low) its first ``limit`` notes by name, and others that rank with them.

    A run of letters is in a text just if it is part of one of the text's words. So each different word keeps its first notes,
    in each task before anything is shuffled, and is taken apart once: its stretches as long as some term meet the terms.
    """
    lengths = sorted(r[0] for r in asked.select(F.length("low")).distinct().collect())  # at most LONGEST
    if not lengths:
        return index.notes.select(F.lit("").alias("low"), "note", "name").limit(0)
    place = F.row_number().over(Window.partitionBy("word").orderBy("name", "note"))
    first = index.notes.select("note", "name", F.explode("words").alias("word")).withColumn("_place", place).where(F.col("_place") <= limit)
    held = first.groupBy("word").agg(F.collect_list(F.struct("name", "note")).alias("held"))  # at most ``limit`` a word
    starts = held.select("held", F.explode(F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{lengths[0]},{lengths[-1]}}}))"), F.lit(1))).alias("start"))
    parts = starts.select("held", "start", F.explode(F.lit(lengths)).alias("n")).where("length(start) >= n").select("held", F.expr("substring(start, 1, n)").alias("low"))
    lows = asked.select("low").distinct()
    found = parts.join(F.broadcast(lows) if asked.count() <= BROADCAST else lows, "low").select("low", F.inline("held"))
    rank = F.dense_rank().over(Window.partitionBy("low").orderBy("name", "note"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= limit).select("low", "note", "name").distinct()


def _by_grams(index: Index, asked: DataFrame) -> DataFrame:
    """``term, name``: all notes that hold a term (``asked``: term, low). A term's two rarest grams name the notes that may; those are verified."""
    size = F.length("low")
    own = F.when(size >= GRAM, _grams(F.col("low"), GRAM)).when(size == 2, _grams(F.col("low"), 2)).otherwise(_grams(F.col("low"), 1))
    held = asked.select("term", "low", F.explode(F.array_distinct(own)).alias("gram")).join(index.sizes, "gram", "left")
    found = held.groupBy("term", "low").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, 2).alias("rare"), F.count_if(F.col("n").isNull()).alias("missing"))
    found = stable(found.where("missing = 0").select("term", "low", F.col("rare")[0]["gram"].alias("gram"), F.get("rare", F.lit(1))["gram"].alias("second")))
    maybe = found.join(index.postings, "gram").select("term", "low", "note", "second")
    both = maybe.where("second is not null").join(index.postings.select(F.col("gram").alias("second"), "note"), ["second", "note"], "left_semi")
    maybe = maybe.where("second is null").select("term", "low", "note").union(both.select("term", "low", "note"))
    holds = lambda c: F.coalesce(F.lower(c).contains(F.col("low")), F.lit(False))
    return maybe.join(index.notes.drop("words"), "note").where(holds("name") | holds("text")).select("term", "name")


def search(index: Index, terms: DataFrame, limit: int = 5) -> DataFrame:
    """``term, rank, <name>``: for each of ``terms`` (term) the first ``limit`` notes by name that hold it in name or text, case aside.

    Words go by the notes' words: work goes with the different words of each note and the parts of all different words. For other
    terms it goes with what their rarest grams find. Neither goes with terms times notes, and a term with a gram that
    no note has costs nothing. Repeated terms count once; the empty term matches every note; null terms match none;
    repeated notes each have a place.
    """
    asked = stable(terms.where("term is not null").select("term", F.lower("term").alias("low")).distinct())
    word = F.col("low").rlike(rf"\A\p{{L}}{{1,{LONGEST}}}\z")
    hits = _by_words(index, asked.where(word), limit).join(asked, "low").select("term", "name")
    others = asked.where(~word & (F.col("low") != ""))
    if not others.isEmpty():
        hits = hits.union(_by_grams(index, others))
    first = index.notes.orderBy("name").limit(limit).select("name")
    hits = hits.union(asked.where("low = ''").select("term").join(F.broadcast(first)))  # one term, a few notes
    rank = F.row_number().over(Window.partitionBy("term").orderBy("name"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("term", "rank", F.col("name").alias(index.name))
