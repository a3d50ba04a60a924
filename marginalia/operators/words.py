"""Words of texts: phrases of a lexicon found in one pass, and terms that two channels use differently."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A lexicon of at most so many characters is broadcast as a trie; a larger one is joined.
MOST_CHARS = 8_000_000
_TRIES: dict[str, dict] = {}


def tokens(text: Column) -> Column:
    """Words of letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def _trie(phrases: list[list[str]]) -> dict:
    """Nested maps from word to word; the number of a phrase stands under the empty word."""
    root: dict = {}
    for number, words in enumerate(phrases):
        at = root
        for w in words:
            at = at.setdefault(w, {})
        at[""] = number
    return root


def _found(words: list[str], root: dict) -> set[int]:
    out = set()
    for start, first in enumerate(words):
        at, i = root.get(first), start + 1
        while at is not None:
            if "" in at:
                out.add(at[""])
            at = at.get(words[i]) if i < len(words) else None
            i += 1
    return out


def phrase_counts(docs: DataFrame, lexicon: DataFrame, text: str = "text", phrase: str = "phrase", most_chars: int = MOST_CHARS) -> DataFrame:
    """``<phrase>, n_docs``: in how many documents each phrase of ``lexicon`` stands, word by word, case aside; 0 for none.

    The phrases' lengths are summed first. Up to ``most_chars`` they are broadcast as a trie over words, and each text is read
    once, from each word as far as some phrase goes; counts are added up in each task before the shuffle. A larger lexicon
    is joined with the texts' different stretches of the lengths that phrases have. Both ways give the same. Phrases without a word,
    and null ones, are in no document; phrases that differ in case or marks alone are counted alike; repeats come once.
    """
    asked = lexicon.select(phrase).distinct().withColumn("_words", tokens(F.col(phrase)))
    chars = asked.agg(F.coalesce(F.sum(F.length(phrase)), F.lit(0))).first()[0]
    keyed = asked.withColumn("_key", F.array_join("_words", " "))
    if chars <= most_chars:
        known = [r["_key"] for r in keyed.where("_key <> ''").select("_key").distinct().collect()]  # at most most_chars characters
        shared, name = docs.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _TRIES:
                _TRIES.clear()
                _TRIES[name] = _trie([k.split(" ") for k in shared.value])
            times: dict[int, int] = {}
            for batch in batches:
                for words in batch.column(0):
                    for number in _found(words.as_py(), _TRIES[name]):
                        times[number] = times.get(number, 0) + 1
            if times:
                yield pa.RecordBatch.from_arrays([pa.array([shared.value[i] for i in times]), pa.array(list(times.values()), pa.int64())], names=["_key", "n"])

        hits = docs.select(tokens(F.col(text)).alias("words")).mapInArrow(count, "_key string, n long")
    else:
        lengths = [r[0] for r in keyed.where("_key <> ''").select(F.size("_words")).distinct().collect()]  # few numbers
        stretch = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), " "))
        runs = F.array_distinct(F.concat(*[F.when(F.size("words") >= n, stretch(n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
        every = docs.select(tokens(F.col(text)).alias("words")).select(F.explode(runs).alias("_key"))
        hits = every.join(keyed.select("_key").distinct(), "_key", "left_semi").withColumn("n", F.lit(1))
    totals = hits.groupBy("_key").agg(F.sum("n").alias("n_docs"))
    return keyed.join(totals, "_key", "left").select(phrase, F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


def channel_contrast(texts: DataFrame, first: str, second: str, channel: str = "channel", text: str = "text", weight: float = 500.0) -> DataFrame:
    """``term, <first>, <second>, z``: how often each channel uses a term, and how far the log-odds of its use differ.

    The prior says that both use terms as all texts together do, with the weight of ``weight`` words; ``z`` is the difference
    in units of its deviation, above 0 where ``first`` uses the term more. So rare terms stay near 0 and frequent ones do not
    crowd out the others. Counts are partial before the shuffle; texts of other channels count nothing.
    """
    words = texts.where(F.col(channel).isin(first, second)).select(F.col(channel).alias("_c"), F.explode(tokens(F.col(text))).alias("term"))
    counts = words.groupBy("term").agg(F.count_if(F.col("_c") == first).alias(first), F.count_if(F.col("_c") == second).alias(second))
    totals = counts.agg(F.sum(first).alias("_n1"), F.sum(second).alias("_n2"))  # one row
    prior = F.lit(weight) * (F.col(first) + F.col(second)) / (F.col("_n1") + F.col("_n2"))
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.col(n) + F.lit(weight) - F.col(y) - prior))
    spread = F.sqrt(1 / (F.col(first) + prior) + 1 / (F.col(second) + prior))
    z = F.when(F.col("_n1") + F.col("_n2") > F.col(first) + F.col(second), (odds(first, "_n1") - odds(second, "_n2")) / spread).otherwise(F.lit(0.0))  # a single term has no odds
    return counts.join(F.broadcast(totals)).select("term", first, second, F.round(z, 4).alias("z"))
