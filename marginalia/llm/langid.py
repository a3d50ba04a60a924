"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, columns, fresh

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


@dataclass(frozen=True)
class Limits:
    """Documented bounds: about how many whole documents a language learns from, and its longest n-grams. Nothing that
    these documents hold is left out of the model, so they bound its size too."""

    docs: int = 2000
    longest: int = 4


class Model(NamedTuple):
    """For each n (0: whole words) the strings known and their log frequency in each language. The strings are Arrow arrays:
    the driver hands them on and makes no Python string of each."""

    langs: list[str]
    names: dict[int, pa.Array]
    logs: dict[int, np.ndarray]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def counts(labelled: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, n, s, c``: how often a word (n = 0) or a word's n-gram occurs in the sampled documents of a language.

    A document is in the sample if a 53-bit hash of its key is below its language's share, however small that is. Words are
    counted first, then the n-grams of different words, by the words' counts. All in Spark.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (F.lit(float(limits.docs)) / F.col("n")).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit("langid")), 11) / F.lit(float(1 << 53))
    sample = rows.join(F.broadcast(sizes), "lang").where(draw < F.col("share"))  # one row a language
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))).alias("s"))
    words = words.groupBy("lang", "s").agg(F.count(F.lit(1)).alias("c"))
    padded = F.concat(F.lit("^"), F.col("s"), F.lit("$"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.struct(F.lit(n).alias("n"), F.substring(padded, i, F.lit(n)).alias("s")))
    parts = words.select("lang", "c", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("n"), "s")), *[pieces(n) for n in range(1, limits.longest + 1)])).alias("p"))
    return parts.where((F.col("p.n") == 0) | (F.length("p.s") == F.col("p.n"))).groupBy("lang", "p.n", "p.s").agg(F.sum("c").alias("c"))


def train(labelled: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on whole documents of ``labelled``, which has only rows to learn from; see :func:`counts`.

    What comes to the driver is the model: the strings of at most about ``limits.docs`` documents a language. Add one half
    to every count: what a language lacks is rare there, not impossible. Rows without language or text teach nothing.
    """
    found = counts(labelled, limits, key, text, lang).toArrow()
    lang_of = found["lang"].combine_chunks().dictionary_encode()
    langs = sorted(lang_of.dictionary.to_pylist())
    names, logs = {}, {}
    order = np.array([langs.index(x) for x in lang_of.dictionary.to_pylist()], dtype=np.intp)
    lang_at, n_of, c_of = order[lang_of.indices.to_numpy()], found["n"].to_numpy(), found["c"].to_numpy()
    for n in range(limits.longest + 1):
        mine = np.flatnonzero(n_of == n)
        coded = found["s"].take(pa.array(mine)).combine_chunks().dictionary_encode()
        names[n] = coded.dictionary
        table = np.zeros((len(names[n]), len(langs)))
        table[coded.indices.to_numpy(), lang_at[mine]] = c_of[mine]
        if len(table):
            total = table.sum(0) + 0.5 * len(table)
            table += 0.5
            table /= total
            np.log(table, out=table)
        logs[n] = table
    del found, lang_of, coded
    pa.default_memory_pool().release_unused()  # else the driver holds the space of the counts
    return Model(langs, names, logs)


class Scorer:
    """The model in a worker: one table row for each known word, and for unseen words met, up to a bound."""

    def __init__(self, model: Model):
        self.langs = model.langs
        self.grams = {n: dict(zip(model.names[n].to_pylist(), model.logs[n].tolist())) for n in sorted(model.names, reverse=True) if n}
        self.known = model.names[0].to_pylist()
        self.table = np.zeros((len(self.known) + _CACHE, len(self.langs)), np.float32)
        self.table[: len(self.known)] = model.logs[0]
        self.forget()

    def forget(self) -> None:
        self.row = dict(zip(self.known, range(len(self.known))))

    def unseen(self, word: str) -> list[float]:
        """The mean over the word's longest n-grams of which any is known; nothing if none is."""
        for n, found in self.grams.items():
            logs = [found[g] for g in grams(word, n) if g in found]
            if logs:
                return [sum(x) / len(logs) for x in zip(*logs)]
        return [0.0] * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(_LETTERS.findall(text.lower())) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        score, names = np.zeros(len(self.langs)), list(words)
        times = np.fromiter(words.values(), np.float64, len(names))
        for at in range(0, len(names), _CACHE):
            part = names[at : at + _CACHE]
            if len(self.row) + len(part) > len(self.table):
                self.forget()
            row = self.row
            for w in part:
                if w not in row:
                    self.table[len(row)] = self.unseen(w)
                    row[w] = len(row)
            score += times[at : at + _CACHE] @ self.table[np.fromiter(map(row.__getitem__, part), np.intp, len(part))]
        best = int(np.argmax(score))
        return self.langs[best], float(1 / np.exp(score - score[best]).sum())


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, shared: Broadcast) -> Scorer:
    """The scorer of a model, built once for each Python worker."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(shared.value)
    return _SCORERS[name]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred, score``: the most likely learned language of the whole text and its share of the likelihood.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Ties go to the first language in
    code-point order. Repeated rows get the same; an empty table gives no rows; columns named lang_pred or score are
    replaced, all others stay. One narrow pass; the model, whose size is bounded, is broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(name, shared)
        for batch in texts:
            found = [scorer.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    kept = columns(c for c in docs.columns if c not in ("lang_pred", "score"))
    [found] = fresh(docs.columns, "_found")
    return docs.withColumn(found, predict(F.col(text))).select(*kept, f"{found}.lang_pred", f"{found}.score")


def identify_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, then identify every row: ``docs`` plus held_out, lang_pred, score."""
    model = train(docs.where(~held_out()), limits)
    return identify(docs.withColumn("held_out", held_out()), model)
