"""Ranked lexical search: documents grouped by the mask of an item's terms they hold, masks evaluated from the highest bound down."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from ._common import bounded_batches, columns, materialise

TOP = 50
#: Items are searched in blocks of at most so many different terms, or of one item; so is what is broadcast at a time.
MOST_TERMS = 1 << 16
#: Documents, and entries of their terms, that a task looks at together.
_DOCS, _ENTRIES = 4096, 1 << 21
#: Terms are digits, ASCII letters in lower case, and all bytes of other characters; everything else parts them.
_LETTERS = bytes(b if chr(b).isascii() and chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return data.translate(_LETTERS).split()


@dataclass
class Items:
    """A block of items: their ids, the numbers of their terms, and the terms by number."""

    ids: list = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)


def item_blocks(items: DataFrame, item_id: str, text: str, most_terms: int = MOST_TERMS) -> Iterator[Items]:
    """The items in blocks whose different terms stay within ``most_terms``; an item of more is a block by itself."""
    block = Items()
    for row in items.select(*columns([item_id, text])).toLocalIterator():
        found = list(dict.fromkeys(terms_of((row[1] or "").encode())))
        if block.ids and len(block.number) + sum(t not in block.number for t in found) > most_terms:
            yield block
            block = Items()
        block.ids.append(row[0])
        block.terms.append(np.array([block.number.setdefault(t, len(block.number)) for t in found], np.int64))
    if block.ids:
        yield block


_SHARED: dict[str, object] = {}


def _once(name: str, shared: Broadcast, make=lambda x: x):
    """What is broadcast under a name, made ready once for each Python worker."""
    if name not in _SHARED:
        if len(_SHARED) > 1:
            _SHARED.clear()
        _SHARED[name] = make(shared.value)
    return _SHARED[name]


def term_entries(docs: DataFrame, number: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, times``: for each document with a term, how many terms it has, and those of ``number`` with how often.

    Whole texts; documents without a term, null ones included, have no row; repeated rows repeat. One narrow pass.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, name = spark.sparkContext.broadcast(number), uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _once(name, shared)
        for batch in batches:
            kept, sizes, terms, times, ends = [], [], [], [], [0]
            for at, data in enumerate(batch.column(1).cast(pa.binary()) if batch.num_rows else ()):
                words = terms_of(data.as_py() or b"")
                if words:
                    found = Counter(filter(known.__contains__, words))
                    kept.append(at)
                    sizes.append(len(words))
                    terms += map(known.__getitem__, found)
                    times += found.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return docs.select(*columns([doc_id, text])).mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, times array<int>")


class _Block:
    """Some documents of a task: their entries, what each is worth, and where each term occurs."""

    def __init__(self, batches: list[pa.RecordBatch], weight: np.ndarray, docs: int, words: int):
        table = pa.Table.from_batches(batches)
        self.keys = table["doc_id"].to_pylist()
        n = table["n"].to_numpy()
        lists = table["terms"].combine_chunks()
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.terms = lists.flatten().to_numpy().astype(np.int64)
        times = table["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), np.diff(self.ends))
        m = 50 + 50 * n * docs // words
        self.worth = weight[self.terms] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
        by_term = np.argsort(self.terms, kind="stable")
        self.row, self.start = row[by_term], np.searchsorted(self.terms[by_term], np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        np.maximum.at(self.most, self.terms, self.worth)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold any of the terms, and for each its mask: a bit for each term, in 64-bit words."""
        present = np.zeros((-(-len(terms) // 64) * 64, len(self.keys)), bool)
        for bit, t in enumerate(terms):
            present[bit, self.row[self.start[t] : self.start[t + 1]]] = True
        packed = np.ascontiguousarray(np.packbits(present, axis=0, bitorder="little").T).view("<u8")
        held = np.flatnonzero(packed.any(axis=1))
        return held, packed[held]

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The exact scores of documents; ``wanted`` marks the item's terms."""
        long = self.ends[rows + 1] - self.ends[rows]
        ends = np.cumsum(long)
        at = np.repeat(self.ends[rows] - (ends - long), long) + np.arange(int(long.sum()))
        sums = np.concatenate([[0], np.cumsum(np.where(wanted[self.terms[at]], self.worth[at], 0))])
        return sums[ends] - sums[ends - long]


def _rank(entry: tuple) -> tuple:
    """Highest score first, then the smallest id, null last."""
    score, key = entry
    return -score, key is None, key if key is not None else 0


def best_of_block(block: _Block, terms: np.ndarray, held: list[tuple], top: int, wanted: np.ndarray) -> list[tuple]:
    """The ``top`` best of ``held`` and the block for one item, as (score, doc_id).

    Documents are grouped by mask. A mask's bound is the sum of the most that each of its terms is worth in the block. Masks are
    evaluated, some at a time, from the highest bound down, until the bound is below the last score that is held: equal
    scores may still count, by id.
    """
    terms = terms[block.most[terms] > 0]  # terms of no worth here change no score
    if not len(terms):
        return held
    rows, masks = block.masks(terms)
    order = np.lexsort(masks.T)
    first = np.concatenate([[True], (masks[order][1:] != masks[order][:-1]).any(axis=1)])
    begins = np.flatnonzero(first)
    bits = np.unpackbits(np.ascontiguousarray(masks[order[begins]]).view(np.uint8), axis=1, bitorder="little")[:, : len(terms)]
    bounds = bits.astype(np.int64) @ block.most[terms]
    sizes = np.diff(np.concatenate([begins, [len(order)]]))
    ranked = np.argsort(-bounds, kind="stable")
    wanted[terms] = True
    at, many = 0, 2 * top
    while at < len(ranked):
        least = held[-1][0] if len(held) == top else 1
        if bounds[ranked[at]] < least:
            break
        to = at + 1 + int(np.searchsorted(np.cumsum(sizes[ranked[at:]]), many))
        to = min(to, at + int(np.searchsorted(-bounds[ranked[at:]], -least, side="right")))
        groups = ranked[at:to]
        at, many = to, 2 * many
        spread = np.cumsum(sizes[groups])
        mine = rows[order[np.repeat(begins[groups] - (spread - sizes[groups]), sizes[groups]) + np.arange(int(spread[-1]))]]
        scores = block.scores(mine, wanted)
        good = np.flatnonzero(scores >= least)
        if len(good) > top:  # ties at the last place are settled by id
            last = -np.partition(-scores[good], top - 1)[top - 1]
            good = good[scores[good] >= last]
        held = sorted([*held, *((int(scores[g]), block.keys[mine[g]]) for g in good)], key=_rank)[:top]
    wanted[terms] = False
    return held


def _best_of_tasks(entries: DataFrame, terms: list[np.ndarray], weight: np.ndarray, docs: int, words: int, top: int) -> DataFrame:
    """``item, doc_id, score``: for each item the best of each task, which carries what it holds from block to block."""
    spark = entries.sparkSession
    shared, name = spark.sparkContext.broadcast((terms, weight)), uuid.uuid4().hex
    kind = entries.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = _once(name, shared)
        held, wanted, schema = [[] for _ in asked], np.zeros(len(weights), bool), None

        def take(some: list[pa.RecordBatch]) -> None:
            block = _Block(some, weights, docs, words)
            for i, own in enumerate(asked):
                held[i] = best_of_block(block, own, held[i], top, wanted)

        waiting, rows, size = [], 0, 0
        for batch in batches:
            schema = batch.schema
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + len(batch.column(2).flatten())
            if rows >= _DOCS or size >= _ENTRIES:
                take(waiting)
                waiting, rows, size = [], 0, 0
        if rows:
            take(waiting)
        found = [(i, key, score) for i, best in enumerate(held) for score, key in best]
        for at in range(0, len(found), 10_000):
            item, key, score = zip(*found[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, schema.field(0).type), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return entries.mapInArrow(search, f"item long, doc_id {kind}, score long")


def _first(found: DataFrame, top: int, *group: str) -> DataFrame:
    ordered = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of each item with a score above 0, equal ones by ascending id.

    The texts are read once for each block of items: what a document holds of the block's terms becomes a narrow table,
    from which document counts, weights and scores come. Each task keeps the best of what it has seen; the best of all
    tasks are found in two steps, so that no task ranks an item's rows from a growing number of tasks alone.

    Null and empty texts hold no term: such documents are in no count, such items have no rows. Each row of ``items``
    is an item, so repeated ids give repeated rows; repeated documents each have a place; null ids come last among
    equals; other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    item_kind, doc_kind = (df.schema[c].dataType.simpleString() for df, c in ((items, item_id), (docs, doc_id)))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    for block in item_blocks(items, item_id, item_text, most_terms):
        entries = materialise(term_entries(docs, block.number, doc_id, text), "entries")
        total = entries.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        if not total["docs"]:
            return out
        weight = np.zeros(len(block.number), np.int64)
        for row in entries.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most MOST_TERMS, or one item's
            weight[row["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * row["count"] + 1)))
        found = _best_of_tasks(entries, block.terms, weight, total["docs"], total["words"], top)
        salt = F.pmod(F.spark_partition_id(), F.lit(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        found = _first(_first(found.withColumn("salt", salt), top, "item", "salt").drop("rank", "salt"), top, "item")
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {item_kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, h.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN held h USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = h.doc_id, total GROUP BY item_id, h.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
