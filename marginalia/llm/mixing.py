"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ._common import WORD, columns, fresh, materialise, running_sums

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source_key, source_size, target`` from rows of ``source_key, source, size``.

    Sources in code-point order, null last, take the weights in turn and share all words by weight. A source's target
    stops at ``max_repeats`` times its size and the excess is shared again. With sources ordered by cap / weight, the
    level (words for one unit of weight) at which this settles is the largest of "what is left over / weights left".
    The windows here run over one row for each source.
    """
    sources = sizes.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last(), "source_key")) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))
    weights_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    rows = rows.withColumn("level", left / weights_left)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(all_rows) * F.col("weight"))
    return rows.select("source_key", "source_size", target.alias("target"))


#: Virtual time is cut into buckets of 1 / SLOTS; all later than 2 is one bucket, which the budget rarely reaches.
SLOTS = 1 << 15


def _queued(rows: DataFrame, max_repeats: int, weights: tuple[int, ...]) -> DataFrame:
    """``rows`` (row, doc_id, source_key, source, size, at, text_hash) with their source's size and target and ``before``, written."""
    queued = running_sums(rows, ["source_key"], "at", F.col("size"), ("doc_id", "size", "text_hash"))
    targets = source_targets(rows, max_repeats, weights)
    return materialise(queued.join(targets, "source_key").select("row", "doc_id", "source_key", "size", "at", "source_size", "target", "before"), "queued")


def _turns(max_repeats: int) -> Column:
    """For each time a document may be taken: virtual finish time, source, words of its source up to its end."""
    def turn(e: int) -> Column:
        end = F.col("before") + F.col("size") + e * F.col("source_size")
        return F.struct(F.try_divide(end.cast("double"), F.col("target")).alias("finish"), F.col("source_key").alias("source"), end.alias("end"))

    return F.array(*[turn(e) for e in range(max_repeats)])


def _budget_cut(queued: DataFrame, max_repeats: int) -> Row | None:
    """Where the stream, sorted by virtual finish time, has given the total budget (all words): the document that stands
    across the cut and the words it still gives.

    Words are summed by slot of virtual time, partial sums first; only the slot in which the budget runs out, one part in
    tens of thousands of the stream, is sorted to find the document. A number and a row come to the driver.
    """
    stream = queued.where("size > 0").select("size", F.explode(_turns(max_repeats)).alias("t")).withColumn("slot", F.least(F.floor(F.col("t.finish") * SLOTS), F.lit(2 * SLOTS)))
    slots = stream.groupBy("slot").agg(F.sum("size").alias("words"))
    upto = slots.withColumn("cum", F.sum("words").over(Window.orderBy("slot")))
    budget = queued.agg(F.sum("size")).first()[0]
    full = upto.where(F.col("cum") >= budget).agg(F.min(F.struct("slot", (budget - F.col("cum") + F.col("words")).alias("left"))).alias("s")).first()["s"] if budget else None
    if full is None:
        return None
    last = stream.where(F.col("slot") == full["slot"]).withColumn("cum", F.sum("size").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return last.where(F.col("cum") >= full["left"]).agg(F.min(F.struct("t", (F.lit(full["left"]) - F.col("cum") + F.col("size")).alias("words"))).alias("cut")).first()["cut"]


def _cut_words(turn: Column, cut: Row | None) -> Column:
    """The words that a turn gives: all before the cut, none behind it."""
    if cut is None:
        return F.lit(0).cast("long")
    at = F.struct(F.lit(cut["t"]["finish"]).alias("finish"), F.lit(cut["t"]["source"]).alias("source"), F.lit(cut["t"]["end"]).alias("end"))
    return F.when(F.col("size") == 0, F.lit(0).cast("long")).when(turn < at, F.col("size")).when(turn == at, F.lit(cut["words"]).cast("long")).otherwise(F.lit(0).cast("long"))


def _rows(docs: DataFrame, row: Column, key: str, seed: str) -> DataFrame:
    position = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long") * 8
    return docs.select(row.alias("row"), F.col(key).alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source", n_words(F.col("text")).alias("size"), position.alias("at"), F.xxhash64("text").alias("text_hash"))


def mix_plan(docs: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, at, before, finish_time, taken``.

    Each source's documents are shuffled by a hash (``at``) and queued, over and over, up to ``max_repeats`` times. A turn's
    virtual finish time is the words of its source up to its end, divided by the source's target; ``before`` counts the words
    before it in the first pass. The stream of all turns in order of finish time (then source) is truncated where its
    running total reaches the budget, all words; the document on the cut gives its leading words. So a source takes
    its target give or take the document that its queue breaks in, and never more than its repeats allow. Null text
    has size 0, and a source without words target 0: it gives nothing; null sources are a source; equal rows queue one behind the other; an empty table gives no rows; other
    columns are ignored. Sums inside a source are bucketed, so a hot source is no hot group.
    """
    queued = _queued(materialise(_rows(docs, F.monotonically_increasing_id(), key, seed), "sizes"), max_repeats, weights)
    cut = _budget_cut(queued, max_repeats)
    taken = F.aggregate(_turns(max_repeats), F.lit(0).cast("long"), lambda n, t: n + _cut_words(t, cut))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    return queued.select("doc_id", "size", "source_size", "target", "at", "before", finish.alias("finish_time"), taken.alias("taken"))


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, in order of virtual finish time.

    Documents are written once with a number for each row, so that repeated rows, rows of one id and columns of any name
    keep apart; their texts are then shuffled twice, to meet their turns and for the global range sort. A document on the
    cut keeps its leading words, and its ``n_chars`` follows. Documents without words have nothing to give and are left
    out; an empty table gives no rows.
    """
    row, turn = fresh(docs.columns, "_row", "_turn")
    stored = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    queued = _queued(materialise(_rows(stored, F.col(row), key, seed), "sizes"), max_repeats, weights)
    cut = _budget_cut(queued, max_repeats)
    turns = queued.select(F.col("row").alias(row), "size", F.explode(_turns(max_repeats)).alias("t")).withColumn("words", _cut_words(F.col("t"), cut))
    turns = turns.where("words > 0").select(row, F.struct("t", "words", "size").alias(turn))
    # each piece: the blanks before a word, and the word
    lead = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col(f"{turn}.words").cast("int")), "")
    out = stored.join(turns, row).withColumn("text", F.when(F.col(f"{turn}.words") < F.col(f"{turn}.size"), lead).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.orderBy(f"{turn}.t").select(*columns(docs.columns))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce('=' || source, '') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{SEED}' || doc_id::VARCHAR), 1, 15))::BIGINT * 8 AS pos FROM documents),
s AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER r, 0))::DOUBLE / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER r, 0))::DOUBLE AS level
  FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l),
q AS (SELECT i, doc_id, k, size, sum(size) OVER (PARTITION BY k ORDER BY pos, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
u AS (SELECT i, k, size, upto + e * source_size AS fin, (upto + e * source_size)::DOUBLE / target AS finish FROM q JOIN t USING (k), (VALUES (0), (1), (2)) x(e) WHERE size > 0),
c AS (SELECT i, size, sum(size) OVER (ORDER BY finish, k, fin ROWS UNBOUNDED PRECEDING) AS cum FROM u),
g AS (SELECT i, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - cum + size)))::BIGINT AS taken FROM c GROUP BY i)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q JOIN t USING (k) LEFT JOIN g USING (i)"""
