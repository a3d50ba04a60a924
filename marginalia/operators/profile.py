"""Profiles of texts from sketches that add up: words that recur, how long messages are, how many ask something.

A table of sketches by, say, day and channel answers for any coarser grouping without reading the texts again
(:func:`text_sketches`, :func:`merged`, :func:`estimates`). :func:`recurring_words` and :func:`length_quantiles` use the sketches to
find what is worth counting and give exact rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import word_count
from .order import stable
from .words import tokens

#: Words that a sketch follows, and the size of a sketch of lengths.
TRACKED, SIZE = 8192, 2048
SUMS = ("n", "n_words", "n_questions", "n_terms")


def count_error(tracked: int = TRACKED) -> float:
    """How far a word's estimated count may lie above its true one, as a share of all words counted; never below it.
    A word that is more frequent than that is never missed."""
    return 3.5 / 2 ** ceil(log2(tracked / 0.75))


def rank_error(size: int = SIZE) -> float:
    """How far the rank of an estimated quantile may be off, as a share of the texts; holds 99 times in 100."""
    return 2.296 / size**0.9723


def text_sketches(texts: DataFrame, by: Sequence[str], text: str = "text", tracked: int = TRACKED, size: int = SIZE) -> DataFrame:
    """``by, n, n_words, n_questions, n_terms, heavy, lengths``: a row for each group, of bounded size whatever the group's.

    ``heavy`` follows the words of letters in lower case, ``lengths`` the number of words between blanks in each text. One pass,
    with partial sketches before the shuffle. A null text has no words; null is a group; an empty table gives no row.
    """
    long = word_count(F.col(text)).cast("long")
    rows = texts.select(*by, long.alias("_long"), F.coalesce(F.col(text).contains("?"), F.lit(False)).alias("_asks"), tokens(F.col(text)).alias("_tokens"))
    each = rows.select(*by, "_long", "_asks", F.posexplode_outer("_tokens").alias("_at", "_term")).withColumn("_first", F.coalesce(F.col("_at") == 0, F.lit(True)))
    return each.groupBy(*by).agg(
        F.count_if("_first").alias("n"), F.coalesce(F.sum(F.when(F.col("_first"), F.col("_long"))), F.lit(0)).alias("n_words"), F.count_if(F.col("_first") & F.col("_asks")).alias("n_questions"), F.count("_term").alias("n_terms"),
        F.expr(f"approx_top_k_accumulate(_term, {tracked}) FILTER (WHERE _term IS NOT NULL)").alias("heavy"), F.expr(f"kll_sketch_agg_bigint(_long, {size}) FILTER (WHERE _first)").alias("lengths"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, made of those of finer ones; the errors stay what they are."""
    return sketches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.expr("approx_top_k_combine(heavy)").alias("heavy"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def _quantile(at: Sequence[float]) -> Column:
    return F.expr(f"kll_sketch_get_quantile_bigint(lengths, array({', '.join(f'{min(max(q, 0.0), 1.0)!r}D' for q in at)}))")


def estimates(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.9, 0.99), top: int = 10, tracked: int = TRACKED, size: int = SIZE) -> DataFrame:
    """Replace the sketches by ``quantiles`` of the lengths with ``rank_error``, and ``recurring`` words (item, count) with ``count_error``."""
    known = sketches.withColumns({
        "quantiles": _quantile(quantiles), "rank_error": F.lit(rank_error(size)),
        "recurring": F.expr(f"approx_top_k_estimate(heavy, {top})"), "count_error": F.col("n_terms") * count_error(tracked)})
    return known.drop("heavy", "lengths")


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, in which null equals null; the keys come once."""
    other = right.select(*[F.col(c).alias(f"_of_{c}") if c in by else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_of_{c}"]) for c in by], F.lit(True))
    return left.join(other, same, how).drop(*[f"_of_{c}" for c in by])


def recurring_words(texts: DataFrame, by: Sequence[str], top: int = 10, text: str = "text", tracked: int = TRACKED, sketches: DataFrame | None = None) -> DataFrame:
    """``by, rank, term, n``: the ``top`` words of each group with their exact counts, equal ones by the alphabet.

    The sketch names the words that can be among them, most often a few more than ``top``, and only these are counted; they
    travel to the texts as one short list for each group. A group whose ``top``-th word the sketch cannot tell from a rare one
    (short or very even texts) is counted whole, so the rows are exact for every group.
    """
    sketches = stable(text_sketches(texts, by, text, tracked)) if sketches is None else sketches
    err = F.ceil(F.col("n_terms") * count_error(tracked))
    listed = sketches.select(*by, err.alias("_err"), F.expr(f"approx_top_k_estimate(heavy, {tracked})").alias("_items"))
    last = F.coalesce(F.get("_items", F.lit(top - 1))["count"], F.lit(0))
    judged = listed.withColumn("_least", last - F.col("_err")).withColumn("_sure", F.col("_least") > F.col("_err"))
    wanted = judged.where("_sure").select(*by, F.transform(F.filter("_items", lambda x: x["count"] >= F.col("_least")), lambda x: x["item"]).alias("_wanted"))
    rows = texts.select(*by, tokens(F.col(text)).alias("_tokens"))
    few = _joined(rows, wanted, by).select(*by, F.explode(F.filter("_tokens", lambda t: F.array_contains("_wanted", t))).alias("term"))
    rest = _joined(rows, judged.where(~F.col("_sure")).select(*by), by, "left_semi").select(*by, F.explode("_tokens").alias("term"))
    counted = few.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")).unionByName(rest.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, "rank", "term", "n")


def length_quantiles(texts: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, 0.9, 0.99), text: str = "text", size: int = SIZE, sketches: DataFrame | None = None) -> DataFrame:
    """``by, q, length``: the smallest length that a share of at least ``q`` of a group's texts does not exceed, exactly.

    The sketch gives a range of lengths three times its error to both sides. What lies below is counted as one number, and only the
    lengths inside are told apart. Should a rank lie outside its range, that group's lengths are all told apart. Windows run
    over different lengths with their counts, never over texts.
    """
    sketches = stable(text_sketches(texts, by, text, size=size)) if sketches is None else sketches
    slack = 3 * rank_error(size)
    ranges = sketches.withColumn("_low", _quantile([q - slack for q in quantiles])).withColumn("_high", _quantile([q + slack for q in quantiles]))
    ranges = ranges.select(*by, "n", F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), F.col("_low").alias("low"), F.col("_high").alias("high"))).alias("_r"))
    ranges = ranges.select(*by, F.col("_r.q").alias("q"), F.col("_r.low").alias("_low"), F.col("_r.high").alias("_high"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("_r.q"))).cast("long").alias("_rank"))
    counted = texts.select(*by, word_count(F.col(text)).cast("long").alias("length")).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("_c"))

    def reached(rows: DataFrame) -> DataFrame:
        """The first length of each group and share at which the running count reaches the rank."""
        upto = F.sum("_c").over(Window.partitionBy(*by, "q").orderBy("length"))
        return rows.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank")).groupBy(*by, "q", "_rank", "_low").agg(F.min("length").alias("length"))

    inside = _joined(counted, ranges, by).where(F.col("length") <= F.col("_high")).withColumn("length", F.greatest("length", F.col("_low") - 1))
    summed = inside.groupBy(*by, "q", "_rank", "_low", "length").agg(F.sum("_c").alias("_c"))
    found = reached(summed).where(F.col("length") >= F.col("_low")).select(*by, "q", "length")
    left = _joined(ranges, found.select(*by, "q"), [*by, "q"], "left_anti")
    return found.unionByName(reached(_joined(counted, left, by)).select(*by, "q", "length"))
