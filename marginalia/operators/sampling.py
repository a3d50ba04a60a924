"""Sampling of a corpus over time when it is beyond its token limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .catalog import edge_flag
from .order import earlier_in_group, evenly, row_index

#: What raises a note's score, each of which may be left out.
PRIORITIES = ("emotional_content", "hub_connectivity", "content_length")


def note_score(emotional: Column, mood: Column, links: Column, words: Column, energy: Column | None = None, prioritize: Sequence[str] = PRIORITIES) -> Column:
    """3 for emotional content, 1 for a mood or energy, 0.5 a link, 0.3 times the log of the words, as far as ``prioritize`` names
    them; rounded, so that ties are ties everywhere."""
    stated = lambda c: F.coalesce(c != "", F.lit(False))
    felt = stated(mood) if energy is None else stated(mood) | stated(energy)
    parts = {"emotional_content": F.when(emotional, 3.0).otherwise(0.0) + F.when(felt, 1.0).otherwise(0.0), "hub_connectivity": links * 0.5, "content_length": F.log1p(words) * 0.3}
    return F.round(reduce(lambda a, b: a + b, [parts[p] for p in PRIORITIES if p in prioritize], F.lit(0.0)), 6)


def scored(notes: DataFrame, prioritize: Sequence[str] = PRIORITIES) -> DataFrame:
    energy = F.col("energy") if "energy" in notes.columns else None
    return notes.withColumn("score", note_score(T.is_emotional(F.col("raw_capture")), F.col("mood"), F.size("hub_links"), F.col("word_count"), energy, prioritize))


def stratified_temporal_sample(rows: DataFrame, ratio: float, date: str = "created_at", key: str = "stem") -> DataFrame:
    """Keep the first and last tenth by date; of the rest, even positions of the list from best score to worst.

    ``max(1, int(n * ratio))`` rows in all, or the edges where they are more. ``rows`` has ``score``.
    """
    if ratio >= 1:
        return rows
    marked = edge_flag(rows, date, key)
    rest = row_index(marked.where(~F.col("is_edge")), F.desc("score"), date, key)
    n_edges = marked.where("is_edge").agg(F.count(F.lit(1)).alias("n_edges"))
    target = F.greatest(F.lit(1).cast("long"), F.floor((F.col("row_count") + F.col("n_edges")) * ratio)) - F.col("n_edges")
    chosen = rest.join(F.broadcast(n_edges)).where((target > 0) & evenly(F.col("row_index"), F.col("row_count"), target))
    return marked.where("is_edge").select(*rows.columns).unionByName(chosen.select(*rows.columns))


def sample_if_needed(rows: DataFrame, limit: int, tokens: str = "token_estimate", date: str = "created_at", key: str = "stem") -> DataFrame:
    """All rows up to ``limit`` tokens; beyond it a sample at 95 % of the share that fits. One number comes to the driver."""
    total = rows.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n")).first().n
    return rows if total <= limit else stratified_temporal_sample(rows, limit / total * 0.95, date, key)


#: Types that are sampled by score, their ends kept; types that are spread evenly; types that are kept whole and count no tokens.
BY_SCORE, SPREAD, KEPT = ("note", "reflection"), ("tweet", "image"), ("hub",)


def sample_types(items: DataFrame, limit: int, kind: str = "source_type", tokens: str = "token_estimate", date: str = "created_at", key: str = "id") -> DataFrame:
    """A sample over all types at one ratio: 95 % of the share of all tokens that fits ``limit``; all items if they fit.

    Of notes and reflections, each for itself, the first and last tenth by date stay, and even positions of the others from
    best score to worst fill up to the type's share (at least one); posts and images are spread evenly by date, unknown
    dates first; hubs all stay. Positions are counted within types by ranges of (type, order), so a type that holds nearly all
    items is many tasks' work; what is broadcast is one row for each type. ``items`` has ``score`` (null for the
    spread types); equal dates go by ``key``; items of other types, or of none, are left out.
    """
    known = items.where(F.col(kind).isin(*BY_SCORE, *SPREAD, *KEPT))
    total = known.where(~F.col(kind).isin(*KEPT)).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("n")).first()["n"]
    if total <= limit:
        return known
    ratio = limit / total * 0.95
    sizes = known.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_target", F.greatest(F.lit(1), F.floor(F.col("_n") * ratio)).cast("long")).withColumn("_edge", F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1)).cast("long"))
    placed = earlier_in_group(known, F.lit(1), [kind], F.col(date).asc_nulls_first(), key, name="_at").join(F.broadcast(sizes), kind)
    edge = (F.col("_at") < F.col("_edge")) | (F.col("_at") >= F.col("_n") - F.col("_edge"))
    whole = placed.where(F.col(kind).isin(*KEPT) | F.col(kind).isin(*BY_SCORE) & edge | F.col(kind).isin(*SPREAD) & evenly(F.col("_at"), F.col("_n"), F.col("_target")))
    rest = placed.where(F.col(kind).isin(*BY_SCORE) & ~edge)
    rest = earlier_in_group(rest, F.lit(1), [kind], F.desc("score"), F.col(date).asc_nulls_first(), key, name="_rank")
    edges = F.least(F.col("_n"), 2 * F.col("_edge"))
    left, wanted = F.col("_n") - edges, F.col("_target") - edges
    chosen = rest.where((wanted > 0) & evenly(F.col("_rank"), left, wanted))
    return whole.select(*items.columns).unionByName(chosen.select(*items.columns))
