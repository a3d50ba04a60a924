"""Runs of an analysis: dimensions with their phase and tier, costs, chunks, appendices, manifests, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import token_estimate, word_count
from .condense import filled
from .sampling import KEPT, SPREAD, BY_SCORE

# Each phase's dimensions with the tier they run in and the tokens they are expected to give.
PHASES = {
    "core-analysis": {"psychological": ("high", 8000), "emotional": ("high", 6000), "intellectual": ("low", 6000), "ethical": ("low", 5000), "spiritual": ("low", 5000), "philosophical": ("high", 6000), "visual": ("low", 4000)},
    "pattern-analysis": {"recurring_themes": ("low", 6000), "temporal_patterns": ("low", 5000), "contradiction_map": ("low", 5000), "blind_spots": ("low", 4000), "obsessions_avoidances": ("low", 4000)},
    "relational-analysis": {"external_perception": ("low", 5000), "communication_patterns": ("low", 4000), "relationship_dynamics": ("low", 4000), "social_presentation": ("low", 4000)},
    "synthesis": {"unified_portrait": ("high", 10000), "hidden_truths": ("high", 8000), "core_tensions": ("high", 6000), "essence_distillation": ("high", 5000)},
    "guidance": {"growth_opportunities": ("high", 6000), "shadow_work": ("high", 5000), "strength_amplification": ("low", 4000), "warning_signs": ("low", 4000), "actionable_practices": ("low", 6000)},
}
# Dollars for a million tokens in, cached, out.
PRICES = {"high": (5.0, 0.5, 25.0), "low": (3.0, 0.3, 15.0)}
OVERHEAD, CHUNK, CONTEXT, EXTRACT, COMPRESSION = 2000, 110_000, 150_000, 25_000, 0.15
ROWS = [(p, d, t, n) for p, ds in PHASES.items() for d, (t, n) in ds.items()]
#: What can be chosen; synthesis and guidance follow from it.
CHOOSABLE = tuple(d for p, d, _, _ in ROWS if p.endswith("-analysis"))


def dimension_table(spark: SparkSession) -> DataFrame:
    """``phase, dimension, tier, out_tokens``: 25 rows."""
    return spark.createDataFrame(ROWS, "phase string, dimension string, tier string, out_tokens long")


def select_dimensions(wanted: Column, has_images: Column) -> Column:
    """The chosen dimensions that exist, in the order asked for; all if none is asked for. The visual one needs images."""
    every = F.array(*map(F.lit, CHOOSABLE))
    chosen = F.when(wanted.isNull(), every).otherwise(F.array_intersect(wanted, every))
    return F.when(has_images, chosen).otherwise(F.array_remove(chosen, "visual"))


def with_phase(rows: DataFrame) -> DataFrame:
    """Add ``phase, tier`` to rows with a ``dimension``; unknown ones have no phase and run in the high tier."""
    known = dimension_table(rows.sparkSession).select("dimension", "phase", "tier")
    return rows.join(F.broadcast(known), "dimension", "left").withColumn("tier", F.coalesce("tier", F.lit("high")))


def _dollars(tier: Column, tokens_in: Column, tokens_out: Column, cached: float) -> Column:
    def price(at: int) -> Column:
        return F.when(tier == "high", PRICES["high"][at]).otherwise(PRICES["low"][at])

    return (tokens_in * (1 - cached) * price(0) + tokens_in * cached * price(1) + tokens_out * price(2)) / 1_000_000


def estimate_cost(tokens_in: Column, tokens_out: Column, cached: float | Column = 0.0, tier: Column | None = None) -> Column:
    """``min_cost, max_cost``: dollars with the share ``cached`` of the input (whole tokens, rounded down; held between 0 and 1) from the
    cache, and with none of it. Null tokens or shares give null."""
    tier = F.lit("high") if tier is None else tier
    share = cached if isinstance(cached, Column) else F.lit(float(cached))
    # greatest and least skip nulls, which must stay
    held = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    hit = F.floor(tokens_in * held)

    def price(at: int) -> Column:
        return F.when(tier == "high", PRICES["high"][at]).otherwise(PRICES["low"][at])

    out = tokens_out * price(2)
    return F.struct((((tokens_in - hit) * price(0) + hit * price(1) + out) / 1_000_000).alias("min_cost"), ((tokens_in * price(0) + out) / 1_000_000).alias("max_cost"))


def cost_rollup(totals: DataFrame, *keys: str, cached: float = 0.5) -> DataFrame:
    """``tokens`` of each corpus to calls, tokens and dollars by tier, with an extraction first and ``cached`` of the input cached at best.

    A corpus beyond the context is extracted in passes of ``CHUNK`` tokens; the analyses read 15 % of what fits.
    """
    t = F.col("tokens")
    passes = F.when(t > CONTEXT, F.floor(t / CHUNK) + 1).otherwise(1)
    kept = F.least(t, F.lit(CONTEXT))
    extract_in = F.when(t > CONTEXT, t).otherwise(kept) + OVERHEAD * passes
    each = F.floor(kept * COMPRESSION).cast("long") + OVERHEAD
    tiers = []
    for tier in PRICES:
        mine = [n for *_, x, n in ROWS if x == tier]
        first = tier == "high"
        tiers.append(F.struct(F.lit(tier).alias("tier"), F.lit(len(mine) + first).alias("calls"), (each * len(mine) + (extract_in if first else 0)).cast("long").alias("tokens_in"), (F.lit(sum(mine)) + (passes * EXTRACT if first else 0)).cast("long").alias("tokens_out")))
    rows = totals.select(*keys, F.explode(F.array(*tiers)).alias("t")).select(*keys, "t.*")
    cost = lambda c: _dollars(F.col("tier"), F.col("tokens_in"), F.col("tokens_out"), c)
    return rows.withColumn("min_cost", cost(cached)).withColumn("max_cost", cost(0.0))


def cost_full_content(totals: DataFrame, *keys: str, cached: float = 0.5) -> DataFrame:
    """The same without extraction: every call reads what fits, all in the high tier."""
    calls = len(ROWS)
    tokens_in = (F.least("tokens", F.lit(CONTEXT)) + OVERHEAD) * calls
    rows = totals.select(*keys, F.lit(calls).alias("calls"), tokens_in.cast("long").alias("tokens_in"), F.lit(sum(r[3] for r in ROWS)).cast("long").alias("tokens_out"))
    cost = lambda c: _dollars(F.lit("high"), F.col("tokens_in"), F.col("tokens_out"), c)
    return rows.withColumn("min_cost", cost(cached)).withColumn("max_cost", cost(0.0))


def within_budget(max_cost: Column, budget: Column) -> Column:
    return F.coalesce(max_cost <= budget, F.lit(True))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with content that did not fail."""
    return chunks.where((F.coalesce("content", F.lit("")) != "") & ~F.col("content").startswith("[Extraction failed"))


def combine_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """``key, chunk, content, tokens_in`` to one text for each key, its passes under numbered headings, and summed tokens.

    A key whose chunks all failed gets a fixed text and no tokens. A run has few chunks, so a group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk", "content")))
    good = valid_chunks(chunks).groupBy(key).agg(parts.alias("_p"), F.sum("tokens_in").alias("tokens_in"), F.count(F.lit(1)).alias("passes"))
    headed = F.transform("_p", lambda p, i: F.concat(F.lit("=== EXTRACTION PASS "), (i + 1).cast("string"), F.lit(" ===\n\n"), p["content"]))
    text = F.regexp_replace(F.array_join(headed, "\n\n\n\n"), r"\s+$", "")
    joined = chunks.select(key).distinct().join(good.select(key, text.alias("content"), "tokens_in", "passes"), key, "left")
    return joined.select(key, F.coalesce("content", F.lit("[All extractions failed]")).alias("content"), F.coalesce("tokens_in", F.lit(0)).cast("long").alias("tokens_in"), F.coalesce("passes", F.lit(0)).cast("long").alias("passes"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run whose name is a month; names that begin with ``_`` are no runs."""
    return runs.where(F.try_to_timestamp("run", F.lit("yyyy-MM")).isNotNull() & F.col("run").rlike(r"^\d{4}-\d\d$")).agg(F.max("run").alias("run"))


def citation_appendix(results: DataFrame) -> DataFrame:
    """``title, place, line``: the notes that each analysis cites, for a writer that orders by title and place."""
    return results.select("title", F.posexplode("cited_notes").alias("place", "note")).select("title", "place", F.concat(F.lit("- [["), "note", F.lit("]]")).alias("line"))


def confidence_appendix(results: DataFrame) -> DataFrame:
    """``title, line``: a table row with the confidence of each analysis and what went wrong."""
    note = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("Error: "), "error")).when(F.col("is_partial"), "Partial analysis").otherwise("")
    return results.select("title", F.concat(F.lit("| "), "title", F.lit(" | "), "confidence", F.lit(" | "), note, F.lit(" |")).alias("line"))


def analysis_frontmatter(columns: dict[str, Column], error: Column) -> Column:
    """Metadata as JSON; empty fields are left out, and a failed analysis says that it is partial."""
    said = {k: F.nullif(v.cast("string"), F.lit("")) for k, v in columns.items()}
    failed = F.coalesce(error, F.lit("")) != ""
    return F.to_json(F.struct(F.lit("analysis").alias("type"), *[v.alias(k) for k, v in said.items()], F.when(failed, error).alias("error"), F.when(failed, F.lit(True)).alias("is_partial")))


# The fields of a profile; the first list of a section holds required fields, the second optional ones, the third derived ones.
PROFILE_FIELDS = {
    "basic_identity": (("date_of_birth",), ("name", "gender_identity", "pronouns"), ("age",)),
    "physical": ((), ("height", "weight", "notable_traits"), ()),
    "location": ((), ("current_residence", "hometown", "places_lived", "cultural_background"), ()),
    "education": ((), ("highest_level", "fields_of_study", "institutions"), ()),
    "employment": ((), ("current_occupation", "career_summary"), ()),
    "family": ((), ("relationship_status", "children", "family_structure"), ()),
    "health_physical": ((), ("chronic_conditions", "medications", "allergies", "sleep_patterns", "exercise", "diet"), ()),
    "health_mental": ((), ("diagnosed_conditions", "current_treatment", "treatment_history", "substance_use"), ()),
    "interests": ((), ("interests", "dislikes"), ()),
    "goals": ((), ("short_term_goals", "long_term_goals", "life_vision"), ()),
    "life_events": ((), ("major_events",), ()),
}


def field_defs(spark: SparkSession) -> DataFrame:
    """``section, field, is_required, derived``."""
    rows = [(s, f, i == 0, i == 2) for s, lists in PROFILE_FIELDS.items() for i, fields in enumerate(lists) for f in fields]
    return spark.createDataFrame(rows, "section string, field string, is_required boolean, derived boolean")


def field_fill(values: DataFrame, key: str) -> DataFrame:
    """Every field of the catalog for every profile: ``value`` or null, and whether it is missing though required. Derived fields are left out.

    ``values`` has ``key, section, field, value``; others than catalog fields are dropped.
    """
    every = values.select(key).distinct().join(F.broadcast(field_defs(values.sparkSession).where("not derived").drop("derived")))
    found = values.groupBy(key, "section", "field").agg(F.min("value").alias("value"))
    value = F.when(filled(F.col("value")), F.col("value"))
    return every.join(found, [key, "section", "field"], "left").select(key, "section", "field", value.alias("value"), (F.col("is_required") & value.isNull()).alias("missing"))


def background(filled_fields: DataFrame, key: str) -> DataFrame:
    """``key, section, lines``: a profile document by section, with a default for what is not known."""
    line = F.concat(F.lit("- "), "field", F.lit(": "), F.coalesce("value", F.lit("Not provided")))
    grouped = filled_fields.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))).alias("l"))
    return grouped.select(key, "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def condensation_manifest(summaries: DataFrame, key: str) -> DataFrame:
    """``key, manifest``: files, words and a row for each category as JSON; ``summaries`` has ``category, content, confidence``."""
    row = F.struct("category", word_count(F.col("content")).alias("word_count"), "confidence")
    grouped = summaries.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("summaries"))
    words = F.aggregate("summaries", F.lit(0).cast("long"), lambda a, x: a + x["word_count"])
    return grouped.select(key, F.to_json(F.struct((F.size("summaries") + 1).alias("total_files"), words.alias("total_words"), "summaries")).alias("manifest"))


def extraction_ratio(content: Column, original_tokens: Column) -> Column:
    """Tokens of an extraction over those of what it was made from; 1 if that is empty."""
    return F.when(original_tokens == 0, 1.0).otherwise(token_estimate(word_count(content)) / original_tokens)


#: The types that a manifest counts, by the name they have there.
COUNTED = {"note": "notes", "reflection": "reflections", "tweet": "tweets", "image": "images"}


def run_manifest(items: DataFrame, attempts: DataFrame, limit: int, key: str = "run_id", cached: float = 0.0) -> DataFrame:
    """``key, content, sampling, analyses, cost``: what each run read, what it made, and what it spent, a row each run.

    ``items`` has ``key, source_type, token_estimate, created_at, kept`` (whether the sampler kept the item), ``attempts`` has
    ``key, dimension, seq, error, tokens_in, tokens_out``; of a dimension's attempts the last counts, and one with an error has failed.
    ``content`` counts what was kept, its tokens and days; ``sampling`` has the ratio aimed at (1 if everything fits ``limit``) and, if
    sampled, tokens and counts before and after. Hubs and unknown types count no tokens. A run may lack items (all counts
    0, no days) or attempts (no names, no cost). Two aggregates with partial counts; a run has few dimensions.
    """
    kind, tokens = F.col("source_type"), F.coalesce("token_estimate", F.lit(0))
    kept = F.coalesce("kept", F.lit(False))
    counts = [c for k, name in COUNTED.items() for c in (F.count_if(kept & (kind == k)).alias(name), F.count_if(kind == k).alias(f"_all_{name}"))]
    of = kind.isin(*BY_SCORE, *SPREAD) & ~kind.isin(*KEPT)
    summed = items.groupBy(key).agg(*counts, F.sum(F.when(of & kept, tokens).otherwise(0)).cast("long").alias("_tokens"), F.sum(F.when(of, tokens).otherwise(0)).cast("long").alias("_all"),
                                    F.min(F.when(kept & of, F.col("created_at"))).alias("_first"), F.max(F.when(kept & of, F.col("created_at"))).alias("_last"))
    last = attempts.groupBy(key, "dimension").agg(F.max_by(F.struct("error", "tokens_in", "tokens_out"), "seq").alias("_r"))
    failed = F.coalesce(F.col("_r.error"), F.lit("")) != ""
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("dimension"))))
    made = last.groupBy(F.col(key).alias("_key")).agg(names(~failed).alias("completed"), names(failed).alias("failed"), F.coalesce(F.sum("_r.tokens_in"), F.lit(0)).cast("long").alias("_in"), F.coalesce(F.sum("_r.tokens_out"), F.lit(0)).cast("long").alias("_out"))
    both = summed.join(made, F.col(key).eqNullSafe(F.col("_key")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sampled = F.coalesce(F.col("_all") > limit, F.lit(False))
    ratio = F.when(sampled, F.lit(limit) / F.col("_all") * 0.95).otherwise(1.0)
    listed = lambda mark: F.struct(*[zero(F.col(f"{mark}{name}")).alias(name) for name in COUNTED.values()])
    details = F.when(sampled, F.struct(F.col("_all").alias("original_tokens"), F.lit(limit).cast("long").alias("target_tokens"), listed("_all_").alias("original_counts"), listed("").alias("sampled_counts")))
    cost = estimate_cost(zero(F.col("_in")), zero(F.col("_out")), cached)
    empty = F.array().cast("array<string>")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        F.struct(*[zero(F.col(name)).alias(name) for name in COUNTED.values()], zero(F.col("_tokens")).alias("total_tokens"), F.struct(F.col("_first").alias("start"), F.col("_last").alias("end")).alias("date_range")).alias("content"),
        F.struct(sampled.alias("was_sampled"), ratio.alias("sampling_ratio"), details.alias("details")).alias("sampling"),
        F.struct(F.coalesce("completed", empty).alias("completed"), F.coalesce("failed", empty).alias("failed")).alias("analyses"),
        F.struct(zero(F.col("_in")).alias("total_input_tokens"), zero(F.col("_out")).alias("total_output_tokens"), ((cost["min_cost"] + cost["max_cost"]) / 2).alias("estimated_cost_usd")).alias("cost"))
