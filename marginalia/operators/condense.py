"""Analysis documents condensed into categories, profile fields, and the plan to resume a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The dimensions each category draws on, in order.
CATEGORIES = {
    "psychological": ("psychological", "hidden_truths", "blind_spots"),
    "emotional": ("emotional", "temporal_patterns"),
    "cognitive": ("intellectual", "recurring_themes"),
    "values": ("ethical", "spiritual", "philosophical"),
    "relational": ("relationship_dynamics", "communication_patterns", "social_presentation", "external_perception"),
    "challenges": ("growth_opportunities", "shadow_work", "warning_signs", "actionable_practices"),
    "themes": ("unified_portrait", "core_tensions", "essence_distillation", "contradiction_map", "obsessions_avoidances"),
}
# Phrases that admit thin evidence.
HEDGES = ("insufficient data", "limited evidence", "cannot determine", "unclear", "speculative")
DIMENSIONS = tuple(d for ds in CATEGORIES.values() for d in ds)


def confidence(items: Column, text: Column) -> Column:
    """``low``, ``medium`` or ``high`` by the number of items and of hedging phrases."""
    hedges = sum((F.coalesce(F.lower(text).contains(h), F.lit(False)).cast("int") for h in HEDGES), F.lit(0))
    return F.when((items < 50) | (hedges >= 3), "low").when((items < 200) | (hedges >= 1), "medium").otherwise("high")


#: Below so many items an analysis is warned of.
VOLUMES = ((10, "very few notes"), (50, "few notes"), (200, "some notes"))


def confidence_by(rows: DataFrame, group: str, text: str) -> DataFrame:
    """``<group>, n, level, warning``: :func:`confidence` of each group's items, a hedging phrase counting once for a group, and
    the warning for its volume. Null is a group; one pass, with partial counts."""
    hedged = [F.coalesce(F.max(F.lower(text).contains(h).cast("int")), F.lit(0)).alias(f"_h{i}") for i, h in enumerate(HEDGES)]
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *hedged)
    hedges = sum((F.col(f"_h{i}") for i in range(len(HEDGES))), F.lit(0))
    level = F.when((F.col("n") < 50) | (hedges >= 3), "low").when((F.col("n") < 200) | (hedges >= 1), "medium").otherwise("high")
    warning = F.lit(None).cast("string")
    for below, words in reversed(VOLUMES):
        warning = F.when(F.col("n") < below, words).otherwise(warning)
    return counted.select(group, "n", level.alias("level"), warning.alias("warning"))


def category_defs(spark: SparkSession) -> DataFrame:
    """``category, pos, dimension``: the fixed definitions, one row each source."""
    return spark.createDataFrame([(c, i, d) for c, ds in CATEGORIES.items() for i, d in enumerate(ds)], "category string, pos int, dimension string")


def gather_sources(analyses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each run's categories with their documents in the listed order and the lowest confidence among them.

    A category has at most five sources of a run, so a group is small. Unknown confidence counts as high.
    """
    order = F.coalesce(F.when(F.col("confidence") == "low", 1).when(F.col("confidence") == "medium", 2), F.lit(3))
    found = analyses.join(F.broadcast(defs), "dimension")
    parts = F.array_sort(F.collect_list(F.struct("pos", "dimension", "content")))
    grouped = found.groupBy("run_id", "category").agg(parts.alias("parts"), F.min(order).alias("least"))
    return grouped.select("run_id", "category", F.array_join(F.transform("parts", lambda p: p["dimension"]), ",").alias("sources"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"),
                          F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("least")).alias("confidence"))


def pending_dimensions(analyses: DataFrame) -> DataFrame:
    """``run_id, dimension`` that a run lacks."""
    runs = analyses.select("run_id").distinct().withColumn("dimension", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    return runs.join(analyses.select("run_id", "dimension"), ["run_id", "dimension"], "left_anti")


def corpus_mark(analyses: DataFrame) -> DataFrame:
    """``run_id, mark``: count, sum and exclusive or of the hashes of a run's documents, whatever their order; any edit changes it."""
    h = F.xxhash64("dimension", "content")
    parts = (F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))
    return analyses.groupBy("run_id").agg(F.concat_ws(":", *[x.cast("string") for x in parts]).alias("mark"))


def merged_results(saved: DataFrame) -> DataFrame:
    """``run_id, dimension, ok`` of an append-only table ``run_id, dimension, seq, error``: of what was saved more than once the last
    counts, and a result with an error is no result."""
    last = saved.groupBy("run_id", "dimension").agg(F.max_by(F.struct("error"), "seq").alias("last"))
    return last.select("run_id", "dimension", F.col("last.error").isNull().alias("ok"))


def resume_plan(phases: DataFrame, saved: DataFrame, checkpoints: DataFrame, now: DataFrame) -> DataFrame:
    """``run_id, position, phase, action, n_done, n_left, pending``: a row for each run and phase.

    ``phases`` has ``position, phase, dimension``; ``saved`` the results of all attempts (see :func:`merged_results`); ``checkpoints``
    ``run_id, seq, position, mark``, of which a run's last counts; ``now`` ``run_id, mark``: the runs, with the fingerprint of their
    corpus. Where the fingerprint differs, or there is no checkpoint, the run starts again and nothing saved counts (``restart``).
    Else phases up to the checkpoint are ``done``, whatever failed in them; in later ones what was saved is taken over,
    so the first of them that lacks something is resumed in its middle (``resume``), those behind it wait (``wait``), and
    those that lack nothing are done. ``pending`` lists what is left, by name.
    """
    last = checkpoints.groupBy("run_id").agg(F.max_by(F.struct("position", "mark"), "seq").alias("c"))
    runs = now.join(last, "run_id", "left").select("run_id", F.coalesce(F.col("c.mark") == F.col("mark"), F.lit(False)).alias("same"), F.col("c.position").alias("reached"))
    every = runs.crossJoin(F.broadcast(phases))  # a fixed list of some thirty rows beside each run
    found = every.join(merged_results(saved), ["run_id", "dimension"], "left")
    done = F.col("same") & ((F.col("position") <= F.col("reached")) | F.coalesce("ok", F.lit(False)))
    parts = found.groupBy("run_id", "same", "position", "phase").agg(F.count_if(done).alias("n_done"), F.count_if(~done).alias("n_left"), F.array_sort(F.collect_list(F.when(~done, F.col("dimension")))).alias("pending"))
    first = F.min(F.when(F.col("n_left") > 0, F.col("position"))).over(Window.partitionBy("run_id"))  # a run has a handful of phases
    action = F.when(~F.col("same"), "restart").when(F.col("n_left") == 0, "done").when(F.col("position") == first, "resume").otherwise("wait")
    return parts.select("run_id", "position", "phase", action.alias("action"), "n_done", "n_left", "pending")


PROFILE = "map<string,map<string,struct<value:string,confidence:string>>>"


def json_block(text: Column, schema: str) -> Column:
    """The JSON of a text, with or without a code fence around it; null if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(text), schema)


def profile_fields(profiles: DataFrame, key: str, text: str) -> DataFrame:
    """``{section: {field: {value, confidence} or null}}`` to rows ``key, section, field, value, confidence``."""
    sections = profiles.select(key, F.explode(json_block(F.col(text), PROFILE)).alias("section", "fields"))
    return sections.select(key, "section", F.explode("fields").alias("field", "f")).select(key, "section", "field", "f.value", "f.confidence")


def filled(value: Column) -> Column:
    return F.coalesce((value != "") & (value != "Not provided"), F.lit(False))
