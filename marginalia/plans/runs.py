"""Queries over runs of an analysis: dimensions, costs, chunks, appendices, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import word_count
from ..operators import catalog as C, condense, runs as R, sampling
from ..sources.standins import NOTES_SQL, note_files, read
from .analysis import A, TYPED_KEPT, TYPED_WITH, analyses, profiles, typed_items
from .registry import query

N = f"WITH {NOTES_SQL}"
_VALUES = ", ".join(f"('{p}', '{d}', '{t}', {n}, {i})" for i, (p, d, t, n) in enumerate(R.ROWS))
D = f"dims(phase, dimension, tier, out_tokens, i) AS (VALUES {_VALUES})"
_NAMES = [r[1] for r in R.ROWS]


def asked(s: SparkSession, d: str) -> DataFrame:
    """Documents that each name a dimension, or one that is not known."""
    i = F.col("doc_id") % 26
    return read(s, d, "documents").select("doc_id", F.when(i == 25, "astrology").otherwise(F.element_at(F.array(*map(F.lit, _NAMES)), (i % 25 + 1).cast("int"))).alias("dimension"))


@query(f"WITH {D} SELECT doc_id, phase FROM documents LEFT JOIN dims ON doc_id % 26 = i")
def route_phase(s, d):
    return R.with_phase(asked(s, d)).select("doc_id", "phase")


@query(f"WITH {D} SELECT doc_id, coalesce(tier, 'high') AS tier FROM documents LEFT JOIN dims ON doc_id % 26 = i")
def tier_for_dimension(s, d):
    return R.with_phase(asked(s, d)).select("doc_id", "tier")


@query(f"WITH {D}, a AS (SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN (SELECT list(dimension ORDER BY i) FROM dims WHERE phase LIKE '%-analysis') ELSE ['visual', 'emotional'] END) AS dimension FROM documents) SELECT doc_id, string_agg(dimension, ',' ORDER BY i) AS dimensions FROM (SELECT doc_id, dimension, CASE WHEN doc_id % 3 = 0 THEN i WHEN dimension = 'visual' THEN 0 ELSE 1 END AS i FROM a JOIN dims USING (dimension)) WHERE dimension <> 'visual' OR doc_id % 2 = 0 GROUP BY doc_id")
def select_dimensions(s, d):
    """All, or two of those asked for; the visual one only where there are images."""
    wanted = F.when(F.col("doc_id") % 3 != 0, F.array(*map(F.lit, ("visual", "astrology", "emotional", "unified_portrait"))))
    return read(s, d, "documents").select("doc_id", F.array_join(R.select_dimensions(wanted, F.col("doc_id") % 2 == 0), ",").alias("dimensions"))


@query(f"{A} SELECT DISTINCT run_id, category FROM analyses JOIN defs USING (i) WHERE category IN ('emotional', 'values')")
def select_categories(s, d):
    """Two chosen categories and one that is not known; those of a run without sources are dropped."""
    chosen = s.createDataFrame([("emotional",), ("values",), ("astrology",)], "category string")
    defs = condense.category_defs(s).join(F.broadcast(chosen), "category", "left_semi")
    return condense.gather_sources(analyses(s, d), defs).select("run_id", "category")


@query(f"{A} SELECT run_id, category, ['low', 'medium', 'high'][min(level)] AS confidence FROM analyses JOIN defs USING (i) GROUP BY ALL")
def category_confidence(s, d):
    return condense.gather_sources(analyses(s, d), condense.category_defs(s)).select("run_id", "category", "confidence")


def _totals(s, d):
    """Tokens of the notes of each source."""
    t = C.parse_notes(note_files(s, d)).join(note_files(s, d).select("path", "source"), "path")
    return t.groupBy("source").agg(F.sum("token_estimate").cast("long").alias("tokens"))


_TOTALS = f"{N}, t AS (SELECT source, sum(floor(words * 1.3::DOUBLE)::BIGINT)::BIGINT AS tokens FROM notes GROUP BY source)"
_PASSES = f"(CASE WHEN tokens > {R.CONTEXT} THEN tokens // {R.CHUNK} + 1 ELSE 1 END)"
_HIGH = [n for *_, t, n in R.ROWS if t == "high"]
_LOW = [n for *_, t, n in R.ROWS if t == "low"]
_COST = """{t}, r AS (SELECT source, 'high' AS tier, {nh} + 1 AS calls, ((floor(least(tokens, {ctx}) * 0.15::DOUBLE)::BIGINT + 2000) * {nh} + tokens + 2000 * {p})::BIGINT AS tokens_in, ({oh} + {p} * 25000)::BIGINT AS tokens_out, 5.0::DOUBLE AS a, 0.5::DOUBLE AS b, 25.0::DOUBLE AS c FROM t
 UNION ALL SELECT source, 'low', {nl}, ((floor(least(tokens, {ctx}) * 0.15::DOUBLE)::BIGINT + 2000) * {nl})::BIGINT, {ol}, 3.0, 0.3, 15.0 FROM t)
 SELECT source, tier, calls, tokens_in, tokens_out, round((tokens_in * 0.5::DOUBLE * a + tokens_in * 0.5::DOUBLE * b + tokens_out * c) / 1000000, 4) AS min_cost, round((tokens_in * a + tokens_out * c) / 1000000, 4) AS max_cost FROM r""".format(
    t=_TOTALS, nh=len(_HIGH), nl=len(_LOW), oh=sum(_HIGH), ol=sum(_LOW), p=_PASSES, ctx=R.CONTEXT)


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.withColumn("min_cost", F.round("min_cost", places)).withColumn("max_cost", F.round("max_cost", places))


@query(_COST)
def run_cost_rollup(s, d):
    """Calls, tokens and dollars by tier for the notes of each source."""
    return _rounded(R.cost_rollup(_totals(s, d), "source"))


@query(f"{_TOTALS}, r AS (SELECT source, {len(R.ROWS)} AS calls, ((least(tokens, {R.CONTEXT}) + 2000) * {len(R.ROWS)})::BIGINT AS tokens_in, {sum(r[3] for r in R.ROWS)}::BIGINT AS tokens_out FROM t) SELECT *, round((tokens_in * 0.5::DOUBLE * 5.5 + tokens_out * 25.0::DOUBLE) / 1000000, 4) AS min_cost, round((tokens_in * 5.0::DOUBLE + tokens_out * 25.0::DOUBLE) / 1000000, 4) AS max_cost FROM r")
def run_cost_full_content(s, d):
    return _rounded(R.cost_full_content(_totals(s, d), "source"))


@query(f"{_TOTALS}, r AS (SELECT source, ((least(tokens, {R.CONTEXT}) + 2000) * {len(R.ROWS)} * 5.0::DOUBLE + {sum(r[3] for r in R.ROWS)} * 25.0::DOUBLE) / 1000000 AS c FROM t) SELECT source, source IS NULL OR source = 'src0' OR c <= 4.2 AS ok FROM r")
def budget_check(s, d):
    """A budget of 4.20 dollars for each source; one has none and passes."""
    cost = R.cost_full_content(_totals(s, d), "source")
    budget = F.when(F.col("source") != "src0", 4.2)
    return cost.select("source", R.within_budget(F.col("max_cost"), budget).alias("ok"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    """Five documents are the chunks of a run; some failed, and every eleventh run failed as a whole."""
    i = F.col("doc_id")
    failed = ((i % 5) == 2) | (F.expr("doc_id div 5") % 11 == 0)
    return read(s, d, "documents").select(F.expr("doc_id div 5").alias("run"), (i % 5).cast("int").alias("chunk"), F.when(failed, "[Extraction failed: x]").otherwise(F.concat(F.lit("part "), i.cast("string"))).alias("content"), (i + 1).alias("tokens_in"))


_CH = "WITH c AS (SELECT doc_id // 5 AS run, doc_id % 5 AS chunk, 'part ' || doc_id AS content, doc_id + 1 AS tokens_in, doc_id % 5 <> 2 AND (doc_id // 5) % 11 <> 0 AS good FROM documents)"


@query(f"{_CH} SELECT run, chunk::INT AS chunk FROM c WHERE good")
def drop_failed_chunks(s, d):
    return R.valid_chunks(chunks(s, d)).select("run", "chunk")


@query(f"{_CH}, g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY chunk) AS p FROM c WHERE good) SELECT run, coalesce(string_agg('=== EXTRACTION PASS ' || p || ' ===' || chr(10) || chr(10) || content, chr(10) || chr(10) || chr(10) || chr(10) ORDER BY p), '[All extractions failed]') AS content, coalesce(sum(g.tokens_in), 0)::BIGINT AS tokens_in, count(p) AS passes FROM (SELECT DISTINCT run FROM c) LEFT JOIN g USING (run) GROUP BY run")
def combine_chunks(s, d):
    return R.combine_chunks(chunks(s, d), "run")


@query("SELECT max(strftime(ts, '%Y-%m')) AS run FROM events")
def latest_run(s, d):
    """Months of the events, and names that are none."""
    month = F.date_format("ts", "yyyy-MM")
    names = read(s, d, "events").select(F.explode(F.array(month, F.concat(F.lit("_"), month), F.concat(month, F.lit("-x")), F.lit("2099-13"))).alias("run"))
    return R.latest_run(names)


def results(s: SparkSession, d: str) -> DataFrame:
    """Documents as results of analyses: some failed, some are partial, some cite notes."""
    i = F.col("doc_id")
    t = i.cast("string")
    return read(s, d, "documents").select(
        F.concat(F.lit("T"), t).alias("title"), F.when(i % 5 == 0, "low").otherwise("high").alias("confidence"), F.when(i % 4 == 0, "limit").when(i % 4 == 1, "").alias("error"), (i % 3 == 0).alias("is_partial"),
        F.when(i % 2 == 0, F.array(F.lit("b"), t)).otherwise(F.array().cast("array<string>")).alias("cited_notes"), i.alias("doc_id"))


@query("SELECT 'T' || doc_id AS title, unnest([0, 1])::INT AS place, unnest(['- [[b]]', '- [[' || doc_id || ']]']) AS line FROM documents WHERE doc_id % 2 = 0")
def write_citation_appendix(s, d):
    return R.citation_appendix(results(s, d))


@query("SELECT 'T' || doc_id AS title, '| T' || doc_id || ' | ' || CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE 'high' END || ' | ' || CASE WHEN doc_id % 4 = 0 THEN 'Error: limit' WHEN doc_id % 3 = 0 THEN 'Partial analysis' ELSE '' END || ' |' AS line FROM documents")
def write_confidence_appendix(s, d):
    return R.confidence_appendix(results(s, d))


@query("""SELECT doc_id, '{"type":"analysis","title":"T' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"input_tokens":"' || doc_id || '"' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ',"error":"limit","is_partial":true' ELSE '' END || '}' AS front FROM documents""")
def analysis_frontmatter(s, d):
    tokens = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    return results(s, d).select("doc_id", R.analysis_frontmatter({"title": F.col("title"), "input_tokens": tokens}, F.col("error")).alias("front"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 2 END::INT AS sections FROM documents")
def parse_json_block(s, d):
    """Profiles in a fence, bare, or broken."""
    return profiles(s, d).select("doc_id", F.size(condense.json_block(F.col("profile"), condense.PROFILE)).alias("sections")).withColumn("sections", F.when(F.col("sections") >= 0, F.col("sections")))


_FIELDS = ", ".join(f"('{a}', '{f}', {str(i == 0).lower()})" for a, lists in R.PROFILE_FIELDS.items() for i, fs in enumerate(lists[:2]) for f in fs)
_FILL = f"fill AS (SELECT doc_id, section, field, CASE WHEN field = 'name' AND doc_id % 2 = 0 THEN lang WHEN field = 'date_of_birth' AND doc_id % 3 = 0 THEN '2000-01-01' END AS value, required FROM documents, (VALUES {_FIELDS}) v(section, field, required))"


def known_fields(s: SparkSession, d: str) -> DataFrame:
    """Each document as a profile with up to two known fields, an empty one and one that the catalog lacks."""
    i = F.col("doc_id")
    f = lambda section, field, value: F.struct(F.lit(section).alias("section"), F.lit(field).alias("field"), value.alias("value"))
    rows = F.array(f("basic_identity", "name", F.when(i % 2 == 0, F.col("lang")).otherwise("Not provided")), f("basic_identity", "date_of_birth", F.when(i % 3 == 0, "2000-01-01")), f("goals", "life_vision", F.lit("")), f("goals", "fame", F.lit("x")))
    return read(s, d, "documents").select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


@query(f"WITH {_FILL} SELECT doc_id, section, field, value, required AND value IS NULL AS missing FROM fill")
def field_fill(s, d):
    return R.field_fill(known_fields(s, d), "doc_id")


@query(f"WITH {_FILL} SELECT doc_id, section, string_agg('- ' || field || ': ' || coalesce(value, 'Not provided'), chr(10) ORDER BY field) AS lines FROM fill GROUP BY ALL")
def write_background(s, d):
    return R.background(R.field_fill(known_fields(s, d), "doc_id"), "doc_id")


@query(f"""{A}, g AS (SELECT run_id, category, ['low', 'medium', 'high'][min(level)] AS confidence, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')))::BIGINT AS w FROM analyses JOIN defs USING (i) GROUP BY ALL)
 SELECT run_id, '{{"total_files":' || (count(*) + 1) || ',"total_words":' || sum(w)::BIGINT || ',"summaries":[' || string_agg('{{"category":"' || category || '","word_count":' || w || ',"confidence":"' || confidence || '"}}', ',' ORDER BY category) || ']}}' AS manifest FROM g GROUP BY run_id""")
def write_condensation_manifest(s, d):
    return R.condensation_manifest(condense.gather_sources(analyses(s, d), condense.category_defs(s)), "run_id")


_RATIOS = (0.0, 0.25, 0.9, 1.0)


@query(f"{_TOTALS} SELECT source, cached, round((tokens - hit) * 5.0::DOUBLE / 1000000 + hit * 0.5::DOUBLE / 1000000 + (tokens // 10) * 25.0::DOUBLE / 1000000, 8) AS min_cost, round(tokens * 5.0::DOUBLE / 1000000 + (tokens // 10) * 25.0::DOUBLE / 1000000, 8) AS max_cost FROM (SELECT *, floor(tokens * cached)::BIGINT AS hit FROM t, (SELECT unnest({[*_RATIOS]}::DOUBLE[]) AS cached))")
def estimate_cost(s, d):
    """Reading the notes of each source, a tenth of it written, at four shares of cached input; eight places show each half millionth."""
    rows = _totals(s, d).withColumn("cached", F.explode(F.array(*map(F.lit, _RATIOS))))
    cost = R.estimate_cost(F.col("tokens"), F.expr("tokens div 10"), F.col("cached"))
    return _rounded(rows.select("source", "cached", cost.alias("c")).select("source", "cached", "c.*"), 8)


LIMIT = 50_000


def manifests(s: SparkSession, d: str) -> DataFrame:
    """One run over all items, sampled to 50,000 tokens; every document is an attempt at one of the dimensions, and failed if the number of
    its words can be divided by three."""
    every = typed_items(s, d)
    kept = sampling.sample_types(every, LIMIT).select("id", "source_type", F.lit(True).alias("kept"))
    items = every.join(kept, ["id", "source_type"], "left").withColumn("run_id", F.lit("all"))
    words = word_count(F.col("text")).cast("long")
    attempts = read(s, d, "documents").select(
        F.lit("all").alias("run_id"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int")).alias("dimension"), F.col("doc_id").alias("seq"),
        F.when(words % 3 == 0, "timed out").alias("error"), (words + R.OVERHEAD).alias("tokens_in"), F.length(F.coalesce("text", F.lit(""))).alias("tokens_out"))
    return R.run_manifest(items, attempts, LIMIT)


def flat(m: DataFrame) -> DataFrame:
    """A manifest in columns."""
    return m.select(
        *[F.col(f"content.{c}").alias(c) for c in ("notes", "reflections", "tweets", "images", "total_tokens")], F.col("content.date_range.start").cast("date").alias("first_day"), F.col("content.date_range.end").cast("date").alias("last_day"),
        "sampling.was_sampled", F.round("sampling.sampling_ratio", 6).alias("sampling_ratio"), F.col("sampling.details.original_tokens").alias("original_tokens"), F.col("sampling.details.original_counts.notes").alias("original_notes"),
        F.col("sampling.details.sampled_counts.tweets").alias("sampled_tweets"), F.array_join("analyses.completed", ",").alias("completed"), F.array_join("analyses.failed", ",").alias("failed"),
        F.col("cost.total_input_tokens").alias("tokens_in"), F.col("cost.total_output_tokens").alias("tokens_out"), F.round("cost.estimated_cost_usd", 6).alias("cost"))


_DIMS = ", ".join(f"({i}, '{name}')" for i, name in enumerate(_NAMES))
MANIFEST_SQL = f"""{TYPED_WITH}, kept AS ({TYPED_KEPT}), dims(i, dimension) AS (VALUES {_DIMS}),
 att AS (SELECT i.*, k.id IS NOT NULL AS kept FROM items i LEFT JOIN kept k ON k.id = i.id AND k.source_type = i.source_type),
 last AS (SELECT d.dimension, {{w}} % 3 = 0 AS failed, {{w}} + 2000 AS tokens_in, length(coalesce(text, '')) AS tokens_out FROM documents JOIN dims d ON doc_id % {len(_NAMES)} = d.i QUALIFY row_number() OVER (PARTITION BY d.dimension ORDER BY doc_id DESC) = 1),
 cnt AS (SELECT {', '.join(f"count(*) FILTER (kept AND source_type = '{k}') AS {n}" for k, n in R.COUNTED.items())}, coalesce(sum(tokens) FILTER (kept AND source_type <> 'hub'), 0)::BIGINT AS total_tokens,
 min(created_at) FILTER (kept) AS first_day, max(created_at) FILTER (kept) AS last_day, sum(tokens)::BIGINT AS original_tokens, count(*) FILTER (source_type = 'note') AS original_notes FROM att),
 res AS (SELECT coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (NOT failed), '') AS completed, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (failed), '') AS failed, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out FROM last)
 SELECT cnt.*, true AS was_sampled, round({LIMIT}::DOUBLE / original_tokens * 0.95::DOUBLE, 6) AS sampling_ratio, tweets AS sampled_tweets, res.*, round((tokens_in * 5.0::DOUBLE + tokens_out * 25.0::DOUBLE) / 1000000, 6) AS cost FROM cnt, res""".replace(
    "{w}", "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))")


@query(MANIFEST_SQL)
def corpus_manifest(s, d):
    """Counts, tokens, days, sampling, completed and failed dimensions, and cost of the whole corpus."""
    return flat(manifests(s, d))
