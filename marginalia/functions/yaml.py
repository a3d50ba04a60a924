"""Nested frontmatter: YAML as a variant value."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

#: A line of flat frontmatter that means the same to every YAML reader: a plain word or words, or a list of them.
_WORDS = r"[A-Za-z][A-Za-z_-]*(?: [A-Za-z][A-Za-z_-]*)*"
_FLAT = rf"[A-Za-z_][A-Za-z0-9_-]*: (?:{_WORDS}|\[(?:{_WORDS}(?:, {_WORDS})*)?\])"
# Words that YAML 1.1 reads as something else than text.
_SPECIAL = r"(?im)(?:^|[\s\[,])(?:y|n|yes|no|on|off|true|false|null)(?=$|[\s\],:])"


def _plain(value: object) -> object:
    """What JSON can hold: dates as text, keys as text, sets as lists."""
    if isinstance(value, dict):
        return {str(_plain(k)) if not isinstance(k, bool) else str(k).lower(): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value != value or value in (float("inf"), float("-inf")):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def yaml_to_json(text: str | None) -> str | None:
    """The mapping that a YAML text holds, as JSON; null if it is broken or no mapping, ``{}`` if it is empty."""
    import yaml

    try:
        found = yaml.load(text or "", Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        found = {} if found is None else found
        return json.dumps(_plain(found), ensure_ascii=False) if isinstance(found, dict) else None
    except (yaml.YAMLError, ValueError, RecursionError, OverflowError):
        return None


def flat_json(text: Column) -> Column:
    """Flat frontmatter as JSON, without leaving the JVM; of repeated keys the last counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    keys = F.transform(lines, lambda x: F.substring_index(x, ": ", 1))
    values = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.substring(x, F.length(F.substring_index(x, ": ", 1)) + 3, F.length(x)), rf"({_WORDS})", '"$1"'), r"\s*,\s*", ","))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 1, F.size(keys)), x["k"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["v"])), ","), F.lit("}"))


def with_frontmatter(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` plus ``frontmatter`` (variant) and ``broken``.

    Lists, maps, quoted and multi-line values as YAML has them; times as text. Flat frontmatter of plain words is read by column
    expressions; only other frontmatter goes through the YAML library, in Arrow batches, never the body. A file without
    frontmatter has an empty mapping; frontmatter that is broken, or no mapping, is null and ``broken``.
    """

    @F.arrow_udf("string")
    def parsed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([yaml_to_json(t) if t is not None else None for t in batch.to_pylist()], pa.string())

    front = F.regexp_replace(T.frontmatter(F.coalesce(content, F.lit(""))), r"^\n+|\n+$", "")
    flat = F.col("_front").rlike(rf"\A(?:{_FLAT}\n)*{_FLAT}\z") & ~F.col("_front").rlike(_SPECIAL)
    rows = files.withColumn("_front", front).withColumn("_flat", F.coalesce((F.col("_front") == "") | flat, F.lit(False)))
    whole = T.frontmatter(F.coalesce(content, F.lit("")))  # a block of lines may end with a line end
    rows = rows.withColumn("_other", parsed(F.when(~F.col("_flat"), whole)))
    as_json = F.when(F.col("_front") == "", F.lit("{}")).when(F.col("_flat"), flat_json(F.col("_front"))).otherwise(F.col("_other"))
    found = F.try_parse_json(as_json)
    return rows.select(*[F.col(c) for c in files.columns], found.alias("frontmatter"), found.isNull().alias("broken"))


def admitted(files: DataFrame, rejects: str) -> DataFrame:
    """Files whose frontmatter can be read; the others are appended to ``rejects`` with the reason."""
    from ..sources.sinks import write_rejects

    found = with_frontmatter(files)
    reason = F.when(F.col("broken"), "frontmatter")
    write_rejects(found.select(*files.columns, reason.alias("reason")), rejects)
    return found.where(~F.col("broken")).drop("broken")
