"""Column expressions over chat messages: type prefix, context lines and body."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# The types a first line can name, and the context fields a line can set.
TYPES = ("Thought", "Reflection", "Question", "Source", "Quote", "Idea", "Log", "Tweet")
FIELDS = ("surface", "mood", "energy", "confidence", "trigger", "context")


def _starts(line: Column, names: tuple[str, ...]) -> Column:
    return line.rlike(rf"(?i)^({'|'.join(names)}):")


def message_type(text: Column) -> Column:
    """The type that the first line names; ``Thought`` if none, or if the text is null."""
    named = F.regexp_extract(strip(text), rf"(?i)^({'|'.join(TYPES)}):", 1)
    return F.when(F.coalesce(named, F.lit("")) == "", F.lit("Thought")).otherwise(F.initcap(F.lower(named)))


def message_lines(text: Column) -> Column:
    """Stripped lines that are not blank, without the type prefix of the first."""
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"(?i)^({'|'.join(TYPES)}):", "")
    return F.filter(F.transform(F.split(bare, "\n"), strip), lambda x: x != "")


def message_field(lines: Column, name: str) -> Column:
    """The value of the last line that sets the field; null if none does."""
    found = F.filter(lines, lambda x: _starts(x, (name,)))
    return F.when(F.size(found) > 0, strip(F.regexp_replace(F.element_at(found, -1), r"^[^:]*:", "")))


def message_body(lines: Column) -> Column:
    """The lines that set no field."""
    return F.array_join(F.filter(lines, lambda x: ~_starts(x, FIELDS)), "\n")
