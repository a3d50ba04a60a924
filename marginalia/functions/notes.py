"""Column expressions that build or rewrite notes: heads, names, dates, sections and links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import slug, strip, word_count


def head_by_words(text: Column, longest: int) -> Column:
    """``struct(head, truncated)``: leading paragraphs of at most ``longest`` words together; the first is always kept."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n\n")
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def take(seen: Column, paragraph: Column) -> Column:
        words = seen["words"] + word_count(paragraph)
        full = seen["full"] | ((seen["kept"] > 0) & (words > longest))
        return F.struct(words.alias("words"), (seen["kept"] + F.when(full, 0).otherwise(1)).alias("kept"), full.alias("full"))

    kept = F.aggregate(paragraphs, start, take, lambda seen: seen["kept"])
    return F.struct(F.array_join(F.slice(paragraphs, F.lit(1), kept), "\n\n").alias("head"), (kept < F.size(paragraphs)).alias("truncated"))


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` as ISO text, with 00 for what is missing of the time; null if there is no date."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{8,14})", 1)
    full = F.rpad(digits, 14, "0")
    part = lambda at, n: F.substring(full, at, n)
    return F.when(F.length(digits) >= 8, F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2)))


def age(born: Column, as_of: Column) -> Column:
    """Whole years between two days."""
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def safe_filename(name: Column, longest: int = 200) -> Column:
    """Nine characters that file systems refuse become ``_``; too long names keep their extension."""
    clean = strip(F.translate(name, '<>:"/\\|?*', "_" * 9))
    extension = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    return F.when(F.length(clean) <= longest, clean).otherwise(F.concat(F.substring(clean, F.lit(1), F.lit(longest) - F.length(extension)), extension))


# Media types of image extensions.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def media_type(path: Column, default: str = "image/jpeg") -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit(default))


def insert_before_rule(note: Column, section: Column) -> Column:
    """Put a section before the rule that ends a note, or at its end."""
    bare = F.regexp_replace(note, r"(?U)\s+$", "")
    above = F.regexp_replace(bare, r"\s*\n---$", "")
    return F.when(bare.rlike(r"\n---$"), F.concat(above, F.lit("\n\n"), section, F.lit("\n\n---\n"))).otherwise(F.concat(bare, F.lit("\n\n"), section, F.lit("\n")))


def upsert_link(note: Column, hub: Column, heading: str = "## Related Hub Notes") -> Column:
    """Add a link as the first line of the section, or a new section with it; a note that has the link stays as it is."""
    link = F.concat(F.lit("- [["), hub, F.lit("]]"))
    at = F.locate(f"{heading}\n", note)
    end = at + len(heading)
    inserted = F.concat(F.substring(note, F.lit(1), end), link, F.lit("\n"), F.substring(note, end + 1, F.length(note)))
    added = F.concat(F.regexp_replace(note, r"(?U)\s+$", ""), F.lit(f"\n\n{heading}\n"), link, F.lit("\n"))
    return F.when(F.contains(note, F.concat(F.lit("[["), hub, F.lit("]]"))), note).when(at > 0, inserted).otherwise(added)


def append_link(note: Column, hub: Column, heading: str = "Related Hub Notes") -> Column:
    """Add a link after the others of its section, in place of a placeholder, or in a new section; a note that has it stays as it is."""
    link = F.concat(F.lit("- [["), hub, F.lit("]]"))
    found = F.regexp_extract(note, rf"(?s)(## {heading}[^\n]*\n)(.*?)(?=\n##|\z)", 1)
    inside = F.regexp_extract(note, rf"(?s)(## {heading}[^\n]*\n)(.*?)(?=\n##|\z)", 2)
    at = F.locate(f"## {heading}", note)
    before, after = F.substring(note, F.lit(1), at - 1 + F.length(found)), F.substring(note, at + F.length(found) + F.length(inside), F.length(note))
    bare = F.regexp_replace(inside, r"(?U)\s+$", "")
    empty = (bare == "") | F.contains(inside, F.lit("(No hub suggestions"))
    placed = F.concat(before, F.when(empty, link).otherwise(F.concat(bare, F.lit("\n"), link)), F.lit("\n"), after)
    added = F.concat(F.regexp_replace(note, r"(?U)\s+$", ""), F.lit(f"\n\n## {heading}\n"), link, F.lit("\n"))
    return F.when(F.contains(note, F.concat(F.lit("[["), hub, F.lit("]]"))), note).when(found != "", placed).otherwise(added)


def note_filename(when: Column, title: Column, longest: int = 50) -> Column:
    """``YYYY-MM-DD--slug.md``."""
    return F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit("--"), slug(title, longest), F.lit(".md"))


# The sections of a new hub note.
HUB_SECTIONS = """

## What This Hub Is
A conceptual gathering place for notes that touch on this concept.

This hub does not assert a single definition or viewpoint.

## What This Hub Is Not
- Not a summary
- Not a conclusion
- Not authoritative

## Open Questions
- (leave empty)

## Linked Notes
- (leave empty)
"""


def hub_stub(name: Column, created: Column) -> Column:
    """The text of a new hub note, empty but for its headings."""
    return F.concat(F.lit("---\ntype: hub\nstatus: empty\ncreated_at: "), created.cast("string"), F.lit("\n---\n\n# "), name, F.lit(HUB_SECTIONS))
