"""Column expressions over parts of notes: embeds, callouts, citations, leads, page sections, delimited blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import bullets, section, strip

# Image extensions.
IMAGES = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "heif")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def embeds(text: Column) -> Column:
    """Image references, first those in double brackets, then those in markdown; sizes after a bar are dropped."""
    kinds = "|".join(IMAGES)
    wiki = _all(text, rf"(?i)!\[\[([^\]|]+\.(?:{kinds}))(?:\|[^\]]*)?\]\]")
    plain = _all(text, rf"(?i)!\[[^\]]*\]\(([^)]+\.(?:{kinds}))\)")
    return F.transform(F.concat(wiki, plain), strip)


def embed_preview(found: Column, shown: int = 3) -> Column:
    """``2 image(s) (a.png, b.png)``; names beyond the first ``shown`` are counted."""
    names = F.transform(F.slice(found, 1, shown), lambda x: F.regexp_extract(x, r"([^/]+)$", 1))
    more = F.when(F.size(found) > shown, F.concat(F.lit(" + "), (F.size(found) - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(found) > 0, F.concat(F.size(found).cast("string"), F.lit(" image(s) ("), F.array_join(names, ", "), F.lit(")"), more)).otherwise("None")


def callouts(text: Column, kind: str = "insight") -> Column:
    """The lines inside callouts of a kind, without quote marks and bullets."""
    blocks = _all(text, rf"(?m)^> \[!{kind}\][^\n]*\n((?:>.*(?:\n|\z))*)")
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, "\n")))
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(x, "^>+", "")), "^-+", "")))
    return F.filter(bare, lambda x: x != "")


def citations(text: Column) -> Column:
    """Targets of links in the order they are first met."""
    return F.array_distinct(F.transform(_all(text, r"\[\[([^\]]+)\]\]"), lambda x: F.split(x, r"\|")[0]))


def note_links(text: Column) -> Column:
    """Targets of links that begin with a day, as notes do."""
    return F.filter(F.transform(_all(text, r"\[\[([^\]]+)\]\]"), lambda x: F.split(x, r"\|")[0]), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}"))


def lead(text: Column, longest: int = 1000) -> Column:
    """The text before its second heading, or its first characters where there is none."""
    at = F.locate("## ", text, 11)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, 1, longest))


def first_section(text: Column, headings: tuple[str, ...]) -> Column:
    """The text under the first of the headings that is there, up to the next heading of its level; null if none is."""

    def under(heading: str) -> Column:
        at = F.locate(heading, text)
        return F.when(at > 0, F.split(F.substring(text, at + len(heading), F.length(text)), "\n## ", 2)[0])

    return F.coalesce(*map(under, headings))


def summary(content: Column, snippet: int = 300) -> dict[str, Column]:
    """themes, snippet, hubs, images: what is said about a note when it is listed."""
    raw = F.coalesce(F.nullif(section(content, "Raw Capture"), F.lit("")), section(content, "Raw Reflection"))
    return {"themes": bullets(section(content, "Themes")), "snippet": F.substring(raw, 1, snippet), "hubs": section(content, "Related Hub Notes"), "images": embed_preview(embeds(content))}


def titled_stem(stem: Column) -> Column:
    """``2026-01-15--my-note`` as ``My Note``."""
    return F.initcap(F.replace(F.regexp_replace(stem, "^.*?--", ""), F.lit("-"), F.lit(" ")))


def first_line(text: Column, longest: int = 100) -> Column:
    """The first line that is neither blank nor a rule; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.startswith("---"))
    return F.substring(F.get(lines, F.lit(0)), 1, longest)


def page_section(snapshot: Column, head: Column, truncated: Column) -> Column:
    """The section on a kept page: links to what was kept, its head, and where the rest is.

    ``snapshot`` has folder, extracted and offline_html; all are null if nothing was kept.
    """
    link = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"- {name}: [["), c, F.lit("]]")))
    folder, extracted = snapshot["folder"], snapshot["extracted"]
    links = F.when(folder.isNotNull(), F.concat_ws("\n", F.concat(F.lit("- Saved snapshot: `"), folder, F.lit("/`")), link("Offline copy", snapshot["offline_html"]), link("Full extracted text", extracted)))
    said = F.coalesce(head, F.lit("")) != ""
    body = F.when(said, head).when(folder.isNull(), "*Page content could not be preserved.*")
    rest = F.when(said & truncated & extracted.isNotNull(), F.concat(F.lit("*Truncated — full text in [["), extracted, F.lit("]].*")))
    return F.concat(F.regexp_replace(F.concat_ws("\n\n", F.lit("## Page Content"), links, body, rest), r"\s+$", ""), F.lit("\n"))


BLOCK = "struct<name:string,reason:string,note_count:int,notes:array<string>,confidence:string>"


def suggestion_blocks(text: Column) -> Column:
    """Blocks between ``---`` with a line for each of HUB, REASON, NOTE_COUNT, NOTES, CONFIDENCE; those without a name or notes are dropped."""

    def value(block: Column, name: str) -> Column:
        return strip(F.regexp_extract(block, rf"(?s)(?:^|\n){name}:\s*(.+?)(?=\n[A-Z_]+:|$)", 1))

    def parse(block: Column) -> Column:
        notes = F.filter(F.transform(F.split(value(block, "NOTES"), ","), strip), lambda x: x != "")
        return F.struct(value(block, "HUB").alias("name"), value(block, "REASON").alias("reason"), notes.alias("notes"), F.lower(value(block, "CONFIDENCE")).alias("confidence"), value(block, "NOTE_COUNT").alias("count"))

    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "---"), parse), lambda b: (b["name"] != "") & (F.size(b["notes"]) > 0))
    return F.transform(found, lambda b: F.struct(b["name"].alias("name"), b["reason"].alias("reason"), b["count"].try_cast("int").alias("note_count"), b["notes"].alias("notes"), b["confidence"].alias("confidence")))


def date_folder(when: Column) -> Column:
    return F.date_format(when, "yyyy/MM/dd")


def relative(path: Column, root: str) -> Column:
    """The path below a root; as it is if it is not below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def wikilink(path: Column) -> Column:
    return F.concat(F.lit("[["), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("]]"))


def embed(path: Column) -> Column:
    return F.concat(F.lit("!"), wikilink(path))
