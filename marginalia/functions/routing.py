"""Column expressions that decide where a capture goes and what is passed on with it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .messages import FIELDS
from .text import first_url, strip

MAX_BYTES = 20 * 1024 * 1024
MAX_PAGE_BYTES = 10 * 1024 * 1024
MAX_CHARS = 80_000


def in_range(when: Column, first: Column, last: Column, keep_null: bool = False) -> Column:
    """Whether a time lies between two others, both included; unknown times are kept only if asked for."""
    return F.coalesce(when.between(first, last), F.lit(keep_null))


def capture_kind(documents: Column, images: Column, type_: Column) -> Column:
    """``pdf`` before ``image`` before ``source``, else ``text``."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(documents), "pdf").when(some(images), "image").when(type_ == "Source", "source").otherwise("text")


def source_route(kind: Column, body: Column) -> Column:
    """Sources without a url are handled as text."""
    return F.when((kind == "source") & first_url(body).isNull(), "text").otherwise(kind)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_route(documents: Column) -> Column:
    """The first document counts: a pdf is read, anything else is handled as text; null without documents."""
    first = F.get(documents, F.lit(0))
    return F.when(first.isNotNull(), F.when(extension(first) == ".pdf", "pdf").otherwise("text"))


def unprocessable(path: Column, size: Column) -> Column:
    """Why a document is not read; null if it is."""
    return F.when(extension(path) != ".pdf", "type").when(size > MAX_BYTES, "size")


def refused_content(content_type: Column, size: Column) -> Column:
    """Why a page is not kept: not html, or too large; null if it is."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(~(kind.contains("text/html") | kind.contains("application/xhtml+xml")), "type").when(size > MAX_PAGE_BYTES, "size")


def context_lines(values: dict[str, Column]) -> Column:
    """A line for each context field that is set, in their fixed order."""
    return F.concat_ws("\n", *[F.when(F.coalesce(values[f], F.lit("")) != "", F.concat(F.lit(f"{f.capitalize()}: "), values[f])) for f in FIELDS if f in values])


NO_CONTEXT = "No context provided by user."


def _said(text: Column) -> Column:
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit(NO_CONTEXT)).otherwise(strip(text))


def url_context(body: Column, url: Column) -> Column:
    """What a user says beside the url, or a fixed sentence."""
    return _said(F.replace(body, url, F.lit("")))


def document_context(body: Column, name: Column) -> Column:
    """What a user says after ``PDF: name``, or a fixed sentence."""
    head, bare = F.concat(F.lit("PDF: "), name), strip(body)
    return _said(F.when(bare.startswith(head), F.substring(bare, F.length(head) + 1, F.length(bare))).otherwise(bare))


def truncated(text: Column, longest: int = MAX_CHARS) -> Column:
    """At most ``longest`` characters and a notice that more is left out."""
    notice = "\n\n[Content truncated - original was significantly longer]"
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit(notice))).otherwise(text)
