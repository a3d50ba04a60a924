"""Web pages: metadata by column expressions, main content as markdown by one parse of each page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import strip

# Where each field is looked for, in order of preference.
TITLE = (("property", "og:title"), ("name", "twitter:title"))
AUTHOR = (("name", "author"), ("property", "article:author"), ("name", "twitter:creator"), ("property", "og:article:author"))
DATE = (("property", "article:published_time"), ("name", "date"), ("name", "publish-date"), ("property", "og:article:published_time"))
DESCRIPTION = (("property", "og:description"), ("name", "description"), ("name", "twitter:description"))
SITE = (("property", "og:site_name"), ("name", "application-name"))


def _decode(text: Column) -> Column:
    """The five basic character references."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.nullif(strip(text), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))


def page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add title, author, date, description, site_name and domain; each is null where the page does not state it."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    metas = F.transform(tags, lambda t: F.struct(F.lower(_attribute(t, "property")).alias("property"), F.lower(_attribute(t, "name")).alias("name"), _attribute(t, "content").alias("content")))
    ld = F.regexp_extract(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    read = pages.withColumn("_metas", metas).withColumn("_ld", ld)

    def first(attr: str, key: str) -> Column:
        return _decode(F.get(F.filter("_metas", lambda m: m[attr] == key), F.lit(0))["content"])

    def stated(places) -> list[Column]:
        return [first(attr, key) for attr, key in places]

    head = _decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    time = _decode(F.regexp_extract(html, r"""(?is)<time\s[^>]*?datetime\s*=\s*["']([^"']*)["']""", 1))
    by = [F.nullif(F.get_json_object("_ld", p), F.lit("")) for p in ("$.author.name", "$.author")]
    return read.withColumns({
        "title": F.coalesce(*stated(TITLE), head), "author": F.coalesce(*by, *stated(AUTHOR)), "date": F.coalesce(*stated(DATE), time), "description": F.coalesce(*stated(DESCRIPTION)),
        "site_name": F.coalesce(*stated(SITE)), "domain": F.try_parse_url(url, F.lit("HOST"))}).drop("_metas", "_ld")


# What is dropped from a page, and the containers that may hold its content, in order of preference.
DROPPED_TAGS = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form"}
DROPPED_ROLES = {"navigation", "banner", "complementary", "contentinfo"}
DROPPED_CLASSES = {"navigation", "nav", "menu", "sidebar", "header", "footer", "advertisement", "ad", "social-share", "comments", "related-posts"}
DROPPED_IDS = {"comments", "sidebar", "navigation"}
CONTAINERS = (("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"), ("class", "content"), ("class", "post"), ("id", "content"), ("id", "main"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "body", "dl", "dd", "dt"}


class _Tree(HTMLParser):
    """Nodes ``(tag, attributes, children)``; text is a string among the children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [("", {}, [])]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _kept_nodes(root) -> Iterator[tuple]:
    """Nodes in page order, without those to be dropped; no recursion, as broken pages nest deeply."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node[2]) if not isinstance(c, str) and not _dropped(c)]


def _dropped(node) -> bool:
    tag, attrs, _ = node
    return tag in DROPPED_TAGS or attrs.get("role") in DROPPED_ROLES or attrs.get("id") in DROPPED_IDS or not DROPPED_CLASSES.isdisjoint(attrs.get("class", "").split())


def _fits(node, kind: str, value: str) -> bool:
    return node[0] == value if kind == "tag" else value in node[1].get("class", "").split() if kind == "class" else node[1].get(kind) == value


def _markdown(root) -> str:
    """Write a node's content as markdown; an explicit stack holds what comes after the open nodes."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, tuple) and item[0] == "":
            todo += reversed(item[2])
        elif isinstance(item, str):
            out.append(re.sub(r"\s+", " ", item))
        elif isinstance(item, list):
            out += item
        elif not _dropped(item):
            tag, attrs, children = item
            before = after = ""
            if re.fullmatch(r"h[1-6]", tag):
                before, after = f"\n\n{'#' * int(tag[1])} ", "\n\n"
            elif tag == "li":
                before, after = "\n  * ", ""
            elif tag in BLOCKS:
                before = after = "\n\n"
            elif tag in ("b", "strong"):
                before = after = "**"
            elif tag in ("i", "em"):
                before = after = "_"
            elif tag == "code":
                before = after = "`"
            elif tag == "br":
                before = "  \n"
            elif tag == "hr":
                before = "\n\n* * *\n\n"
            elif tag == "img":
                before = f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
            elif tag == "a" and attrs.get("href"):
                before, after = "[", f"]({attrs['href']})"
            out.append(before)
            todo.append([after])
            todo += reversed(children)
    return re.sub(r"(?m)^ (?! )", "", re.sub(r" *\n{3,}", "\n\n", re.sub(r" +\n\n", "\n\n", "".join(out))))


def _main(html: str | None) -> tuple[str, tuple]:
    """Which container holds a page's main content, and the node: the first kind present, else the body, else everything (no name)."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.open[0]
    nodes = list(_kept_nodes(root))
    for kind, value in (*CONTAINERS, ("tag", "body")):
        for node in nodes:
            if _fits(node, kind, value):
                return {"tag": value, "role": f'[role="{value}"]', "class": f".{value}", "id": f"#{value}"}[kind], node
    return "", root


def markdown(html: str | None) -> str:
    """Main content of one page as markdown."""
    return _markdown(("", {}, _main(html)[1][2]))


def _quoted(value: str) -> str:
    value = escape(value, quote=False)
    return f"'{value}'" if '"' in value and "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def _written(root) -> str:
    """A node as html again, without what is dropped; an explicit stack holds the ends of the open nodes."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            out += item
        elif isinstance(item, str):
            out.append(escape(item, quote=False))
        elif item is root or not _dropped(item):
            tag, attrs, children = item
            if tag:
                said = "".join(f" {k}={_quoted(v)}" for k, v in attrs.items())
                out.append(f"<{tag}{said}/>" if tag in VOID else f"<{tag}{said}>")
                todo.append([] if tag in VOID else [f"</{tag}>"])
            todo += reversed(children)
    return "".join(out)


def main_content(html: str | None) -> tuple[str, str]:
    """Container and html of one page's main content."""
    container, node = _main(html)
    return container, _written(node)


def clean_markdown(text: Column) -> Column:
    """No blanks at line ends, at most two empty lines in a row, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{4,}", "\n\n\n"))


def _parsed(parse: Callable[[str | None], tuple[str | None, ...]], *names: str):
    """``parse`` over batches of pages, its results by ``names``, beside the ``error`` of a page that cannot be parsed, which fails alone."""

    @F.arrow_udf(f"struct<{','.join(f'{name}:string' for name in names)},error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[tuple] = []
            for page in batch:
                try:
                    found.append((*parse(page.as_py()), None))
                except (ValueError, AssertionError) as e:  # html.parser on malformed declarations
                    found.append((*[None] * len(names), str(e)))
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(len(names) + 1)], names=[*names, "error"])

    return run


def page_main_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``container`` (as a selector; null if the page has none, nor a body), ``main_html`` and ``error``.

    ``main_html`` is the container with its own tags, without the elements that are dropped and without comments, references decoded
    and special characters escaped again. Null and empty pages give an empty text; pages that cannot be parsed give null and say why.
    """
    done = pages.withColumn("_x", _parsed(main_content, "container", "main_html")(F.col(html)))
    return done.withColumns({"container": F.nullif(F.col("_x.container"), F.lit("")), "main_html": F.col("_x.main_html"), "error": F.col("_x.error")}).drop("_x")


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Metadata, ``markdown_content``, ``success`` and ``error``; a page that cannot be parsed fails alone."""
    done = page_metadata(pages, html).withColumn("_x", _parsed(lambda page: (markdown(page),), "markdown_content")(F.col(html)))
    content = clean_markdown(F.col("_x.markdown_content"))
    return done.withColumns({"markdown_content": content, "success": F.coalesce(content != "", F.lit(False)), "error": F.coalesce(F.col("_x.error"), F.when(content == "", "no content"))}).drop("_x")
