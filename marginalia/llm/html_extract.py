"""Main text of web pages: blocks classified by stop words, length and links, then by their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, columns

# Function words of four languages.
STOP_WORDS = {
    "en": "a about all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more my no not of on one only or other our out over said she so some than that the their them then there these they this to two up was we were what when which who will with would you your",
    "fr": "a à ai alors au aux avec c ce ces cette comme d dans de des deux du elle en est et être eux fait il ils j je l la le les leur lui ma mais me même mes moi mon n ne nos notre nous on ont ou où par pas plus pour qu que qui s sa sans se ses si son sont sur ta te tout tu un une vos votre vous y",
    "de": "aber alle als also am an auch auf aus bei bin bis da das dass dem den der des die dies diese doch du durch ein eine einem einen einer es für hat haben ich ihr im in ist ja kann man mehr mein mit nach nicht noch nur ob oder ohne sehr sein sich sie sind so über um und uns unter vom von vor war was wenn wer werden wie wir wird zu zum zur",
    "es": "a al algo ante como con cuando de del desde donde dos el ella ellos en entre era es esa ese eso esta está este esto fue ha han hasta hay la las le les lo los más me mi muy no nos o para pero por porque que qué se ser si sí sin sobre son su sus también te tiene todo tu un una uno y ya yo",
}
# Elements without text of their own, elements that never hold main text, elements that end a block.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "xmp", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OUTSIDE = {"nav", "footer", "aside", "form", "head", "select", "button", "dialog", "menu", "datalist", "fieldset", "title"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE_OPEN = {"b", "i", "em", "strong", "span", "font", "u", "s", "small", "big", "tt", "code", "sub", "sup", "mark"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Parts of class and id names that mark what stands around an article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|adbox|adslot|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|nav|navbar|navigation|menu|topbar|toolbar|breadcrumbs?|footer|foot|site-?header|page-?header|masthead|sidebar|side-?bar|aside|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|popular|trending|teasers?|comments?|respond|disqus|replies|discussion|pagination|pager|widget|tags|skip-?link)(?:$|[\s_-])",
    re.I)
HEADER_MARK = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
# Names that tell a layout ("has-sidebar"); marks of other people's text, which may stand in articles of its own.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|without|no)[_-]", re.I)
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|adbox|adslot|sponsor(?:ed|s)?|promo(?:tion|s)?|related|recommend(?:ed|ations)?|popular|trending|teasers?|comments?|respond|disqus|replies|discussion)(?:$|[\s_-])", re.I)

# Words of names that say where or in what form something stands, not what it is.
FORM = re.compile(r"(?:^|(?<=[\s_-]))(?:area|bar|block|body|bottom|box|buttons?|container|content|form|grid|group|icons?|inline|inner|items?|left|links?|list|outer|panel|posts?|right|row|section|slot|text|top|unit|wrap|wrapper|[0-9]+)(?:$|[\s_-])", re.I)

_ATTR = re.compile(r"([^\s/>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE_TAG = re.compile(r"[>\"']")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")
_LETTERS = re.compile(r"[^\W\d_]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_SENTENCE = re.compile(r"[.!?。！？।؟…](?:\W|$)")
_LISTS = {"ul", "ol", "menu"}


@dataclass(frozen=True)
class Rules:
    """Thresholds of the two passes; densities are shares of words or characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.30
    stop_high: float = 0.32
    links: float = 0.2


@dataclass
class Block:
    text: str
    link_chars: int
    article: bool
    holder: int = -1  # the innermost element around it that its names exclude
    label: str = ""


@dataclass
class Holder:
    """An element that its class or id excludes."""

    parent: int
    others: bool  # names of other people's text: adverts, comments
    firm: bool  # a name says so as a whole, not in a part ("sidebar", not "sidebar-left" or "share-enabled")
    of_main: bool = False  # it holds the main element
    of_article: bool = False  # it holds an article that may be the page's own


def attributes(tag: str) -> dict[str, str]:
    """Whole attributes of a tag by lower-case name; of one name the first counts, as in browsers."""
    named: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(tag):
        named.setdefault(name.lower(), a or b or c)
    return named


def decode(text: str) -> str:
    """Character references decoded; numbers beyond all code points are the replacement character, as in browsers."""
    return html.unescape(_LONG_NUMBER.sub(lambda m: html.unescape(f"&#{m[0][2:].rstrip(';').lstrip('0') or '0'};") if len(m[0].strip("&#;").lstrip("0")) < 8 else "\ufffd", text))


class _Cursor:
    """Tokens of a page in time proportional to its length, however broken it is.

    What never closes is looked for once: after that, its kind is known to be absent from the rest of the page.
    """

    def __init__(self, page: str):
        self.page, self.absent, self.loose = page, set(), False

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag stands, quoted values skipped; -1 if there is none.

        After one value that never closes, quotes no longer count on this page.
        """
        start = at
        while not self.loose:
            if ">" in self.absent:
                return -1
            mark = _INSIDE_TAG.search(self.page, at)
            if not mark:
                break
            if mark[0] == ">":
                return mark.start()
            closed = self.find(mark[0], mark.end())
            if closed < 0:
                break
            at = closed + 1
        self.loose = True
        return self.find(">", start)

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """``(kind, name or text, attributes)``: text, cdata, open, close or empty (``<x/>``)."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                lt = end
            if lt > at:
                yield "text", page[at:lt], ""
            if lt == end:
                return
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                close = self.find("-->", lt + 2)
                at = end if close < 0 else close + 3
            elif page.startswith("<![CDATA[", lt) and (close := self.find("]]>", lt + 9)) >= 0:
                yield "cdata", page[lt + 9 : close], ""
                at = close + 3
            elif after in ("!", "?"):
                close = self.find(">", lt + 2)
                at = end if close < 0 else close + 1
            else:
                closing = after == "/"
                name = _NAME.match(page, lt + 1 + closing)
                if not name:
                    yield "text", "<", ""
                    at = lt + 1
                    continue
                close = self.tag_end(name.end())
                if close < 0:  # a tag that the page's end cuts off
                    return
                tag, inner, at = name[0].lower(), page[name.end() : close], close + 1
                yield "close" if closing else "empty" if inner.endswith("/") else "open", tag, inner
                if tag in RAW and not closing and not inner.endswith("/"):
                    over = _RAW_END[tag].search(page, at)
                    close = self.find(">", over.end()) if over else -1
                    at = end if close < 0 else close + 1


class _Open(NamedTuple):
    tag: str
    excluded: bool
    article: bool
    link: bool
    holder: int


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without what stands in excluded elements. One pass over the tags, linear in the page.

    An element that its names alone exclude stays if it holds the main element, or the page's only articles. On a page
    without either it stays if only parts of its names say so and it holds most of the running text (for parts that name
    adverts or comments: all of it).
    """
    out, holders, seen = _blocks(page)
    kept = _kept(out, holders, seen) if holders else set()
    shut: list[bool] = []  # a holder stands behind the one around it
    for i, h in enumerate(holders):
        shut.append(i not in kept or h.parent >= 0 and shut[h.parent])
    return [b for b in out if b.holder < 0 or not shut[b.holder]]


def _kept(out: list[Block], holders: list[Holder], seen: bool) -> set[int]:
    """The excluded elements that stay after all."""
    kept = {i for i, h in enumerate(holders) if h.of_main} or ({i for i, h in enumerate(holders) if h.of_article} if not seen else set())
    if not kept and not seen:
        weight, total, lists = [0] * len(holders), 0, _stop_lists()
        for b in out:
            if _is_running_text(b, Rules(), lists):
                total += len(b.text)
                if b.holder >= 0:
                    weight[b.holder] += len(b.text)
        for i, h in enumerate(holders):
            if weight[i] and not h.firm and (2 * weight[i] > total and not h.others or weight[i] == total):
                while i >= 0 and i not in kept:  # what stands around it holds as much
                    kept.add(i)
                    i = holders[i].parent
    return kept


def _blocks(page: str) -> tuple[list[Block], list[Holder], bool]:
    """All blocks but those in elements excluded by their kind; the elements excluded by names; whether an article or
    main element stands in neither."""
    out: list[Block] = []
    holders: list[Holder] = []
    stack: list[_Open] = []
    count: Counter = Counter()  # open elements by tag
    items: list[int] = []  # where lists and list items stand in the stack
    parts: list[tuple[str, bool]] = []
    seen = False
    here = root = _Open("", False, False, False, -1)

    def close() -> None:
        if parts:
            text = " ".join(decode("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(" ".join(decode(p).split())) for p, in_link in parts if in_link)
                out.append(Block(text, linked, here.article, here.holder))
            parts.clear()

    def cut(depth: int) -> None:
        nonlocal here
        for x in stack[depth:]:
            count[x.tag] -= 1
        del stack[depth:]
        while items and items[-1] >= depth:
            items.pop()
        here = stack[-1] if stack else root

    for kind, tag, inner in _Cursor(page).tokens():
        if kind in ("text", "cdata"):
            if not here.excluded:
                parts.append((tag if kind == "text" else html.escape(tag), here.link))
            continue
        if tag in RAW:
            if not here.excluded:
                parts.append((" ", here.link))
            continue
        if tag in BLOCK:
            close()
        elif tag == "br" and not here.excluded:
            parts.append((" ", here.link))
        if tag in VOID:
            continue
        if kind == "close":
            if count[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                changed = depth and stack[depth - 1] or root
                if (changed.holder, changed.article) != (here.holder, here.article):
                    close()
                cut(depth)
            continue
        if tag in BLOCK:
            depth = len(stack)
            while depth and (stack[depth - 1].tag == "p" or stack[depth - 1].tag in INLINE_OPEN):
                depth -= 1
            cut(depth)
            if tag == "li" and items and stack[items[-1]].tag == "li":
                cut(items[-1])
        if kind == "empty":
            continue
        opened = _opened(tag, attributes(inner) if inner else {}, here, holders)
        if opened.holder != here.holder or opened.article != here.article or opened.excluded != here.excluded:
            close()
        seen = seen or opened.article and not here.article and not opened.excluded and opened.holder < 0
        if tag in _LISTS or tag == "li":
            items.append(len(stack))
        stack.append(opened)
        count[tag] += 1
        here = opened
    close()
    return out, holders, seen


def _opened(tag: str, named: dict[str, str], around: _Open, holders: list[Holder]) -> _Open:
    """The state inside an element that opens; it becomes a holder if its names exclude it."""
    names = " ".join(x for x in f"{named.get('class', '')} {named.get('id', '')}".split() if not LAYOUT.search(x))
    role = named.get("role", "").strip().lower()
    main = tag == "main" or role == "main"
    by_kind = not (main or tag in ("html", "body", "article")) and (
        tag in OUTSIDE or tag == "header" and not around.article or role in ROLES or "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true")
    by_names = not (main or tag in ("html", "body", "article")) and (any(map(_is_mark, names.split())) if around.article else bool(MARKS.search(names) or HEADER_MARK.search(names)))
    excluded, holder = around.excluded or by_kind, around.holder
    if not excluded and (main or tag == "article"):
        foreign = bool(MARKS.search(names))
        while holder >= 0 and not foreign:  # marks all holders around it; those already marked have theirs marked
            h = holders[holder]
            if main and not h.of_main:
                h.of_main = True
            elif not main and not h.of_article and not h.others:
                h.of_article = True
            else:
                break
            holder = h.parent
        holder = around.holder
    if by_names and not excluded:
        around_it = holders[holder] if holder >= 0 else Holder(-1, False, False)
        firm = any(MARKS.sub("", x) == "" for x in names.split())
        holders.append(Holder(holder, bool(OTHERS.search(names)) or around_it.others, firm or around_it.firm))
        holder = len(holders) - 1
    return _Open(tag, excluded, around.article or main or tag == "article" or role == "article", around.link or tag == "a", holder)


@lru_cache(maxsize=4096)
def _is_mark(name: str) -> bool:
    """Whether a whole name is a mark, or marks and words of form: "share", "share-buttons", not "notice-period"."""
    rest = name
    while found := MARKS.search(rest):
        rest = f"{rest[: found.start()]}-{rest[found.end() :]}".strip("-_")
    return rest != name and not FORM.sub("", rest).strip("-_")


@lru_cache(maxsize=1)
def _stop_lists() -> tuple[frozenset[str], ...]:
    return tuple(frozenset(w.split()) for w in STOP_WORDS.values())


def _stop_density(text: str, lists: Iterable[frozenset[str]]) -> float:
    """The share of stop words, in the language that fits best."""
    words = _LETTERS.findall(text.lower())
    return max((sum(w in s for w in words) for s in lists), default=0) / max(1, len(words))


def _is_running_text(b: Block, rules: Rules, lists: Iterable[frozenset[str]]) -> bool:
    return len(b.text) >= rules.short and b.link_chars <= rules.links * len(b.text) and _stop_density(b.text, lists) >= rules.stop_low


def classify(found: list[Block], rules: Rules = Rules(), stop_lists: Iterable[frozenset[str]] | None = None) -> list[Block]:
    """Label every block good or bad, in place.

    First pass, each block alone. Outside an article element, link-dense blocks are bad, long ones with enough stop words
    (of the language that fits best) good, those with too few bad, and short ones without links undecided. Inside one, a
    block with enough stop words is good, and every other one undecided: links, lists, code and captions belong to it.
    Second pass: an undecided block takes the label of the nearest decided block (inside an article: of those there);
    between two at one distance, or with none, blocks of an article are good and others bad; on a page with no good block at
    all every undecided one is good. Where long text is mostly in a language that no list knows, length and links decide. Where articles hold most of
    the good text, what stands outside them is bad.
    """
    lists = _stop_lists() if stop_lists is None else stop_lists
    any_article = any(b.article for b in found)
    for b in found:
        size = len(b.text)
        if b.article:
            b.label = "good" if size >= rules.short and _stop_density(b.text, lists) >= rules.stop_low else ""
        elif b.link_chars > rules.links * size:
            b.label = "bad"
        elif size < rules.short:
            b.label = "bad" if b.link_chars else ""
        else:
            stops = _stop_density(b.text, lists)
            b.label = "good" if stops >= rules.stop_high and size > rules.long or stops >= rules.stop_low else "bad"
    if not any_article:
        _other_languages(found, rules)
    if not any(b.label == "good" for b in found):
        for b in found:  # nothing long at all: what stands there without links is the text
            b.label = b.label or "good"
    good = {inside: sum(len(b.text) for b in found if b.article == inside and b.label == "good") for inside in (True, False)}
    if any_article and good[True] >= good[False]:
        for b in found:
            b.label = b.label if b.article else "bad"
    for inside in (True, False):
        _inherit([b for b in found if b.article] if inside else found, inside)
    return found


def _other_languages(found: list[Block], rules: Rules) -> None:
    """Where long text without links mostly is in no language of the lists, length and links decide.

    If there is any good block, only blocks with the end of a sentence count as such text.
    """
    known = sum(len(b.text) for b in found if b.label == "good")
    other = [b for b in found if b.label == "bad" and len(b.text) >= rules.short and b.link_chars <= rules.links * len(b.text) and (not known or _SENTENCE.search(b.text))]
    if sum(len(b.text) for b in other) > known:
        for b in other:
            b.label = "good"


def _inherit(found: list[Block], inside: bool) -> None:
    """Undecided blocks (of articles, or all others) take the label of the nearest decided one."""
    labels, nearest, last = [b.label for b in found], [], None
    for i, label in enumerate(labels):
        last = i if label else last
        nearest.append(last)
    last = None
    for i in range(len(found) - 1, -1, -1):
        last = i if labels[i] else last
        b = found[i]
        if not b.label and b.article == inside:
            near = [x for x in (nearest[i], last) if x is not None]
            least = min((abs(x - i) for x in near), default=0)
            close = {labels[x] for x in near if abs(x - i) == least}
            b.label = close.pop() if len(close) == 1 else "good" if inside else "bad"


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """Good blocks in page order, joined by an empty line; empty if there is none."""
    return "\n\n".join(b.text for b in classify(blocks(page), rules) if b.label == "good") if page else ""


def extract(pages: DataFrame, page: str = "html", rules: Rules = Rules()) -> DataFrame:
    """Add ``text, n_chars`` to every row. A map over rows: no shuffle, one page in memory beside its batch.

    Null and empty pages give an empty text; nothing is dropped or cut, and time grows with the page's length, also for broken
    markup. Repeated rows get the same text; an empty table gives no rows. Columns named text or n_chars in ``pages`` are
    replaced.
    """
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def to_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py(), rules) for p in batch], pa.string())

    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    found = pages.select(*columns(kept), to_text(F.col(page)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
