"""Column expressions over note markdown and captured text; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# The white space of Unicode.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not blanks alone; only the ends are looked at."""
    return F.trim(text, F.lit(WHITE))


def _closed(content: Column) -> tuple[Column, Column]:
    """Whether a text begins with frontmatter that ends, and where the mark behind it stands."""
    end = F.locate("---", content, 4)
    return content.startswith("---") & (end > 0), end


def frontmatter(content: Column) -> Column:
    """The lines between a leading ``---`` and the next; empty if there is none."""
    there, end = _closed(content)
    return F.when(there, F.substring(content, F.lit(4), end - 4)).otherwise(F.lit(""))


def body(content: Column) -> Column:
    """The text after the frontmatter, or the whole text."""
    there, end = _closed(content)
    return strip(F.when(there, F.substring(content, end + 3, F.length(content))).otherwise(content))


def front_value(content: Column, key: str) -> Column:
    """A flat frontmatter value; null if absent or empty."""
    return F.nullif(F.regexp_extract(frontmatter(content), rf"(?md)^{key}: *(.*)$", 1), F.lit(""))


def front_list(content: Column, key: str) -> Column:
    return F.filter(F.split(F.coalesce(F.regexp_extract(frontmatter(content), rf"(?md)^{key}: *\[(.*)\]$", 1), F.lit("")), r", *"), lambda x: x != "")


def front_map(content: Column) -> Column:
    """All flat frontmatter values by key; the last of equal keys counts."""
    lines = F.filter(F.split(frontmatter(content), "\n"), lambda x: x.rlike(r"^[^\s:#][^:]*:"))
    keys = F.transform(lines, lambda x: strip(F.regexp_extract(x, r"^([^:]*):", 1)))
    values = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^[^:]*:", "")))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 1, F.size(keys)), x["k"]))
    return F.when(F.size(lines) > 0, F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))).otherwise(F.create_map().cast("map<string,string>"))


def section(text: Column, name: str) -> Column:
    """The text under a heading, up to the next heading, stripped; empty if there is none."""
    rest = F.regexp_extract(text, rf"(?is)##?[ \t]*{name}[ \t]*\n(.*)", 1)
    return strip(F.split(rest, r"\n##?\s", 2)[0])  # found once, cut once: no step back at each character


def title(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, r"(?md)^#[ \t]+(.+)$", 1)), F.lit(""))


def bullets(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.startswith("-"))
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, "^-+", ""))), lambda x: x != "")


def wikilinks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: strip(F.split(x, r"\|")[0]))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def token_estimate(words: Column) -> Column:
    return F.floor(words * F.lit(1.3)).cast("int")


def normalize(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://\S+", "")


def first_url(text: Column) -> Column:
    """The first url without trailing punctuation; closing parentheses beyond the open ones are cut."""
    raw = F.regexp_replace(F.regexp_extract(text, r"https?://\S+", 0), r"[.,;:!?'\"]+$", "")
    extra = (F.length(F.regexp_replace(raw, r"[^)]", "")) - F.length(F.regexp_replace(raw, r"[^(]", ""))) > 0
    return F.nullif(F.when(extra, F.regexp_replace(raw, r"\)+$", "")).otherwise(raw), F.lit(""))


# Letters that decomposition does not take apart, in Latin, Greek and Cyrillic order, and their ASCII spelling.
SPELLED = dict(zip(
    "ß æ œ ø đ ð þ ł ħ ı ŋ α β γ δ ε ζ η θ ι κ λ μ ν ξ ο π ρ ς σ τ υ φ χ ψ ω а б в г д е ж з и й к л м н о п р с т у ф х ц ч ш щ ы э ю я ё є і ї ґ ђ ј љ њ ћ џ".split(),
    "ss ae oe o d d th l h i ng a b g d e z e th i k l m n x o p r s s t u ph kh ps o a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch y e iu ia io ie i yi g dj j lj nj tsh dzh".split(),
))


def ascii_letters(text: Column) -> Column:
    """Lower-case text with accents taken off and Greek, Cyrillic and special Latin letters spelled in ASCII."""
    single = {k: v for k, v in SPELLED.items() if len(v) == 1}

    def spelled(low: Column) -> Column:
        for letter, ascii_ in SPELLED.items():
            if len(ascii_) > 1:
                low = F.replace(low, F.lit(letter), F.lit(ascii_))
        return F.translate(low, "".join(single), "".join(single.values()))

    apart = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), spelled(F.lower(F.coalesce(text, F.lit("")))), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), spelled(F.lower(F.regexp_replace(apart, r"\p{M}+", "")))).otherwise(F.lower(text))


def slug(text: Column, longest: int = 50) -> Column:
    """Lower-case ASCII words joined by hyphens; ``untitled`` if nothing is left.

    Every other character parts words, but typographic quotes, hard and soft signs, and a comma inside a number go without a trace.
    Too long a slug keeps, in order, each word that still fits; a single word is cut. Scripts other than Latin, Greek and
    Cyrillic have no spelling and part words.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "&(?:amp|lt|gt|quot|apos|nbsp);", "-"), "[\u2018\u2019ъьЪЬ]", "")
    low = F.regexp_replace(ascii_letters(bare), r"(?<=[0-9]),(?=[0-9])", "")
    whole = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    room = lambda acc, w: F.length(acc) + F.length(w)
    fitting = F.aggregate(F.split(whole, "-"), F.lit(""), lambda acc, w: F.when(room(acc, w) < longest, F.concat(acc, w, F.lit("-"))).when(room(acc, w) == longest, F.concat(acc, w)).otherwise(acc))
    cut = F.when(F.length(whole) < longest, whole).when(whole.contains("-") & (fitting != ""), fitting).otherwise(F.substring(whole, 1, longest))
    return F.coalesce(F.nullif(F.regexp_replace(cut, "-+$", ""), F.lit("")), F.lit("untitled"))


def without_fence(text: Column) -> Column:
    """Drop a code fence around the whole text."""
    return F.regexp_replace(F.regexp_replace(strip(F.regexp_replace(text, "^\ufeff", "")), r"^```(?:markdown|md)?[ \t]*\n", ""), r"\n```$", "")


# Words that mark a note as emotional.
EMOTIONAL = ("feel", "emotion", "anxious", "happy", "sad")


def is_emotional(text: Column) -> Column:
    hit = F.lit(False)
    for w in EMOTIONAL:
        hit = hit | F.lower(text).contains(w)
    return hit
