"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ._common import columns, fresh

# The terms used where no table of terms is given. One strict term rejects a url; of the soft ones, SOFT_HITS different do.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "pills", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "deal", "dating", "farm", "free", "jackpot", "keygen", "loan", "loans", "lottery", "offer", "poker", "popup", "promo", "slots", "sponsor", "track", "tracker", "torrent", "win", "winner")
SOFT_HITS = 2
# Fixed values: (host, start of the path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


#: A url is rejected when the weights of the different terms in it reach this: one strict term, or several soft ones.
THRESHOLD = 1.0
TERMS = {t: THRESHOLD / SOFT_HITS for t in SOFT} | {t: THRESHOLD for t in STRICT}


def vocabulary(terms: DataFrame, bound: int = 2_000_000) -> dict[str, float]:
    """The weighted terms for :func:`filter_urls` from a table ``term, weight``. Terms are trimmed and A-Z lower-cased; of a
    repeated one the largest weight counts; null and empty terms, and those of null or no positive weight, are left out. A
    vocabulary is kept whole on the driver and in each Python worker, so one of more than ``bound`` terms is an error."""
    clean = terms.select(F.trim(F.translate("term", ASCII_UPPER, ASCII_UPPER.lower())).alias("term"), F.col("weight").cast("double").alias("weight"))
    clean = clean.where("term <> '' and weight > 0 and not isnan(weight)").groupBy("term").agg(F.max("weight").alias("weight"))
    found = {r["term"]: r["weight"] for r in clean.limit(bound + 1).collect()}
    if len(found) > bound:
        raise ValueError(f"a vocabulary of more than {bound} terms")
    return found


def automaton(terms: Mapping[str, float]) -> ahocorasick.Automaton | None:
    """The terms with their weights, ready to be found in one pass over a url; none if there are no terms."""
    found = ahocorasick.Automaton()
    for term, weight in terms.items():
        found.add_word(term, (term, weight))
    if not terms:
        return None
    found.make_automaton()
    return found


def vocabulary_verdict(url: str | None, found: ahocorasick.Automaton | None, threshold: float = THRESHOLD) -> str:
    """block if the weights of the different terms that stand in the url between non-alphanumerics add up to the threshold."""
    if not url or found is None:
        return "allow"
    low, seen, weight = url.translate(ASCII_LOWER), set(), 0.0
    for end, (term, of_term) in found.iter(low):
        start = end - len(term)
        if term not in seen and (start < 0 or low[start] not in _INSIDE) and (end + 1 >= len(low) or low[end + 1] not in _INSIDE):
            seen.add(term)
            weight += of_term
            if weight >= threshold - 1e-9:
                return "block"
    return "allow"


_MADE: dict[str, ahocorasick.Automaton | None] = {}


def _made(name: str, shared: Broadcast) -> ahocorasick.Automaton | None:
    """The automaton of a vocabulary, built once for each Python worker."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = automaton(shared.value)
    return _MADE[name]


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, terms: Mapping[str, float] = TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row; nothing is dropped, the caller filters on ``verdict``.

    Host and path are cut and matched with rules as columns, in the JVM; only urls that no rule fits meet the automaton
    (Arrow batches, no shuffle). Null urls and urls without ``://`` have an empty host and path; a null url is allowed.
    Empty urls are as null ones; very long urls cost time in proportion to their length. Repeated rows are judged alike; an
    empty table gives no rows. Columns of these four names in ``pages`` are replaced, all others stay. ``terms``
    may come from a table, see :func:`vocabulary`; they are broadcast, and what a url costs hardly grows with them.
    """
    kept = columns(c for c in pages.columns if c not in ("host", "path", "rule", "verdict"))
    [by] = fresh(pages.columns, "_by")
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    judged = pages.select(*kept).withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer rules wrap shorter ones
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(start)
        rule = F.when(fits, F.lit(rule_host + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    judged = judged.withColumn("rule", rule).withColumn("verdict", verdict)
    shared, name = pages.sparkSession.sparkContext.broadcast(dict(terms)), uuid.uuid4().hex

    @F.arrow_udf("string")
    def by_vocabulary(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = _made(name, shared)
        for batch in urls:
            yield pa.array([vocabulary_verdict(u, found, threshold) for u in batch.to_pylist()], pa.string())

    unruled = F.when(F.col("rule").isNull(), F.col(url))
    return judged.withColumn(by, by_vocabulary(unruled)).withColumn("verdict", F.coalesce("verdict", by)).drop(by)


def oracle_sql() -> str:
    """The same in DuckDB, the vocabulary as one search for each term."""
    host = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM a),
c AS (SELECT *, {' + '.join(map(hit, STRICT))} AS n_strict, {' + '.join(map(hit, SOFT))} AS n_soft FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {says} WHEN n_strict >= 1 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
