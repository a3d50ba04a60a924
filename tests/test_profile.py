"""Sketches within their stated errors, and exact rows whatever the sketches say."""

import random
from collections import Counter
from math import ceil

import pytest

from marginalia.operators import profile as P

SCHEMA = "day int, c string, text string"


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    rows = [(i % 7, rng.choice(["a", "b", None]), " ".join(rng.choices(words, weights, k=int(rng.paretovariate(1.2)) + 3)) + rng.choice(["", "?", " !"])) for i in range(n)]
    return rows + [(0, "a", None), (0, "a", ""), (0, None, "  \n"), (1, "empty", None)]


def counts(rows, group):
    return Counter(w for _, c, t in rows if c == group for w in "".join(x if x.isalpha() else " " for x in (t or "").lower()).split())


def lengths(rows, group):
    return sorted(len((t or "").split()) for _, c, t in rows if c == group)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_merged_sketches_keep_their_errors(texts):
    rows, tracked, size = corpus(), 512, 64
    found = P.estimates(P.merged(P.text_sketches(texts, ["c", "day"], tracked=tracked, size=size), ["c"]), (0.1, 0.5, 0.9), 20, tracked, size).collect()
    assert {r.c for r in found} == {"a", "b", "empty", None}
    for r in found:
        true, long = counts(rows, r.c), lengths(rows, r.c)
        assert (r.n, r.n_words, r.n_terms) == (len(long), sum(long), sum(true.values()))
        assert r.n_questions == sum("?" in (t or "") for _, c, t in rows if c == r.c)
        for x in r.recurring:
            assert true[x["item"]] <= x["count"] <= true[x["item"]] + r.count_error
        assert {w for w, n in true.most_common(20) if n > r.count_error} <= {x["item"] for x in r.recurring} or r.c == "empty"
        for q, length in zip((0.1, 0.5, 0.9), r.quantiles):
            below, upto = sum(x < length for x in long) / len(long), sum(x <= length for x in long) / len(long)
            assert below - 3 * r.rank_error <= q <= upto + 3 * r.rank_error


@pytest.mark.parametrize("tracked", [16, 8192])  # the first tells nothing apart: groups are counted whole
def test_recurring_words_are_exact(texts, tracked):
    got = {}
    for r in P.recurring_words(texts, ["c"], 7, tracked=tracked).collect():
        got.setdefault(r.c, {})[r["rank"]] = (r.term, r.n)
    for group in ("a", "b", None):
        best = sorted(counts(corpus(), group).items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [got[group][i] for i in range(1, 8)] == best
    assert "empty" not in got


@pytest.mark.parametrize("size", [8, 2048])
def test_length_quantiles_are_exact(texts, size):
    qs = (0.0, 0.01, 0.5, 0.99, 1.0)
    got = {(r.c, r.q): r.length for r in P.length_quantiles(texts, ["c"], qs, size=size).collect()}
    expected = {(c, q): lengths(corpus(), c)[max(1, ceil(len(lengths(corpus(), c)) * q)) - 1] for c in ("a", "b", "empty", None) for q in qs}
    assert got == expected


def test_misleading_ranges_are_made_good(spark, texts):
    """Sketches of other texts give ranges that hold none of the ranks."""
    other = P.text_sketches(spark.createDataFrame([(0, c, "x " * 500) for c in ("a", "b", "empty", None)], SCHEMA), ["c"])
    true = P.text_sketches(texts, ["c"]).select("c", "n").withColumnRenamed("c", "k")
    wrong = other.drop("n").join(true, other.c.eqNullSafe(true.k)).drop("k")
    got = {r.c: r.length for r in P.length_quantiles(texts, ["c"], (0.5,), sketches=wrong).collect()}
    assert got == {c: lengths(corpus(), c)[max(1, ceil(len(lengths(corpus(), c)) * 0.5)) - 1] for c in ("a", "b", "empty", None)}


def test_empty_table_and_no_groups(spark, texts):
    none = texts.limit(0)
    assert P.text_sketches(none, ["c"]).count() == P.recurring_words(none, ["c"]).count() == P.length_quantiles(none, ["c"]).count() == 0
    assert P.text_sketches(texts, []).first().n == len(corpus())
    best = sorted(Counter(sum((counts(corpus(), c) for c in ("a", "b", None)), Counter())).items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [(r.term, r.n) for r in P.recurring_words(texts, []).orderBy("rank").collect()] == best
