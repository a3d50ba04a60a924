"""Phrases of a lexicon, contrasts of channels and metered writes against versions by hand."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import metered, words as X


@pytest.mark.parametrize("most_chars", [10**9, 0])
def test_phrases_both_ways(spark, most_chars):
    r = random.Random(2)
    texts = [" ".join(r.choices(["a", "b", "C", "d,", "é", "x1y"], k=r.randint(0, 12))) for _ in range(80)] + [None, "", "1 2"]
    phrases = [" ".join(r.choices(["a", "b", "c", "d", "É", "q"], k=r.randint(1, 4))) for _ in range(150)] + ["A, b!", "", "1", None, "a", "a"]
    docs, lexicon = (spark.createDataFrame([(t,) for t in x], f"{n} string") for x, n in ((texts, "text"), (phrases, "phrase")))
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    held = [f" {' '.join(split(t))} " for t in texts]
    want = {p: sum(f" {' '.join(split(p))} " in t for t in held) if split(p) else 0 for p in phrases}
    assert {r["phrase"]: r["n_docs"] for r in X.phrase_counts(docs, lexicon, most_chars=most_chars).collect()} == want
    assert X.phrase_counts(docs, lexicon.limit(0), most_chars=most_chars).count() == 0
    assert all(r["n_docs"] == 0 for r in X.phrase_counts(docs.limit(0), lexicon, most_chars=most_chars).collect())


def test_a_hundred_thousand_phrases_in_one_pass(spark):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=4)) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(300)]
    phrases = {" ".join(r.choices(words, k=r.randint(2, 4))) for _ in range(100_000)}
    for t in texts[:50]:
        at = r.randrange(190)
        phrases.add(" ".join(t.split()[at : at + 3]))
    found = X.phrase_counts(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    got = {r["phrase"]: r["n_docs"] for r in found.where("n_docs > 0").collect()}
    grams = Counter(g for t in texts for g in {" ".join(t.split()[i : i + k]) for k in (2, 3, 4) for i in range(201 - k)})
    assert got == {p: grams[p] for p in phrases if p in grams} and len(got) >= 50


def test_channel_contrast(spark):
    rows = [("p", "Sea sea tide the the"), ("p", "the moor"), ("q", "the the the city"), ("q", None), ("other", "the x")]
    found = {r["term"]: (r["a"], r["b"], r["z"]) for r in X.channel_contrast(spark.createDataFrame(rows, "channel string, text string").replace({"p": "a", "q": "b"}), "a", "b", weight=10.0).collect()}
    a, b = Counter("sea sea tide the the the moor".split()), Counter("the the the city".split())
    n1, n2 = sum(a.values()), sum(b.values())
    for t in a | b:
        p = 10.0 * (a[t] + b[t]) / (n1 + n2)
        d = math.log((a[t] + p) / (n1 + 10 - a[t] - p)) - math.log((b[t] + p) / (n2 + 10 - b[t] - p))
        assert found.pop(t) == (a[t], b[t], round(d / math.sqrt(1 / (a[t] + p) + 1 / (b[t] + p)), 4))
    assert not found
    one = X.channel_contrast(spark.createDataFrame([("a", "x x")], "channel string, text string"), "a", "b")
    assert [tuple(r) for r in one.collect()] == [("x", 2, 0, 0.0)]


def test_import_observes_what_it_writes(spark, tmp_path):
    schema = "tweet_id string, created_at string, text string"
    path = f"{tmp_path}/queue"
    first = spark.createDataFrame([("1", "t", "a"), ("2", "t", "b"), ("2", "t", "c"), (None, "t", "d"), ("3", None, "e")], schema)
    assert metered.import_posts(first, None, path) == {"total": 5, "added": 2, "skipped": 1, "failed": 2}
    queue = spark.read.schema(schema).parquet(path)
    second = spark.createDataFrame([(str(i % 50), "t", "x") for i in range(100)], schema).repartition(4)
    assert metered.import_posts(second, queue, path) == {"total": 100, "added": 48, "skipped": 52, "failed": 0}
    assert spark.read.schema(schema).parquet(path).count() == 50
    assert metered.import_posts(second.limit(0), queue, path) == {"total": 0, "added": 0, "skipped": 0, "failed": 0}


def test_batch_observes_what_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["done", "failed", "written"][i % 3], f"n{i}" if i % 3 != 1 else None, "text" if i % 2 else "photo") for i in range(90)], "id int, status string, output_file string, kind string").repartition(5)
    found = metered.process_batch(rows, lambda x: x.where("id < 60"), f"{tmp_path}/out")
    assert found == {"n": 60, "processed": 20, "failed": 20, "recovered": 20, "files": 40, "kinds": 2}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
