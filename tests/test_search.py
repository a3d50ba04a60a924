"""Trigram search against a scan, nested frontmatter against the YAML library."""

import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from marginalia.functions import yaml as Y
from marginalia.operators import search as S


def scan(rows, terms, limit):
    out = []
    for t in sorted({t for t in terms if t is not None}):
        hits = sorted(n for n, x in rows if t.lower() in (n or "").lower() or t.lower() in (x or "").lower())
        out += [(t, i, n) for i, n in enumerate(hits[:limit], 1)]
    return sorted(out)


def test_search_equals_a_scan(spark):
    r = random.Random(3)
    rows = [(f"n{i:03}", "".join(r.choices("abAB é😀\n", k=r.randint(0, 60)))) for i in range(200)] + [("x", None), ("x", "ab"), ("x", "ab"), ("Red-Hat", "")]
    terms = ["".join(r.choices("abAB é😀\n", k=r.randint(0, 6))) for _ in range(300)] + ["", "HAT", "n00", "zzz", "%", None, "ab", "AB"]
    index = S.build_index(spark.createDataFrame(rows, "stem string, raw_capture string"))
    found = S.search(index, spark.createDataFrame([(t,) for t in terms], "term string"), 4)
    assert sorted(map(tuple, found.collect())) == scan(rows, terms, 4)
    assert S.search(index, spark.createDataFrame([], "term string")).count() == 0
    assert S.search(S.build_index(spark.createDataFrame([], "stem string, raw_capture string")), spark.createDataFrame([("a",), ("",)], "term string")).count() == 0


def test_a_hundred_thousand_terms_without_terms_times_notes(spark):
    r = random.Random(4)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    words = ["".join(r.choices(syllables, k=r.randint(2, 4))) for _ in range(30_000)]
    rows = [(f"n{i:04}", " ".join(r.choices(words, k=60))) for i in range(1000)]
    terms = [" ".join(r.choices(words, k=r.randint(1, 2))) for _ in range(100_000)]
    index = S.build_index(spark.createDataFrame(rows, "stem string, raw_capture string").repartition(4))
    found = S.search(index, spark.createDataFrame([(t,) for t in terms], "term string").repartition(4), 5)
    got = {}
    for t, i, n in found.collect():
        got.setdefault(t, []).append(n)
    where = {}
    for n, x in rows:
        for w in set(x.split()):
            where.setdefault(w, []).append(n)
    for t in r.sample(terms, 300):
        assert got.get(t, []) == sorted(n for n, x in rows if t in x)[:5]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


NESTED = [
    "a: 1\nb: [x, 'y z', 2.5]\nc:\n  d: {e: null}\n  f:\n    - g\n    - h: true\n", "title: \"A: b\"\ntext: |\n  two\n  lines\nfold: >\n  one\n  line\n", "when: 2024-03-04\nat: 2024-03-04T05:06:07\n", "tags: [lang, other tag]\nmood: calm\n",
    "yes: no\non: off\n", "mood: calm\nmood: tense\n", "1: x\ntrue: y\n", "a: ~\nb:\n", "- a\n- b\n", "just text\n", "a: [1, 2\n", "a: b: c\n", "k: 'it''s'\n", "emoji: 😀\nq: \"\\u00e9\"\n", "", "a: &x 1\nb: *x\n", "n: .nan\n", "!!python/object:os.system x\n", "mood: y\n", "a_b: c-d e\n", "mood: On the way\n",
]


def test_nested_frontmatter(spark):
    files = [(str(i), f"---\n{x}---\n# Body\n") for i, x in enumerate(NESTED)] + [("none", "no front"), ("null", None)]
    found = Y.with_frontmatter(spark.createDataFrame(files, "path string, content string"))
    got = {r["path"]: (r["j"], r["broken"]) for r in found.select("path", F.to_json("frontmatter").alias("j"), "broken").collect()}
    for i, x in enumerate(NESTED):
        try:
            want = yaml.safe_load(x)
            want = {} if want is None else want
        except yaml.YAMLError:
            want = None
        j, broken = got[str(i)]
        assert broken == (not isinstance(want, dict)), x
        if not broken:
            plain = json.loads(json.dumps(want, default=lambda v: v.isoformat()).replace("NaN", "null"))
            assert json.loads(j) == plain, x
    assert got["none"] == ("{}", False) and got["null"] == ("{}", False)
    one = found.where("path = '0'").select(F.expr("variant_get(frontmatter, '$.c.f[1].h', 'boolean')").alias("h"), F.expr("variant_get(frontmatter, '$.b[1]', 'string')").alias("b")).first()
    assert (one["h"], one["b"]) == (True, "y z")


def test_flat_frontmatter_stays_in_the_jvm():
    assert Y.yaml_to_json("tags: [a b, c]\nmood: calm") == '{"tags": ["a b", "c"], "mood": "calm"}'


def test_broken_frontmatter_goes_to_rejects(spark, tmp_path):
    files = spark.createDataFrame([("a", "---\nx: [1\n---\n"), ("b", "---\nx: [1]\n---\n")], "path string, content string")
    assert [r["path"] for r in Y.admitted(files, f"{tmp_path}/rejects").collect()] == ["b"]
    assert [(r["path"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == [("a", "frontmatter")]


def test_words_need_no_grams(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcé", k=r.randint(1, 5))) for _ in range(300)] + ["x" * 40]
    rows = [(f"N{i % 90:02}-{r.choice(words)}", r.choice([" ", "-", "1", "\n"]).join(r.choices(words, k=12))) for i in range(120)] + [("", "ab"), ("z", None)]
    index = S.build_index(spark.createDataFrame(rows, "stem string, raw_capture string").repartition(5))
    terms = sorted({w[:k].swapcase() for w in words for k in (1, 2, 3, 5)}) + ["X" * 32, "n", "Ñ", None]
    for limit in (1, 6):
        found = S.search(index, spark.createDataFrame([(t,) for t in terms], "term string"), limit)
        assert sorted(map(tuple, found.collect())) == scan(rows, terms, limit)
    assert not {"postings", "sizes"} & set(vars(index))  # the index holds words only
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # no task passes on more than the first notes of a word or term
