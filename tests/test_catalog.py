"""Every catalog query against DuckDB on the smallest tables, and fixtures of single functions."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import catalog as C
from marginalia.operators.order import row_index
from marginalia.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    found = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert ours == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, url", [("see https://a.b/c_(d). now", "https://a.b/c_(d)"), ("(https://a.b/c)", "https://a.b/c"), ("none", None)])
def test_first_url(spark, text, url):
    assert one(spark, text, T.first_url) == url


@pytest.mark.parametrize("text, slug", [
    ("Hello,  Wörld!", "hello-world"), ("", "untitled"), (None, "untitled"), ("word " * 20, "word-" * 9 + "word"), ("A Tidy Title", "a-tidy-title"),
    ("Is this note taking process currently working?", "is-this-note-taking-process-currently-working"), ("It's a/b foo.bar", "it-s-a-b-foo-bar"), ("It\u2019s", "its"),
    ("Čeština & Straße", "cestina-strasse"), ("Москва и Ёлка", "moskva-i-iolka"), ("объём день", "obiom-den"), ("Αθήνα", "athena"), ("æther Øre Łódź", "aether-ore-lodz"), ("1,000 reasons", "1000-reasons"),
    ("Q&amp;A", "q-a"), ("日本語", "untitled"), ("x" * 60, "x" * 50), ("a " + "b" * 60 + " c d", "a-c-d"), ("b" * 60 + " " + "c" * 60, "b" * 50), ("w" * 24 + " " + "v" * 25, "w" * 24 + "-" + "v" * 25),
])
def test_slug(spark, text, slug):
    assert one(spark, text, T.slug) == slug


def test_sampled_counts_are_of_the_sample(spark):
    found = QUERIES["sampled_counts"](spark, SF).agg(F.sum("original"), F.sum("sampled")).first()
    assert tuple(found) == (QUERIES["parse_note"](spark, SF).count(), QUERIES["sample_notes_if_needed"](spark, SF).count())


def test_slugs_of_all_documents(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["slugify"](spark, SF)
    assert found.count() == docs.count() == QUERIES["slugify"](spark, SF).count()
    assert 40 < found.agg(F.max(F.length("slug"))).first()[0] <= 50


@pytest.mark.parametrize("n, count", [(1, 1), (7, 3), (30, 22), (10, 20)])
def test_stratified_positions(spark, n, count):
    got = sorted(r.id for r in C.stratified_select(spark.range(n), count, "id").collect())
    assert got == (list(range(n)) if count >= n else sorted({i * n // count for i in range(count)}))


def test_row_index_has_no_single_partition_of_rows(spark):
    rows = row_index(spark.range(1000), F.desc("id"))
    assert [r.row_index for r in rows.orderBy(F.desc("id")).collect()] == list(range(1000))
