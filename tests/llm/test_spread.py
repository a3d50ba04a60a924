"""Joins and components whose keys hold far more rows than others."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid
from marginalia.llm._common import join_facts
from marginalia.llm.components import _large_star, _small_star, _stars, components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_facts_splits_hot_keys(spark, how):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("value"))
    facts = rows.where("key <> 9").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
    found = join_facts(rows, facts, ["key"], 6000, how)
    assert found.columns == ["key", "value", "least"]
    want = rows.join(facts.drop("n"), "key", how)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_join_facts_bounds_the_rows_of_a_part(spark):
    rows = spark.range(8000).select(F.lit(1).alias("key"), F.col("id").alias("value"))
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_facts(rows, facts.hint("merge"), ["key"], 8000).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000 and max(sizes) < 8000 / 2


def test_join_facts_empty(spark):
    rows = spark.createDataFrame([], "key long, value long")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert join_facts(rows, facts, ["key"], 0, "left").count() == 0


def test_components_of_stars_and_chains(spark):
    star = [(0, i) for i in range(1, 3000)]
    chain = [(i, i + 1) for i in range(5000, 5060)]
    bridge = [(9000, 9001), (9001, 2999), (7, 7)]
    edges = spark.createDataFrame(star + chain + bridge, "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    want = {i: 0 for i in [*range(3000), 9000, 9001]} | {i: 5000 for i in range(5000, 5061)}
    assert found == want


def test_rounds_of_small_stars_are_three_shuffles(spark):
    """The driver keeps every stage and task in memory: a round that splits no star runs no joins and broadcasts."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 900)], "a long, b long")
    spark.sparkContext.setJobGroup("stars", "")
    try:
        found = components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    jobs = [seen.getJobInfo(i) for i in seen.getJobIdsForGroup("stars")]
    assert 0 < len(jobs) < 60  # 109 when each star had its joins, 46 now
    assert {r["node"]: r["component"] for r in found.collect()} == {i: 0 if i < 41 else 100 for i in [*range(41), *range(100, 900)]}


@pytest.mark.parametrize("whole", [1, 20, 1 << 16])
def test_components_split_or_whole(spark, whole):
    r = random.Random(whole)
    pairs = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(180)] + [(399, i) for i in range(0, 400, 9)] + [(None, 3), (5, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    root = {i: i for i in range(401)}
    for _ in range(401):
        for a, b in pairs:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b and a is not None and b is not None for x in (a, b)}
    assert {x["node"]: x["component"] for x in components(edges, whole=whole).collect()} == {x: root[x] for x in linked}


def test_whole_stars_equal_split_stars(spark):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randint(0, 90), r.randint(0, 90)) for _ in range(150)], "a long, b long").where("a <> b").distinct()
    want = _small_star(_large_star(edges, 150), 150)
    assert sorted(map(tuple, _stars(edges).collect())) == sorted(map(tuple, want.collect()))


def test_model_is_no_python_strings_in_the_driver(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(100)), "xy"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.train(docs.limit(1))
    tracemalloc.start()
    model = langid.train(docs)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    known = sum(map(len, model.names.values()))
    assert known > 20000 and all(isinstance(x, pa.Array) for x in model.names.values())
    assert held < known * 8 * len(model.langs) + 500_000  # the table of logs; a Python string takes 50 bytes and more
