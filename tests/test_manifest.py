"""Manifests of runs, costs at any share of cached input, and numbers of images in a busy hour."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marginalia.operators import catalog as C, runs as R
from marginalia.plans.runs import flat
from marginalia.sources import sinks

ITEMS = "run_id string, source_type string, token_estimate int, created_at date, kept boolean"
ATTEMPTS = "run_id string, dimension string, seq int, error string, tokens_in long, tokens_out long"


def by_hand(tokens_in, tokens_out, share):
    """The rule spelled out in dollars for a million tokens."""
    hit = int(tokens_in * share)
    out = tokens_out / 1e6 * 25.0
    return (tokens_in - hit) / 1e6 * 5.0 + hit / 1e6 * 0.5 + out, tokens_in / 1e6 * 5.0 + out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.333, 1.0])
def test_cost_at_any_share(spark, share):
    rows = spark.createDataFrame([(0, 0), (1, 1), (999, 7), (123_457, 8000), (10**12, 10**9)], "i long, o long")
    for column in (share, F.lit(share)):
        for r in rows.select("i", "o", R.estimate_cost(F.col("i"), F.col("o"), column).alias("c")).collect():
            assert (r.c.min_cost, r.c.max_cost) == pytest.approx(by_hand(r.i, r.o, share))


def test_cost_of_odd_input(spark):
    row = spark.createDataFrame([(1000, 10, None, 7.0, -1.0)], "i long, o long, none double, high double, low double")
    costs = row.select(*[R.estimate_cost(F.col("i"), F.col("o"), F.col(c)).alias(c) for c in ("none", "high", "low")], R.estimate_cost(F.lit(None).cast("long"), F.col("o")).alias("null")).first()
    assert costs["none"].min_cost is None and costs["none"].max_cost == pytest.approx(0.00525)
    assert costs["high"].min_cost == pytest.approx(0.00075) and costs["low"].min_cost == pytest.approx(0.00525)
    assert costs["null"].min_cost is None and costs["null"].max_cost is None


def test_roll_ups_take_any_share(spark):
    totals = spark.createDataFrame([("c", 1_000_000)], "k string, tokens long")
    for made in (R.cost_rollup, R.cost_full_content):
        half, none, whole = ({r["tier"] if "tier" in r else "": r for r in made(totals, "k", cached=x).collect()} for x in (0.5, 0.0, 1.0))
        for tier, r in none.items():
            assert r.min_cost == pytest.approx(r.max_cost)
            assert whole[tier].min_cost < half[tier].min_cost < r.min_cost
            assert half[tier].min_cost == pytest.approx((whole[tier].min_cost + r.min_cost) / 2)


def manifests(spark, limit=100):
    d = [date(2024, 1, i) for i in range(1, 8)]
    items = spark.createDataFrame([
        ("a", "note", 60, d[3], True), ("a", "note", 50, d[0], False), ("a", "reflection", 10, d[1], True), ("a", "tweet", None, None, True), ("a", "image", 30, d[2], None), ("a", "hub", 5, d[6], True), ("a", "odd", 7, d[6], True), ("a", None, 7, d[6], True),
        ("b", "tweet", 40, d[5], True), ("b", "tweet", 60, d[4], True), (None, "note", 1, d[0], True),
    ], ITEMS)
    attempts = spark.createDataFrame([
        ("a", "x", 1, "timed out", 5, 5), ("a", "x", 2, None, 100, 10), ("a", "y", 1, None, 70, 7), ("a", "y", 3, "limit", 1000, 0), ("a", "z", 1, "", 3, None),
        ("c", "x", 1, "limit", None, None), (None, "x", 1, None, 9, 9),
    ], ATTEMPTS)
    return R.run_manifest(items, attempts, limit)


def test_manifest_of_runs(spark):
    got = {r.run_id: r.asDict(True) for r in manifests(spark).collect()}
    assert set(got) == {"a", "b", "c", None}
    a = got["a"]
    assert a["content"] == {"notes": 1, "reflections": 1, "tweets": 1, "images": 0, "total_tokens": 70, "date_range": {"start": date(2024, 1, 2), "end": date(2024, 1, 4)}}
    assert a["sampling"]["was_sampled"] and a["sampling"]["sampling_ratio"] == pytest.approx(100 / 150 * 0.95)
    assert a["sampling"]["details"] == {"original_tokens": 150, "target_tokens": 100, "original_counts": {"notes": 2, "reflections": 1, "tweets": 1, "images": 1}, "sampled_counts": {"notes": 1, "reflections": 1, "tweets": 1, "images": 0}}
    assert a["analyses"] == {"completed": ["x", "z"], "failed": ["y"]}
    assert (a["cost"]["total_input_tokens"], a["cost"]["total_output_tokens"]) == (1103, 10)
    assert a["cost"]["estimated_cost_usd"] == pytest.approx(sum(by_hand(1103, 10, 0)) / 2)
    b = got["b"]
    assert b["sampling"] == {"was_sampled": False, "sampling_ratio": 1.0, "details": None} and b["analyses"] == {"completed": [], "failed": []}
    assert b["content"]["tweets"] == 2 and b["cost"]["estimated_cost_usd"] == 0
    c = got["c"]
    assert c["content"]["total_tokens"] == 0 and c["content"]["date_range"] == {"start": None, "end": None} and c["analyses"]["failed"] == ["x"]
    assert got[None]["content"]["notes"] == 1 and got[None]["analyses"]["completed"] == ["x"]


def test_manifests_come_back_from_json(spark, tmp_path):
    made = manifests(spark)
    sinks.write_run_manifests(made, f"{tmp_path}/m")
    back = spark.read.schema(made.schema).json(f"{tmp_path}/m")
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    lines = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/m").collect()]
    assert all(set(x) == {"run_id", "content", "sampling", "analyses", "cost", "generated_at"} for x in lines)
    assert flat(back).count() == 4 and manifests(spark).limit(0).count() == 0


def test_empty_tables_give_no_manifest(spark):
    assert R.run_manifest(spark.createDataFrame([], ITEMS), spark.createDataFrame([], ATTEMPTS), 10).count() == 0


def test_images_of_one_hour_are_numbered_in_ranges(spark):
    """All photos of one day, hour and extension: no gap, in order, and no task that holds them all."""
    n = 4000
    images = spark.range(n).select(F.col("id").alias("message_id"), F.lit("2024-01-01").cast("date").alias("day"), F.lit(".jpg").alias("extension"), (F.lit(datetime(2024, 1, 1, 9)) + F.make_interval(secs=(F.col("id") * 7 % n) / 10)).alias("ts"))
    there = spark.createDataFrame([(date(2024, 1, 1), ".jpg", "image-012.jpg"), (date(2024, 1, 1), ".png", "image-999.png"), (date(2024, 1, 1), ".jpg", None)], "day date, extension string, name string")
    named = C.number_images(images, there)
    got = [r["name"] for r in named.orderBy("ts", "message_id").collect()]
    assert got == [f"image-{i:03d}.jpg" for i in range(13, 13 + n)]
    placed = images.repartitionByRange(4, "day", "extension", "ts", "message_id").groupBy(F.spark_partition_id()).count()
    assert placed.agg(F.max("count")).first()[0] < n / 2
