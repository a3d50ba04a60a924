"""The sampler over all types against lists."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import sampling as S


def spread(items, count):
    return items if count >= len(items) else [items[i * len(items) // count] for i in range(count)]


def by_list(rows, limit):
    """Type by type, on lists."""
    rows = [r for r in rows if r[1] in S.BY_SCORE + S.SPREAD + S.KEPT]
    total = sum(r[4] or 0 for r in rows if r[1] not in S.KEPT)
    if total <= limit:
        return sorted(r[0] for r in rows)
    ratio, out = limit / total * 0.95, []
    for kind in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == kind), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        target = max(1, int(len(mine) * ratio))
        if kind in S.KEPT:
            out += mine
        elif kind in S.SPREAD:
            out += spread(mine, target)
        else:
            edge = max(1, int(len(mine) * 0.1))
            ends = {*mine[:edge], *mine[-edge:]}
            rest = sorted((r for r in mine if r not in ends), key=lambda r: (-r[3], r[2] is not None, r[2] or 0, r[0]))
            out += [*ends, *(spread(rest, target - len(ends)) if target > len(ends) else [])]
    return sorted(r[0] for r in out)


@pytest.mark.parametrize("seed, limit", [(1, 3000), (2, 700), (3, 10**9), (4, 1), (5, 9000)])
def test_sample_types(spark, seed, limit):
    r = random.Random(seed)
    kinds = r.choices(["note", "note", "note", "reflection", "tweet", "image", "hub", "odd", None], k=400) + ["reflection"] * (seed % 2)
    rows = [(i, k, r.choice([None, *range(40)]), r.randint(0, 9) / 2, r.randint(0, 60)) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "id long, source_type string, created_at int, score double, token_estimate int").repartition(5)
    assert sorted(x["id"] for x in S.sample_types(df, limit).collect()) == by_list(rows, limit)


def test_sample_of_few_and_of_none(spark):
    schema = "id long, source_type string, created_at int, score double, token_estimate int"
    rows = [(1, "note", 3, 1.0, 50), (2, "tweet", 1, None, 50), (3, "hub", None, None, 0), (4, "image", None, None, 1000)]
    assert sorted(x["id"] for x in S.sample_types(spark.createDataFrame(rows, schema), 10).collect()) == [1, 2, 3, 4]
    assert S.sample_types(spark.createDataFrame([], schema), 10).count() == 0


def test_score_switches(spark):
    row = spark.createDataFrame([(True, "calm", None, 2, 9), (False, "", "high", 0, 0), (False, None, None, 1, 0)], "e boolean, mood string, energy string, links int, words int")
    score = lambda *p: [x[0] for x in row.select(S.note_score(F.col("e"), F.col("mood"), F.col("links"), F.col("words"), F.col("energy"), p)).collect()]
    assert score("emotional_content") == [4.0, 1.0, 0.0] and score("hub_connectivity") == [1.0, 0.0, 0.5] and score() == [0.0, 0.0, 0.0]
    assert score(*S.PRIORITIES) == [round(4 + 1 + 0.3 * 2.302585093, 6), 1.0, 0.5]
