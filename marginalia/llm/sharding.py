"""Sharding by a hierarchical weighted hash tree: region, rack and shard, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ._common import hashed, materialise, running_sums


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: int = 1


BASE_SHARDS = 16
RACK, REGION = 4, 8


def tree(shards: int, base: int = BASE_SHARDS) -> tuple[Leaf, ...]:
    """Equal shards: the first ``base`` in racks of 4 and regions of 8; each later one is a region of its own.

    A shard added as its own region changes no weight inside another subtree, so rows move into it and nowhere else.
    """
    first = [Leaf(i // REGION, i // RACK, i) for i in range(min(shards, base))]
    return tuple(first + [Leaf(base + i, base + i, i) for i in range(base, shards)])


def _draw(key: Sequence[Column], level: str, children: Sequence[tuple[int, int]]) -> Column:
    """The child of the smallest weighted hash draw, an exponential of rate ``weight`` for each child."""
    if len(children) == 1:
        return F.lit(children[0][0])
    draws = []
    for child, weight in children:
        unit = (F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(child), *key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def shard_of(key: Sequence[Column], leaves: Sequence[Leaf]) -> Column:
    """The shard of a key: a weighted draw among regions, then among the racks there, then among the shards there.

    A child's draws depend on the key and the child alone and its chance is its share of its siblings' weight: when
    weights change, keys move only between children whose weights changed, or into and out of them. Leaves of weight 0
    get nothing.
    """
    leaves = [x for x in leaves if x.weight > 0]
    weight = lambda rows: sum(x.weight for x in rows)
    regions = {r: [x for x in leaves if x.region == r] for r in dict.fromkeys(x.region for x in leaves)}

    def choose(picked: Column, options: dict[int, Column]) -> Column:
        items = list(options.items())
        out = items[-1][1]
        for name, result in items[:-1][::-1]:
            out = F.when(picked == name, result).otherwise(out)
        return out

    def inside(rows: list[Leaf]) -> Column:
        racks = {k: [x for x in rows if x.rack == k] for k in dict.fromkeys(x.rack for x in rows)}
        rack = _draw(key, "rack", [(k, weight(v)) for k, v in racks.items()])
        return choose(rack, {k: _draw(key, "shard", [(x.shard, x.weight) for x in v]) for k, v in racks.items()})

    region = _draw(key, "region", [(r, weight(v)) for r, v in regions.items()])
    return choose(region, {r: inside(v) for r, v in regions.items()})


def assign_shards(docs: DataFrame, leaves: Sequence[Leaf], key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add ``shard``. A map over rows: no shuffle. Rows of one key, null keys too, share a shard; a column of that name is
    replaced, all others stay; an empty table stays empty."""
    return docs.withColumn("shard", shard_of([F.col(k) for k in key], leaves).cast("int"))


def write_shards(docs: DataFrame, leaves: Sequence[Leaf], path: str, key: Sequence[str] = ("doc_id",), files: int = 8) -> None:
    """Write a folder for each shard; a shard's rows are dealt over ``files`` tasks, so no task writes a whole shard."""
    placed = assign_shards(docs, leaves, key)
    placed.repartition(files * len(leaves), "shard", F.pmod(F.xxhash64(*key), F.lit(files))).write.partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, shards: int = BASE_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards decide. Slots follow a hash of doc_id; they are ranks made of
    bucketed sums, so no task holds a shard. Null texts have size 1 and the checksum of no bytes; an empty table gives
    no rows; repeated rows share a shard and have slots of their own.
    """
    key = [F.col("doc_id")]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, tree(shards)).cast("int").alias("shard"), shard_of(key, tree(shards + 1)).cast("int").alias("grown_shard"), hashed("doc_id").alias("at"))
    ranked = running_sums(materialise(rows, "shards"), ["shard"], "at", F.lit(1), ("doc_id", "size", "text_crc32"))
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("before").cast("long").alias("slot"), "grown_shard")
