"""Embedding near-dedup: a pigeonhole join over low-dimensional blocks of rotated vectors, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, join_facts, materialise
from .components import components

COSINE = 0.98
BLOCK = 8
SEED = 20240607


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix: spreads the difference of two vectors over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Rows of one side that a task compares at a time; a label or cell with more is dealt over several.
GROUP = 20_000
#: Width of a cell of the fine grid, as a multiple of the radius (1 or more: only adjacent cells can be within it).
FINE = 1.5


def grid_pairs(p: np.ndarray, q: np.ndarray | None, room: float, step: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
    """``(i, j)``: the rows of ``p`` and ``q`` (or of ``p`` alone, i and j in no order) within a squared distance of ``room``,
    and how many pairs were compared.

    A grid over all coordinates. A row looks into those cells only that its ball meets; the offsets are grown coordinate by
    coordinate and given up as soon as their distance exceeds the radius. Within one set, each pair of cells is looked at
    from one side.
    """
    own, q, width = q is None, p if q is None else q, FINE * np.sqrt(room)
    odd = (np.random.default_rng(3).integers(0, 2**62, p.shape[1], dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    key = lambda x: (np.floor(x / width).astype(np.int64).view(np.uint64) * odd).sum(1, dtype=np.uint64)
    order = np.argsort(key(q), kind="stable")
    keys, q_sorted = key(q)[order], q[order]
    left, right, compared = [np.empty(0, np.intp)], [np.empty(0, np.intp)], 0
    limit = room * (1 + 1e-9)
    for start in range(0, len(p), step):
        part = p[start : start + step]
        below = part - np.floor(part / width) * width
        row, cost, at, up = np.arange(len(part)), np.zeros(len(part)), key(part), np.zeros(len(part), bool)
        for t in range(p.shape[1]):
            low, high = cost + below[row, t] ** 2, cost + (width - below[row, t]) ** 2
            down_ok, up_ok = low <= limit, high <= limit
            if own:
                down_ok &= up
            row, at, cost, up = (
                np.concatenate([row, row[down_ok], row[up_ok]]), np.concatenate([at, at[down_ok] - odd[t], at[up_ok] + odd[t]]),
                np.concatenate([cost, low[down_ok], high[up_ok]]), np.concatenate([up, up[down_ok], np.ones(int(up_ok.sum()), bool)]))
        lo = np.searchsorted(keys, at, "left")
        n = np.searchsorted(keys, at, "right") - lo
        hit = np.flatnonzero(n)
        edges = np.searchsorted(np.cumsum(n[hit]), np.arange(0, int(n.sum()), 2_000_000), "left") if len(hit) else []
        for a, b in zip(edges, [*edges[1:], len(hit)]):
            h = hit[a:b]
            if not len(h):
                continue
            first = np.repeat(lo[h] - np.concatenate([[0], np.cumsum(n[h])[:-1]]), n[h]) + np.arange(n[h].sum())
            i, j = np.repeat(row[h], n[h]), first
            if own:  # the own cell: each pair once
                fine = np.repeat(up[h], n[h]) | (i + start < order[j])
                i, j = i[fine], j[fine]
            compared += len(i)
            close = ((part[i] - q_sorted[j]) ** 2).sum(1) <= room
            left.append(i[close] + start)
            right.append(order[j[close]])
    return np.concatenate(left), np.concatenate(right), compared


def _parts(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """cid, label, dims, block, cell, visits, part: each block of each rotated unit vector, in its coarse cell and, as a
    visitor, in each later cell that its ball meets. The coarse grid goes over the first ``axes`` coordinates of a block;
    with none, a label is one cell."""
    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dims: dict[int, list[int]] = {}
            vectors, axes = b.column(2).to_pylist(), b.column(3).to_numpy()
            for i, v in enumerate(vectors):
                by_dims.setdefault(len(v), []).append(i)
            for dims, rows in by_dims.items():
                v = np.array([vectors[i] for i in rows], dtype=np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(dims)
                for k, first in enumerate(range(0, dims, block)):
                    part = v[:, first : first + block]
                    reach = np.sqrt(block_room(dims, part.shape[1], cosine))
                    part = np.pad(part, ((0, 0), (0, block - part.shape[1])))
                    at, cell, visits = _coarse_cells(part, axes[rows], reach)
                    taken = pa.array(np.array(rows)[at])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(taken), b.column(1).take(taken), pa.array(np.full(len(at), dims, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(cell), pa.array(visits), pa.array([x.tobytes() for x in part[at]], pa.binary())],
                        names=["cid", "label", "dims", "block", "cell", "visits", "part"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "vector", "axes").mapInArrow(rotate, f"cid long, label {label}, dims int, block int, cell long, visits boolean, part binary")


def _coarse_cells(part: np.ndarray, axes: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``part``, the cell each stands in or visits, and whether it visits. Cells are twice the reach wide, so of two
    neighbours on an axis the ball meets at most one; of two cells the later one, in order of axes, gets the visit."""
    width = 2 * reach
    odd = np.array([int(x) | 1 for x in np.random.default_rng(5).integers(0, 2**62, part.shape[1])], dtype=np.int64)
    home = np.floor(part / width).astype(np.int64)
    below = part - home * width
    with np.errstate(over="ignore"):
        at, cost, later = np.arange(len(part)), np.zeros(len(part)), np.zeros(len(part), bool)
        cell = np.where(np.arange(part.shape[1]) < axes[:, None], home * odd, 0).sum(1)
        for t in range(int(axes.max(initial=0))):
            down = below[at, t] < reach
            gap = cost + np.where(down, below[at, t], width - below[at, t]) ** 2
            fits = (gap <= reach * reach * (1 + 1e-9)) & (t < axes[at]) & (later | ~down)
            at, cell, cost, later = (
                np.concatenate([at, at[fits]]), np.concatenate([cell, cell[fits] + np.where(down[fits], -odd[t], odd[t])]), np.concatenate([cost, gap[fits]]), np.concatenate([later, np.ones(int(fits.sum()), bool)]))
    return at, cell, later


def block_room(dims: int, size: int, cosine: float) -> float:
    """The squared distance that a block of ``size`` of ``dims`` coordinates may use up."""
    return (2 - 2 * cosine + 1e-9) * size / dims


def candidate_pairs(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``a, b``, once each: a superset of the pairs of equal label whose cosine is at least ``cosine``.

    Unit vectors of that cosine differ by at most ``2 - 2 cosine`` squared; shared out over the blocks in proportion to
    their dimensions, at least one block keeps within its share. Each block is a range join. A label of more than
    ``group`` vectors is cut by a coarse grid, on more axes the more it holds; cells meet the visitors whose balls reach
    them; a cell that still holds more is dealt into chunks that meet two by two, so no task takes more than three
    times ``group`` rows. Inside a task a fine grid over all coordinates of the block finds the pairs.
    """
    large = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    axes = F.least(F.lit(block), F.ceil(F.log(F.col("n") / group) / F.log(F.lit(2.5)))).cast("int")
    placed = classes.join(large.select("label", axes.alias("axes")), "label", "left").withColumn("axes", F.coalesce("axes", F.lit(0)))
    parts = materialise(_parts(placed, cosine, block), "blocks")
    place = ["label", "dims", "block", "cell"]
    cells = parts.groupBy(*place).agg(F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("guests"))
    crowded = cells.where((F.col("homes") > group) | (F.col("guests") > group)).select(*place, F.greatest(F.lit(1), F.ceil(F.col("homes") / group)).cast("int").alias("c"), F.ceil(F.col("guests") / group).cast("int").alias("v"))
    met = cells.where("homes > 0 and homes + guests > 1").select(*place)
    rows = parts.join(met, place, "left_semi").join(crowded, place, "left").withColumn("x", F.pmod(F.xxhash64("cid"), F.when(F.col("visits"), F.col("v")).otherwise(F.col("c"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    none = F.array().cast("array<struct<kind:int,i:int,j:int>>")
    homes = F.transform(upto("c"), lambda y: meet(0, F.least("x", y), F.greatest("x", y)))
    hosts = F.when(F.col("v") > 0, F.transform(upto("v"), lambda u: meet(1, u, F.col("x")))).otherwise(none)
    guests = F.transform(upto("c"), lambda y: meet(1, F.col("x"), y))
    groups = F.when(F.col("c").isNull(), F.array(meet(2, F.lit(0), F.lit(0)))).when(F.col("visits"), guests).otherwise(F.concat(homes, hosts))
    dealt = rows.withColumn("g", F.explode(groups)).select("cid", "dims", "visits", "part", "x", "label", "block", "cell", "g.kind", "g.i", "g.j")

    def join(table: pa.Table) -> pa.Table:
        dims, kind, i, j = (table.column(c)[0].as_py() for c in ("dims", "kind", "i", "j"))
        k = table.column("block")[0].as_py()
        room = block_room(dims, min(block, dims - k * block), cosine)
        cid, visits = table.column("cid").to_numpy(), table.column("visits").to_numpy(zero_copy_only=False)
        part = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float64).reshape(len(cid), block)
        found = []

        def meet(a: np.ndarray, b: np.ndarray | None) -> None:
            if len(a) and (b is None or len(b)):
                p, q, _ = grid_pairs(part[a], None if b is None else part[b], room)
                found.append((cid[a][p], cid[a if b is None else b][q]))

        home, guest = np.flatnonzero(~visits), np.flatnonzero(visits)
        if kind == 0 and i != j:
            x = table.column("x").to_numpy()[home]
            meet(home[x == i], home[x == j])
        elif kind != 1:
            meet(home, None)
        if kind:
            meet(guest, home)
        a, b = (np.concatenate([f[n] for f in found]) if found else np.empty(0, np.int64) for n in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return dealt.groupBy(*place, "kind", "i", "j").applyInArrow(join, "a long, b long").distinct()


def link_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", label: str = "label", group: int = GROUP) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors of equal, non-null labels and equal length link at ``cosine`` or more in double precision. Equal vectors of a label
    are one class that carries its count, so copies are never paired. Vectors that are null, zero or hold null or
    non-finite components, and vectors without label or key, link with nothing and are their own component. Repeated rows
    count as vectors, also under one key with different vectors. Extra columns are ignored; an empty table gives no rows.
    Links inside a large group of near copies are all found, because ``n_links`` counts them.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2048)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fit = F.col("label").isNotNull() & F.col("key").isNotNull() & usable(F.col("vector"))
    k1, k2 = F.xxhash64("vector", "label"), F.xxhash64(F.lit("second"), "label", "vector")
    rows = rows.withColumn("k1", F.when(fit, k1)).withColumn("k2", F.when(fit, k2))
    classes = rows.where(F.col("k1").isNotNull()).groupBy("label", "k1", "k2").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # squares of very small or large components leave the range of doubles: such vectors are scaled, which changes no cosine
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    scaled = F.when(top.between(1e-100, 1e100), F.col("vector")).otherwise(F.transform("vector", lambda x: x / top))
    unit = classes.select("cid", "n", scaled.alias("vector")).withColumn("norm", F.sqrt(_dot("vector", "vector")))
    pairs = candidate_pairs(classes, cosine, block, group)
    left = unit.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("vector").alias("v_a"), F.col("norm").alias("l_a"))
    right = unit.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("vector").alias("v_b"), F.col("norm").alias("l_b"))
    value = _dot("v_a", "v_b") / (F.col("l_a") * F.col("l_b"))
    links = materialise(pairs.join(left, "a").join(right, "b").where(value >= cosine).select("a", "b", "n_a", "n_b"), "links")
    degree = links.select(F.col("a").alias("cid"), F.col("n_b").alias("m")).union(links.select(F.col("b").alias("cid"), F.col("n_a").alias("m"))).groupBy("cid").agg(F.sum("m").alias("m"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = components(links).join(classes.select(F.col("cid").alias("node"), "lead"), "node").select("component", F.col("node").alias("cid"), "lead")
    best = found.groupBy("component").agg(F.min("lead").alias("best"), F.count(F.lit(1)).alias("n"))
    leads = join_facts(found, best, ["component"], total).select("cid", "best")
    classes = classes.select("k1", "k2", "lead", "cid", "n", F.col("n").alias("copies")).join(degree, "cid", "left").join(leads, "cid", "left").drop("cid")
    out = rows.select("key", "k1", "k2")  # rows that link with nothing meet no class
    out = join_facts(out.where(F.col("k1").isNotNull()), classes, ["k1", "k2"], total).unionByName(out.where(F.col("k1").isNull()), allowMissingColumns=True)
    component = F.coalesce("best", "lead", "key")
    return out.select(
        F.col("key").alias(key), (F.coalesce("m", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(embedding, embedding) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= {COSINE}),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id"""
