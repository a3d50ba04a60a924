"""MinHash near-dedup with fast similarity sketches: bin-placement rounds, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, fresh, join_facts, materialise
from .components import components

_FULL = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Near:
    """Shingle length in words, likeness in percent, bands and coordinates in a band.

    Twenty bands of four miss a pair at exactly 80 % with a chance of about 3 in 100,000, and more alike pairs less.
    """

    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEGMENT = 1 << 20
_LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes, in whole-array steps over the bytes of a text."""

    def __init__(self, words: int):
        self.words = words
        self._powers(_SEGMENT // 16)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        self.up, self.down = (np.cumprod(np.concatenate([one, np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64)))

    def _hashes(self, data: bytes) -> np.ndarray:
        """A hash of each word: the polynomial of its bytes, from running sums over the whole segment."""
        b = np.frombuffer(data, np.uint8)
        if len(b) > len(self.up):
            self._powers(2 * len(b))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[b], [True]])))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * self.up[: len(b)], out=sums[1:])
        h = _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > _LONG_WORD):  # regular words of about a thousand bytes could share a polynomial
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        """A-Z lower-cased, split at ASCII white space; fewer words than a shingle are one shingle, none an empty set."""
        data, parts, at = text.encode().lower() if text else b"", [], 0
        while len(data) - at > _SEGMENT:  # long texts in segments that end at white space
            cut = next((i for i in range(at + _SEGMENT, len(data)) if _BLANK[data[i]]), len(data))
            parts.append(self._hashes(data[at:cut]))
            at = cut
        parts.append(self._hashes(data[at:]))
        h = np.concatenate(parts)
        if not len(h):
            return np.empty(0, np.uint64)
        k = min(self.words, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(_BASE) + h[i : i + n])
        return np.unique(out)


def sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch: ``size`` coordinates, equal in two sets with the chance of their Jaccard likeness.

    Round i puts every element into one hashed bin with a value in [i, i + 1); a bin keeps its least value. Rounds end
    when all bins are filled, since later values are larger; from round ``size`` on, every element goes to bin i - size,
    so after twice ``size`` rounds none is empty. Large sets need a round or two, and values are concentrated as in
    sampling without replacement.
    """
    bins = np.full(size, _FULL)
    with np.errstate(over="ignore"):
        for i in range(2 * size):
            h = _mix(hashes + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
            value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
            if i < size:
                np.minimum.at(bins, ((h & np.uint64(0xFFFF)) % np.uint64(size)).astype(np.intp), value)
            else:
                bins[i - size] = min(bins[i - size], value.min())
            if (bins != _FULL).all():
                break
    return bins


def sketch_table(docs: DataFrame, near: Near, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, k1, k2 (128-bit digest of the set), bands (a 64-bit key for each band). No shuffle."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(near.words)
        for b in batches:
            n, k1, k2, bands = [], [], [], []
            for t in b.column(1):
                with np.errstate(over="ignore"):
                    s = cut(t.as_py())
                n.append(len(s))
                d = xxhash.xxh128_digest(s.tobytes())
                a, c = np.frombuffer(d, np.int64)
                k1.append(int(a))
                k2.append(int(c))
                if len(s):
                    coords = sketch(s, near.bands * near.rows).reshape(near.bands, near.rows)
                    bands.append(np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(coords)], np.uint64).view(np.int64))
                else:
                    bands.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "n_shingles", "k1", "k2", "bands"])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(make, f"doc_id {kind}, h long, n_shingles int, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, near: Near, text: str = "text") -> DataFrame:
    """k1, k2, shingles (all of them, sorted)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(near.words)
        for b in batches:
            with np.errstate(over="ignore"):
                sets = [cut(t.as_py()) for t in b.column(0)]
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k1", "k2", "shingles"])

    return docs.select(text).mapInArrow(make, "k1 long, k2 long, shingles array<long>")


def _alike(a: str, b: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(a, b)).cast("long")
    return shared * 100 >= (F.size(a) + F.size(b) - shared) * percent


def _pivot_links(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links between the members of a bucket and its pivot, each pair once, verified on full sets.

    The pivot is the member whose own buckets are the fullest: among near copies the one that most others resemble.
    """
    total = members.count()
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    fame = join_facts(members, sizes.withColumn("size", F.col("n")), ["bucket"], total).groupBy("rep").agg(F.sum("size").alias("fame"))
    pivots = members.join(fame, "rep").groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("rep")).alias("r"))).alias("p"), F.count(F.lit(1)).alias("n")).select("bucket", (-F.col("p.r")).alias("pivot"), "n")
    pairs = join_facts(members, pivots, ["bucket"], total).where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")).join(many, "b")
    return join_facts(pairs.join(left, "a"), right, ["b"], total).where(_alike("s_a", "s_b", near.percent)).select("a", "b")


def _rest_links(members: DataFrame, found: DataFrame, sets: DataFrame, near: Near, chunk: int = 512) -> DataFrame:
    """The links that pivots leave open, as few as join the parts they connect.

    In each bucket that still holds several components, every member outside the commonest one is compared on full sets
    with every member of another component. Chunks of members meet in pairs of chunks, so a task holds two chunks however large the
    bucket; inside, an inverted index finds overlaps, and only links that join components leave it.
    """
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
    parts = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size")).where("parts > 1 and size > 2")
    open_ = open_.select("bucket", F.col("size").alias("n"), F.col("m.part").alias("common"), F.ceil(F.col("size") / chunk).cast("int").alias("n_all"), F.ceil((F.col("size") - F.col("m.n")) / chunk).cast("int").alias("n_rest"))
    rows = join_facts(labelled, open_, ["bucket"], members.count())
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = rows.select("bucket", "rep", "part", F.lit(False).alias("rest"), "n_rest", mine("n_all").alias("j")).select("bucket", "rep", "part", "rest", every("n_rest").alias("i"), "j")
    rest = rows.where("part <> common").select("bucket", "rep", "part", F.lit(True).alias("rest"), "n_all", mine("n_rest").alias("i")).select("bucket", "rep", "part", "rest", "i", every("n_all").alias("j"))
    kind = members.schema["rep"].dataType.simpleString()
    percent = near.percent

    def compare(group: pa.Table) -> pa.Table:
        reps, parts, is_rest, sets_ = (group.column(c).to_pylist() if c != "shingles" else [x.values.to_numpy(zero_copy_only=False) for x in group.column(c)] for c in ("rep", "part", "rest", "shingles"))
        at = [i for i, r in enumerate(is_rest) if not r]
        sizes = np.array([len(sets_[i]) for i in at])
        owner = np.repeat(np.arange(len(at)), sizes)
        values = np.concatenate([sets_[i] for i in at]) if at else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        root: dict = {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for i in (i for i, r in enumerate(is_rest) if r):
            lo, hi = np.searchsorted(values, sets_[i], "left"), np.searchsorted(values, sets_[i], "right")
            n = hi - lo
            hits = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[hits], minlength=len(at))
            for k in np.flatnonzero(shared * 100 >= (sizes + len(sets_[i]) - shared) * percent):
                p, q = top(parts[i]), top(parts[at[k]])
                if p != q:
                    root[p] = q
                    a.append(reps[i])
                    b.append(reps[at[k]])
        kind_ = group.schema.field("rep").type
        return pa.table({"a": pa.array(a, kind_), "b": pa.array(b, kind_)})

    return whole.union(rest).join(sets.select("rep", "shingles"), "rep").groupBy("bucket", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def _verdicts(docs: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """The rows of :func:`near_duplicates`, with h, a hash of the text.

    A class is named by the digest of its set; those that share a band key with another get a number, written once, as
    their node. So neither repeated nor null doc_ids mix up classes. The smallest doc_id, and of its texts the one of the
    least hash, stands for a class or component.
    """
    table = materialise(sketch_table(docs, near, key, text), "sketches")
    full = table.where("n_shingles > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("lead")
    classes = full.groupBy("k1", "k2").agg(lead, F.count(F.lit(1)).alias("n"))
    banded = full.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(join_facts(banded, shared, ["bucket"], near.bands * table.count()).distinct(), "met")
    wanted = materialise(met.select("k1", "k2").distinct().join(classes.drop("n"), ["k1", "k2"]).withColumn("rep", F.monotonically_increasing_id()), "nodes")
    members = materialise(met.join(wanted.select("k1", "k2", "rep"), ["k1", "k2"]).select("bucket", "rep"), "members")
    of_lead = wanted.select(F.col("lead.doc_id").alias("_id"), F.col("lead.h").alias("_h")).hint("merge")
    keyed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    chosen = keyed.join(of_lead, keyed["doc_id"].eqNullSafe(of_lead["_id"]) & (F.col("h") == F.col("_h")), "left_semi")
    sets = shingle_sets(chosen, near).join(wanted.select("k1", "k2", "rep"), ["k1", "k2"])
    sets = materialise(sets.select("rep", "shingles").dropDuplicates(["rep"]), "sets")
    found = components(_pivot_links(members, sets, near))
    more = materialise(_rest_links(members, found, sets, near), "rest")
    label = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    joined = components(more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    first = wanted.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "lead", F.coalesce("component", "rep").alias("first"))
    first, nodes = materialise(first, "first"), wanted.count()
    ends = joined.withColumnRenamed("node", "first").join(first.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "first")
    last = materialise(join_facts(first, ends, ["first"], nodes, "left").select("k1", "k2", "lead", F.coalesce("component", "first").alias("last")), "labels")
    best = last.groupBy("last").agg(F.min("lead").alias("best"), F.count(F.lit(1)).alias("n"))
    named = join_facts(last.select("k1", "k2", "last"), best, ["last"], nodes)
    leads = classes.join(named, ["k1", "k2"], "left").select("k1", "k2", "n", F.coalesce("best", "lead").alias("lead"))
    leads = materialise(leads.select("k1", "k2", "n", F.col("lead.doc_id").alias("lead_id"), F.col("lead.h").alias("lead_h")), "leads")
    out = join_facts(table.drop("bands"), leads, ["k1", "k2"], table.count(), "left")
    alone = F.col("n_shingles") == 0
    kept = alone | F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("h") == F.col("lead_h"))
    return out.select("doc_id", F.col("n_shingles").cast("long"), F.when(alone, F.col("doc_id")).otherwise(F.col("lead_id")).alias("component_id"), kept.alias("kept"), "k1", "k2", "h")


def near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, k1, k2.

    Equal shingle sets are one class, so exact copies, however many, never meet in pairs. Classes that share a band key are
    candidates; a link counts if the full sets are alike. Each bucket is first linked to its pivot; buckets that then hold several
    components are compared exactly. So any two candidates that are alike end in one component, without all pairs of a
    bucket. Sets are of 64-bit shingle hashes. Null and empty texts have no shingles and link with nothing. Rows of null doc_id
    link as others do; their component_id is null if no row of their component has a doc_id. One text of a component is
    kept, in each row that repeats it with its doc_id; texts of one doc_id are told apart. Extra columns are ignored; an
    empty table gives no rows.
    """
    return _verdicts(docs, near, key, text).drop("h")


def drop_near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each group, once, with all its columns, whatever their names.

    Rows without shingles stay, one of each doc_id and text; an empty table gives no rows.
    """
    own, found, hashed_as = fresh(docs.columns, "_h", "_id", "_k")
    stay = _verdicts(docs, near, key, text).where("kept").select(F.col("doc_id").alias(found), F.col("h").alias(hashed_as)).distinct()
    rows = docs.withColumn(own, F.xxhash64(text))
    rows = rows.join(stay, rows[key].eqNullSafe(stay[found]) & (F.col(own) == F.col(hashed_as)), "left_semi")
    return rows.dropDuplicates([key, own]).drop(own)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN [t[1]] ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE i * 100 >= (na + nb - i) * 80),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, d.doc_id = coalesce(m.root, d.doc_id) AS kept
FROM (SELECT doc_id, list_sort(s) AS s FROM s) d LEFT JOIN c ON c.s = d.s LEFT JOIN m ON m.node = c.rep"""
