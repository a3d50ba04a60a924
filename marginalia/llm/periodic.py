"""Periodic runs of words: Lyndon arrays from suffix grouping under both orders, roots extended into runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import bounded_batches, columns, fresh

#: Two moduli below 2**31 and a base for each; other bases are tried should two stretches share both sums.
_MODULI = (2147483647, 2147483629)
_BASES = ((911382323, 972663749), (1234567891, 987654321), (1597463007, 1442695041))


@dataclass(frozen=True)
class Least:
    """A run has at least ``length`` words and ``repeats`` (2 or more) periods."""

    length: int = 6
    repeats: int = 4


# ---------------------------------------------------------------- one sequence


def lyndon_array(letters: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there; 0 is a fence that no word crosses.

    Phase one of Baier's suffix sorting. Suffixes are grouped by first letter, groups lie in order, and are taken from the
    last to the first. The nearest place before a suffix whose group is lower is its predecessor. Predecessors that ``l``
    suffixes of the present group name leave their group for a new one just behind it, those with more names further
    behind; what is known of their beginning grows by ``l`` times the length known for the present group. When a
    group is taken, that length is the Lyndon word's. Each place is named once and each step back is made once, so time
    is linear but for sorting within groups.
    """
    n = len(letters)
    order = np.argsort(np.array(letters, np.int64), kind="stable").tolist()
    where, group, size, known = [0] * n, [0] * n, [0] * n, [0] * n
    first = 0
    for at, i in enumerate(order):
        if letters[i] != letters[order[first]]:
            first = at
        where[i], group[i] = at, first
        size[first] += 1
        known[first] = 1
    before, out, end = [-1] * n, [1] * n, n
    fences = letters.count(0)
    while end > fences:
        first = group[order[end - 1]]
        grown, members = known[first], order[first:end]
        if len(members) > 1:
            members.sort()
        named: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i], out[i] = j, grown
            if j >= 0 and letters[j]:
                named[j] = named.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in named.items():
            moves.setdefault((-times, group[j]), []).append(j)
        for times, old in sorted(moves) if len(moves) > 1 else moves:
            moved = moves[times, old]
            new = old + size[old] - len(moved)
            size[old] -= len(moved)
            known[new] = known[old] - times * grown
            size[new] = len(moved)
            for at, j in enumerate(moved, new):
                other, there = order[at], where[j]
                order[at], order[there] = j, other
                where[j], where[other] = at, there
                group[j] = new
        end = first
    return out


class _Sums:
    """Polynomial sums of a sequence, by which two stretches are compared in constant time."""

    def __init__(self, letters: np.ndarray, bases: tuple[int, int]):
        self.sums, self.powers = [], []
        for base, modulus in zip(bases, _MODULI):
            powers = np.ones(1, np.int64)
            step = base
            while len(powers) <= len(letters):
                powers = np.concatenate([powers, powers * step % modulus])
                step = step * step % modulus
            self.powers.append(powers)
            self.sums.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(letters % modulus * powers[: len(letters)] % modulus)]))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` at ``a`` and at the later ``b`` agree."""
        same = np.ones(len(a), bool)
        for sums, powers, modulus in zip(self.sums, self.powers, _MODULI):
            same &= (sums[a + length] - sums[a]) % modulus * powers[b - a] % modulus == (sums[b + length] - sums[b]) % modulus
        return same

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the stretches from ``a`` and ``b`` agree, forwards, or backwards from just before them."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _extended(letters: np.ndarray, roots: np.ndarray, bases: tuple[int, int], least: Least) -> np.ndarray:
    """Rows of start, end, period: the roots (rows of place, period) extended both ways, long enough ones only, once each."""
    i, q = roots.T
    sums = _Sums(letters, bases)
    right = sums.common(i, i + q, len(letters) - i - q, back=False)
    left = sums.common(i, i + q, i, back=True)
    length = left + q + right
    found = np.stack([i - left, i + q + right, q], axis=1)
    return np.unique(found[length >= np.maximum(least.length, least.repeats * q)], axis=0)


def _dense(ids: np.ndarray, least: Least) -> np.ndarray:
    """The places that may be in a run. Each word of a run comes ``repeats`` times in it, so rarer words part the
    sequence, then words rare in their part, until nothing changes; no run is lost, and none crosses a gap."""
    at = np.flatnonzero(np.bincount(ids)[ids] >= least.repeats) if len(ids) else np.zeros(0, np.int64)
    while len(at):
        part = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
        _, back, count = np.unique(part * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        stays = (count[back] >= least.repeats) & (np.bincount(part)[part] >= least.length)
        if stays.all():
            break
        at = at[stays]
    return at


def find_runs(ids: np.ndarray, least: Least = Least()) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of a sequence of non-negative numbers, by start, then period.

    A run's period occurs in it as a Lyndon word of one of the two orders of letters, and there the Lyndon array of that order
    shows it. So roots from both arrays, extended both ways as far as the period holds, are all runs. Extension is by
    sums of stretches and halving; every run found is compared exactly, and should one differ, other sums are taken.
    """
    at = _dense(ids, least)
    if not len(at):
        return []
    part = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
    _, letter = np.unique(ids[at], return_inverse=True)
    letters, place = np.zeros(len(at) + int(part[-1]), np.int64), np.arange(len(at)) + part
    letters[place] = letter + 1
    mirrored = np.where(letters > 0, letter.max() + 2 - letters, 0)
    arrays = [np.array(lyndon_array(x.tolist()), np.int64) for x in (letters, mirrored)]
    roots = np.unique(np.concatenate([np.stack([place, x[place]], axis=1) for x in arrays]), axis=0)
    padded = np.concatenate([letters, [0, 0]])  # before the first and beyond the last there is a fence
    i, q = roots.T
    beyond = np.minimum(i + q, len(letters))
    roots = roots[((padded[beyond] == letters[i]) | (padded[i - 1] == padded[i + q - 1])) & (least.repeats * q <= len(at))]
    if not len(roots):
        return []
    for bases in _BASES:
        found = _extended(letters, roots, bases, least)
        if all(np.array_equal(letters[a : b - q], letters[a + q : b]) for a, b, q in found):
            break
    else:
        raise ArithmeticError("sums of different stretches agree under all bases")
    original = np.zeros(len(letters), np.int64)
    original[place] = at
    return sorted((int(original[a]), int(b - a), int(q)) for a, b, q in found)


def runs_of_words(words: list[bytes], least: Least = Least()) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of a list of words, and the words that no run holds behind its first period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    runs = find_runs(ids, least)
    if not runs:
        return runs, words
    covered = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return runs, [words[i] for i in np.flatnonzero(np.cumsum(covered)[:-1] == 0)]


# ---------------------------------------------------------------- documents

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", least: Least = Least()) -> DataFrame:
    """``docs`` plus ``runs`` (by start, then period) and ``collapsed``: the text's words, each run cut to its first period.

    Words are parted by blanks and code points 9 to 13, and numbered from 0; in ``collapsed`` they are joined by one blank.
    Null and empty texts have no runs and collapse to the empty text; repeated rows get the same; an empty table gives no
    rows; columns named runs or collapsed are replaced, all others stay. One narrow pass: a worker holds one text, and
    time grows little faster than its length, whatever it holds.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            runs, kept = [], []
            for one in batch:
                spans, words = runs_of_words((one.as_py() or "").encode().split(), least)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in spans])
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays([pa.array(runs, kind), pa.array(kept, pa.string())], names=["runs", "collapsed"])

    kept = columns(c for c in docs.columns if c not in ("runs", "collapsed"))
    [out] = fresh([*docs.columns, "runs", "collapsed"], "_found")
    return docs.withColumn(out, found(*columns([text]))).select(*kept, f"{out}.runs", f"{out}.collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length for its period, the first of equal ones; null if there is none. Compared exactly."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_loops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which a tenth of the texts, by a checksum of their ids, repeat the words from some place on.

    With h the checksum, g = h // 10 and n words: if h % 10 = 0, the words from a = g % n on are those from a, taken again and
    again with the period 1 + (n - a) // (3 + g % 8). Other texts, and rows of null id, stay as they are.
    """
    h, n, g, a = fresh(docs.columns, "_h", "_n", "_g", "_a")
    [source] = columns([text])
    [words] = fresh([*docs.columns, h, n, g, a], "_words")
    looped = docs.withColumn(h, F.crc32(*[c.cast("string") for c in columns([doc_id])])).withColumn(
        words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(source, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0)))
    )
    looped = looped.withColumn(n, F.size(words).cast("long")).withColumn(g, F.floor(F.col(h) / 10)).withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.when(F.col(n) > 0, F.col(n))))
    period = 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))
    again = F.array_join(F.transform(words, lambda w, i: F.get(F.col(words), F.when(i >= F.col(a), F.col(a) + (i - F.col(a)) % period).otherwise(i).cast("int"))), " ")
    return looped.withColumn(text, F.when(F.col(n) > 0, again).otherwise(source)).select(*columns(docs.columns))


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text.

    Texts are those of :func:`with_loops`. Null texts have no runs, four nulls and the digests of the empty text; repeated
    rows get the same; an empty table gives no rows.
    """
    best, runs = F.col("best"), F.col("runs")
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat_ws("", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    found = periodic_runs(with_loops(docs.select("doc_id", "text"))).withColumn("best", strongest(runs))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
