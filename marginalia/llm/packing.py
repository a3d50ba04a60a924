"""Best-fit packing of token pieces after Martello-Toth dominance reduction, on the histogram of piece lengths."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, columns, fresh, hashed, materialise, running_sums

MAX_TOKENS = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"

# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=2)
def encoder(folder: str | None = None, name: str = VOCABULARY):
    """``text -> list of ids``, those of the vocabulary's json file without added ends; one for each Python worker.

    The rank file of the same vocabulary is about five times as fast as the json file and gives the same ids for texts that
    hold none of its added tokens (such a string, ``<|endoftext|>``, is one id). A single piece of thousands of
    characters makes its merges quadratic. Texts of either kind go through the json file, whose merges are not.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    at = (lambda f: f"{folder}/{f}") if folder else public_tokenizers.path
    with open(at(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(at(f"{name}.json"))
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    blanks = re.compile(r"\s{2000}")

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or len(text) > 2000 and (max(map(len, text.split()), default=0) > 2000 or blanks.search(text)):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, tokenizer_folder: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids``: every document's ids and a closing 0, cut only if over ``max_tokens``.

    Of a cut document all pieces but the first are full. ``ids`` are little-endian unsigned 32-bit numbers. Null and
    empty texts are the closing 0 alone. Ids of documents may be of any type; repeated rows give repeated pieces; other
    columns are ignored. No shuffle; a worker holds one document's ids and a few MB of output.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_folder)
        out, held, schema = [], 0, None
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(words.as_py() or ""), END_ID], dtype="<u4")
                first = len(ids) % max_tokens or min(len(ids), max_tokens)
                starts = [0, *range(first, len(ids), max_tokens)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((key, piece, a, b - a, ids[a:b].tobytes()))
                held += ids.nbytes
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- plan over the histogram


class _Sizes:
    """A multiset of sizes with the look-ups that the dominance rules need."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c}
        self.order = sorted(self.n)

    def take(self, size: int, many: int) -> None:
        self.n[size] -= many
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def smallest(self, many: int, without: int, above: int = 0) -> list[int]:
        """The ``many`` smallest items over ``above``, one item of size ``without`` left out."""
        out, i = [], bisect_left(self.order, above + 1)
        while i < len(self.order) and len(out) < many:
            s = self.order[i]
            out += [s] * min(many - len(out), self.n[s] - (s == without))
            i += 1
        return out

    def largest_within(self, room: int, without: int) -> int:
        """The largest item of at most ``room``, one item of size ``without`` left out; 0 if none."""
        i = bisect_left(self.order, room + 1) - 1
        while i >= 0 and self.n[self.order[i]] - (self.order[i] == without) <= 0:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def best_pair(self, room: int, without: int) -> tuple[int, int]:
        """Two items, the larger first, whose sum is the most within ``room``; (0, 0) if none."""
        best, i, j = (0, 0), 0, bisect_left(self.order, room) - 1
        while 0 <= i <= j:
            a, b = self.order[j], self.order[i]
            free = lambda s: self.n[s] - (s == without)
            if a + b > room or free(a) <= 0:
                j -= 1
            elif free(b) <= 0:
                i += 1
            else:
                if i < j or free(a) >= 2:
                    best = max(best, (a, b), key=sum)
                i += 1
        return best


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Fixed bins as ``(how many, sizes)``, and the counts that remain.

    From large to small sizes: an item that nothing fits beside is alone. If no two others fit beside it, or one fills
    the bin, the largest that fits goes with it. If two but never three fit, the largest single that fits goes with
    it when it weighs no less than any pair, or the best pair when its larger part is that single and no pair of items
    above its smaller part fits. Each of these sets dominates every other bin that could hold the item, so fixing it
    loses nothing. Equal items are fixed together.
    """
    sizes, fixed = _Sizes(counts), []
    for s in sorted(sizes.n, reverse=True):
        while sizes.n.get(s):
            room, few = capacity - s, sizes.smallest(3, without=s)
            fit = 0
            while fit < len(few) and sum(few[: fit + 1]) <= room:
                fit += 1
            top = sizes.largest_within(room, s)
            if not fit:
                bin_, many = (s,), sizes.n[s]
            elif fit == 1 or top == room:
                bin_ = (s, top)
                many = sizes.n[s] // 2 if top == s else min(sizes.n[s], sizes.n[top])
            elif fit == 2:
                a, b = sizes.best_pair(room, s)
                over = sizes.smallest(2, without=s, above=b)
                if top >= a + b:
                    bin_ = (s, top)
                    many = sizes.n[s] // 2 if top == s else min(sizes.n[s], sizes.n[top])
                elif top == a and (len(over) < 2 or sum(over) > room):
                    bin_ = (s, a, b)
                    many = min(sizes.n[x] // bin_.count(x) for x in bin_)
                else:
                    break
            else:
                break
            for x in bin_:
                sizes.take(x, many)
            fixed.append((many, bin_))
    return fixed, dict(sizes.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: bins as ``(how many, sizes)``; equal bins are handled together."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(many: int, room: int, items: tuple[int, ...]) -> None:
        if many:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
            open_.setdefault(room, []).append((many, items))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                put(left // each, capacity - each * s, (s,) * each)
                if rest := left % each:
                    put(1, capacity - rest * s, (s,) * rest)
                break
            room = rooms[at]
            many, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // s  # the fullest bin stays the fullest, so it takes what it can
            full = min(many, left // each)
            rest = min(left - full * each, each - 1) if full < many else 0
            put(full, room - each * s, items + (s,) * each)
            put(int(rest > 0), room - rest * s, items + (s,) * rest)
            put(many - full - (rest > 0), room, items)
            left -= full * each + rest
    return [x for found in open_.values() for x in found]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each size, rows of (first rank, first sequence, items of the size in a sequence, their offset)."""
    fixed, rest = dominance_reduction(counts, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for many, items in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for s in sorted(set(items), reverse=True):
            each = items.count(s)
            slots.setdefault(s, []).append((rank.get(s, 0), sequence, each, offset))
            rank[s] = rank.get(s, 0) + many * each
            offset += each * s
        sequence += many
    return {s: np.array(rows, dtype=np.int64) for s, rows in slots.items()}


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``sequence_id, offset`` to rows that have ``doc_id, piece, length`` (1 to ``max_tokens``).

    Only the histogram of lengths, ``max_tokens`` numbers at most, comes to the driver; there the dominance rules and
    best fit run once for each length, not for each piece. Every piece finds its place by its rank among the pieces of
    its length, made with bucketed sums, so a length that a third of all pieces share is no hot group. Repeated rows
    are packed as often as they come. An empty table gives an empty table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = plan(counts, max_tokens)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    at, before = fresh(pieces.columns, "_at", "_before")
    placed = pieces.select(*columns(kept)).withColumn(at, hashed("doc_id", "piece"))
    ranked = running_sums(placed, ["length"], at, F.lit(1), ("doc_id", "piece"), out=before).select(*columns(kept), before)
    length_at, rank_at = kept.index("length"), len(kept)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(length_at).to_numpy(), batch.column(rank_at).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                rows = where[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                behind = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + behind // row[:, 2]
                offset[mine] = row[:, 3] + behind % row[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:rank_at], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:rank_at])
    numbered = ranked.toDF(*[f"c{i}" for i in range(rank_at + 1)])  # names with dots do not go into mapInArrow
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token ids of each packed sequence, for a trainer. ``packed`` keeps ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def packed_digest(docs: DataFrame, max_tokens: int = MAX_TOKENS, tokenizer_folder: str | None = None) -> DataFrame:
    """Pieces with their checksum and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; repeated rows are packed as often as they come, and pieces of one
    doc_id that tie may swap places; an empty table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(docs, max_tokens=max_tokens, tokenizer_folder=tokenizer_folder)
    narrow = materialise(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(narrow, max_tokens)
