"""Exact token counts at every prefix of a text, by dynamic programming; budgets and cuts are answered from them."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches, columns, fresh

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Code points of a text that are looked at together, and the prefixes that one row of the prefix table holds.
BLOCK = 1 << 16
ROW = 4096
_CACHE = 600_000
_BOUNDARY = regex.compile(r"(?<=\S)\s")
_WIDE_SPACE = regex.compile(r"(?<!\s)\s{2,}(?=\S)")
# Suffixes that are split off, of which a part alone is split otherwise.
_SPLIT_LATE = {"'re", "'ve", "'ll"}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=4096)
def _unassigned(char: str) -> bool:
    return unicodedata.category(char) == "Cn"


class PrefixCounter:
    """Token counts at all prefixes of a text, for a byte-level BPE file of the tokenizers library.

    A token sequence is the encoding of its bytes if every two neighbours are that of theirs. So each prefix of a word has
    exactly one token that can end it: of the tokens found there by an Aho-Corasick scan, the one that is compatible
    with the last token of the prefix before it. ``count[i] = count[i - len(last[i])] + 1`` fills the table from left to
    right, in time linear in the word, however long it is. Words that come again are looked up.
    """

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not spec["normalizer"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = _byte_letters()
        self.tokens = ahocorasick.Automaton()
        for token in model["vocab"]:
            self.tokens.add_word(token, token)
        self.tokens.make_automaton()
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.made: dict[str, tuple[int, str, str]] = {}
        for rank, (left, right) in enumerate(pairs):
            self.made.setdefault(left + right, (rank, left, right))
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Words known: where their counts lie in ``flat``, how many, and the last of them."""
        self.index: dict[str, int] = {}
        self.start, self.length, self.last = (np.zeros(_CACHE, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(4 * _CACHE, np.int32), 0

    def merges_apart(self, left: str, right: str) -> bool:
        """Whether two tokens side by side stay two tokens.

        From the end backwards, the merge that came last is undone, the right one first where both are of one rank,
        since equal merges go from left to right. At no time may the two parts at the border merge before that.
        """
        border = 1 << 60
        while self.rank.get((left, right), 1 << 60) >= border:
            a, b = self.made.get(left), self.made.get(right)
            if b and (not a or b[0] >= a[0]):
                border, right = b[0] + 1, b[1]
            elif a:
                border, left = a[0], a[2]
            else:
                return True
        return False

    def dynamic(self, word: str) -> np.ndarray:
        """Tokens of each non-empty prefix of ``word``, taken as one piece."""
        data = word.encode("utf-8", "surrogatepass")
        count, last, fits = [0] * (len(data) + 1), [""] * (len(data) + 1), self.fits
        if len(fits) > _CACHE:
            fits.clear()
        for end, token in self.tokens.iter(data.decode("latin-1").translate(self.letters)):
            end += 1
            if not last[end]:
                at = end - len(token)
                pair = (last[at], token)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = not at or self.merges_apart(*pair)
                if fit:
                    last[end], count[end] = token, count[at] + 1
        counts = np.array(count[1:], np.int32)
        if len(data) > len(word):
            counts = counts[np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word]) - 1]
        return counts

    def learn(self, word: str) -> int:
        """A place in the table for a new word; a part of a late-split suffix counts as the two pieces it would be."""
        counts = self.dynamic(word)
        if word in _SPLIT_LATE:
            counts = np.array([1, 1 + self.dynamic(word[1])[-1], counts[-1]], np.int32)
        at, end = len(self.index), self.used + len(counts)
        if at == len(self.start):
            self.start, self.length, self.last = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.start, self.length, self.last))
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(counts)), np.int32)])
        self.flat[self.used : end] = counts
        self.start[at], self.length[at], self.last[at], self.used = self.used, len(counts), counts[-1], end
        self.index[word] = at
        return at

    def tables(self, words: list[str]) -> np.ndarray:
        """Counts at the prefixes of the text that these pieces make."""
        if len(self.index) > _CACHE or self.used > 16 * _CACHE:
            self.forget()
        known = self.index
        at = np.array([known[w] if w in known else self.learn(w) for w in words], np.int64)
        length, last = self.length[at], self.last[at]
        behind = np.cumsum(length) - length
        counts = self.flat[np.repeat(self.start[at] - behind, length) + np.arange(int(length.sum()))]
        return counts + np.repeat(np.cumsum(last) - last, length)

    def pieces(self, text: str) -> list[str]:
        """The library's pieces of a text without added tokens. Only for code points that this Python does not know can a
        newer table of letters differ, so such texts are cut by the library itself."""
        if text.isascii() or not any(map(_unassigned, set(text))):
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def plain(self, text: str) -> Iterator[np.ndarray]:
        """Counts at prefixes 1, 2, ... of a text without added tokens, some at a time."""
        total, start = 0, 0
        while start < len(text):
            cut = _BOUNDARY.search(text, start + BLOCK) if len(text) - start > BLOCK else None
            part = text[start : cut.start()] if cut else text[start:]
            counts = self.tables(self.pieces(part))
            whole = int(counts[-1])
            for run in _WIDE_SPACE.finditer(part):  # before a word the last blank of a run stands apart; at an end it does not
                a, b = run.span()
                counts[b - 1] = (counts[a - 1] if a else 0) + self.dynamic(run.group())[-1]
            yield counts + total
            total += whole
            start += len(part)

    def prefixes(self, text: str) -> Iterator[np.ndarray]:
        """Token counts of ``text[:1]``, ``text[:2]``, ... as the library gives them, in arrays of some length."""
        total, start = 0, 0
        for special in self.added.finditer(text) if self.added else ():
            ordinary = special.start() - start
            done, at_end = 0, 0
            for counts in self.plain(text[start : special.end() - 1]):
                if done < ordinary <= done + len(counts):
                    at_end = int(counts[ordinary - done - 1])
                done += len(counts)
                yield counts + total
            total += at_end + 1
            yield np.array([total])
            start = special.end()
        for counts in self.plain(text[start:]):
            yield counts + total


@lru_cache(maxsize=2)
def counter(path: str | None = None) -> PrefixCounter:
    """One table for each Python worker; ``path`` is that of the vocabulary file, by default of VOCABULARY."""
    import public_tokenizers

    return PrefixCounter(path or public_tokenizers.path(VOCABULARY))


def count_tokens(docs: DataFrame, limit: int = LIMIT, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` plus n_bytes, n_tokens, over_limit and fits_chars: the longest prefix, in code points, of at most ``limit`` tokens.

    All are read from the counts at every prefix of the whole text. Null and empty texts have no bytes and no tokens;
    repeated rows get the same; an empty table gives no rows; columns of the new names are replaced, all others stay. One
    narrow pass; a worker holds one text and the counts of some 65,000 prefixes, more only within a text's longest word.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,fits_chars:bigint>")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = counter(vocabulary)
        for batch in texts:
            found = []
            for one in batch:
                total, fits, done = 0, 0, 0
                for counts in table.prefixes(one.as_py() or ""):
                    within = np.flatnonzero(counts <= limit)
                    fits = done + int(within[-1]) + 1 if len(within) else fits
                    total, done = int(counts[-1]), done + len(counts)
                found.append((total, fits))
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["n_tokens", "fits_chars"])

    new = ("n_bytes", "n_tokens", "over_limit", "fits_chars")
    [out] = fresh([*docs.columns, *new], "_counted")
    kept = columns(c for c in docs.columns if c not in new)
    [source] = columns([text])
    size = F.coalesce(F.octet_length(source), F.lit(0)).cast("long").alias("n_bytes")
    tokens = F.col(f"{out}.n_tokens")
    return docs.withColumn(out, counted(source)).select(*kept, size, tokens, (tokens > limit).alias("over_limit"), F.col(f"{out}.fits_chars"))


def truncate(docs: DataFrame, limit: int = LIMIT, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``limit`` tokens; null stays null."""
    counted = count_tokens(docs.withColumn(text, F.col(text)), limit, text, vocabulary)
    cut = F.substring(F.col(text), F.lit(1), F.col("fits_chars").cast("int"))
    return counted.withColumn(text, cut).select(*columns(docs.columns))


def prefix_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, block, counts``: the stored table. ``counts[i]`` is the number of tokens of the first ``block * ROW + i`` code points.

    A text of n code points has n + 1 prefixes, the empty one first, so null and empty texts have one row of one 0. Repeated
    rows repeat; an empty table gives no rows; other columns are ignored. Rows are bounded, however long a text is.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, schema = counter(vocabulary), None

        def rows(key: object, words: str) -> Iterator[tuple]:
            held, block = np.zeros(1, np.int64), 0
            for counts in table.prefixes(words):
                held = np.concatenate([held, counts])
                while len(held) >= ROW:
                    yield key, block, held[:ROW]
                    held, block = held[ROW:], block + 1
            if len(held):
                yield key, block, held

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            flat, ends = np.concatenate([x[2] for x in out]).astype(np.int32), np.cumsum([0, *[len(x[2]) for x in out]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], schema.field(0).type), pa.array([x[1] for x in out], pa.int64()), lists], names=["doc_id", "block", "counts"])

        for batch in batches:
            schema, out = batch.schema, []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in rows(key, words.as_py() or ""):
                    out.append(row)
                    if len(out) == 256:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    return docs.select(*columns([doc_id, text])).mapInArrow(stored, f"doc_id {kind}, block long, counts array<int>")


def tokens_at(prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (doc_id, n_chars) plus n_tokens, looked up in the stored table by block; null beyond a text's end."""
    found = asked.withColumn("block", F.floor(F.col("n_chars") / ROW)).join(prefixes.select("doc_id", "block", "counts"), ["doc_id", "block"], "left")
    return found.withColumn("n_tokens", F.get("counts", (F.col("n_chars") % ROW).cast("int"))).drop("block", "counts")


def longest_within(prefixes: DataFrame, budget: int) -> DataFrame:
    """``doc_id, fits_chars``: from the stored table, the longest prefix of each document with at most ``budget`` tokens."""
    last = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return prefixes.groupBy("doc_id").agg(F.max(F.col("block") * ROW + last).alias("fits_chars"))
