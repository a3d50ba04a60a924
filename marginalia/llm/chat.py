"""Chat formatting in windows of a token budget: turn-aligned, system turn kept, limited history, masked repeats."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import bounded_batches
from .packing import encoder

# Strings that some chat template reads as control, longest first.
CONTROL = ("<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|eot_id|>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>", "</s>", "<s>")
TURN, END = "<|im_start|>", "<|im_end|>\n"

_ESCAPE = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def _joined(middle: str):
    def put(found: re.Match) -> str:
        head, slashes, tail = [g for g in found.groups() if g is not None]
        return f"{head}{middle}{slashes}{tail}"

    return put


def escape(text: str) -> str:
    """Put a backslash after the first character of every control string; strings that already have some get one more."""
    return _ESCAPE.sub(_joined("\\"), text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`, for any text."""
    return _UNESCAPE.sub(_joined(""), text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Budget:
    """Tokens of a window; turns and tokens of history that a later window may repeat."""

    tokens: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    target_role: str = "assistant"


@dataclass(frozen=True)
class _Turn:
    role: str
    text: str
    shown: str
    tokens: int
    total: int = 0  # tokens of the conversation up to and with this turn

    def body_at(self) -> int:
        return len(TURN) + len(escape_role(self.role)) + 1


def windows(turns: Iterator[tuple[str, str, str, int]], budget: Budget) -> Iterator[dict]:
    """The windows of one conversation's ``(role, text, shown, tokens)`` in order; holds one window at a time.

    With running totals of tokens, a window ends before the first turn whose total would pass the budget. The next one
    starts with the system turn (the first turn, if its role is system) and the longest run of the last turns
    that fits the history limits and still leaves room for the new turn. Repeated turns are never under the loss mask.
    A turn that is larger than the budget has a window of its own, whole.
    """
    system, recent, new, repeated, total, number = None, deque(maxlen=max(budget.history_turns, 1)), [], [], 0, 0

    def out() -> dict:
        text, spans = "", []
        for i, t in enumerate([*repeated, *new]):
            if i >= len(repeated) and t.role == budget.target_role:
                spans.append({"start": len(text) + t.body_at(), "end": len(text) + len(t.shown) - len(END)})
            text += t.shown
        return {"window": number, "n_repeated": len(repeated), "n_new": len(new), "n_tokens": sum(t.tokens for t in [*repeated, *new]), "formatted": text, "loss": spans}

    for role, text, shown, tokens in turns:
        total += tokens
        turn = replace(_Turn(role, text, shown, tokens), total=total)
        if new and turn.total - new[0].total + new[0].tokens + sum(t.tokens for t in repeated) > budget.tokens:
            yield out()
            number += 1
            room = budget.tokens - turn.tokens - (system.tokens if system else 0)
            past = [t for t in recent if t is not system] if budget.history_turns else []
            last = past[-1].total if past else 0
            past = [t for t in past if (used := last - t.total + t.tokens) <= budget.history_tokens and used <= room]
            repeated, new = [*([system] if system else []), *past], []
        if turn.total == tokens and role == "system" and not new and system is None and number == 0:
            system = turn
        new.append(turn)
        recent.append(turn)
    if new:
        yield out()


OUTPUT = "conv_id {}, window int, n_repeated int, n_new int, n_tokens long, formatted string, loss array<struct<start:int,end:int>>"


def format_conversations(rows: DataFrame, budget: Budget = Budget(), tokenizer_folder: str | None = None) -> DataFrame:
    """A row for each window: conv_id, window, n_repeated, n_new, n_tokens, formatted, loss (spans of code points).

    ``rows`` has conv_id, turn, role, text. Turns are escaped and counted where they lie, then meet by conversation and
    are streamed in order (turn, role, text; null turns first), so a conversation of any length takes one window
    of memory. Null roles and texts are empty; rows of null conv_id are one conversation; repeated rows are repeated
    turns; an empty table gives no windows. Ids may be of any type; other columns are ignored. A conversation is read in
    order by one task, in constant memory: its length bounds that task's time, and rows of null conv_id share one.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_folder)
        for b in batches:
            shown = [f"{TURN}{escape_role(r)}\n{escape(t)}{END}" for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.string()), pa.array([len(encode(x)) for x in shown], pa.int64())], names=[*b.schema.names, "shown", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        batches = chain([first], batches)
        schema = pa.schema([("conv_id", first.schema.field(0).type), ("window", pa.int32()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        stream = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))))
        out, held = [], 0
        ahead = next(stream, None)
        while ahead is not None:
            conv = ahead[0]

            def turns() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    now, ahead = ahead, next(stream, None)
                    yield now[1:]

            for w in windows(turns(), budget):
                out.append({"conv_id": conv, **w})
                held += len(w["formatted"])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = clean.mapInArrow(count, f"conv_id {kind}, turn long, role string, text string, shown string, tokens long")
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(cut, OUTPUT.format(kind))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted`` comes straight from :func:`format_conversations`: its windows of a conversation lie in order in one
    partition, so digests are carried from window to window.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        batches = chain([first], batches)
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state = None

        def row() -> dict:
            return {"conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["shown"]}

        for b in batches:
            out = []
            for conv, window, repeated, text, spans in zip(*(b.column(n).to_pylist() for n in ("conv_id", "window", "n_repeated", "formatted", "loss"))):
                if window == 0:
                    if state is not None:
                        out.append(row())
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "shown": 0}
                for role, body in _TURN.findall(text)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(learnt)
                    state["loss"].update(learnt.encode())
                state["shown"] += len(text)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
