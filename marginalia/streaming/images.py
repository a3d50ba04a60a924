"""Photos of a chat stream meet the next text: event-time order from timers and keyed state, whatever the batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

FOUND = "image_id long, chat_id long, text_id long"
#: Rows are settled by whole minutes and kept by the hour; about so many are held in memory at once, and results come out in
#: frames of so many.
SLOT_MS, SLOT, HOUR, HELD, FRAME = 60_000, 60_000_000, 3_600_000_000, 200_000, 10_000
#: A row in state: chat, time in microseconds, message, and 1 for a photo.
CHAT, AT, ID, PHOTO = range(4)


def _end(at: int) -> int:
    """The end of a minute, in milliseconds as timers and watermarks are."""
    return (at // SLOT + 1) * SLOT_MS


def _rows(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(-1, 4)


def _matched(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Photos in order of chat and time, and for each the place of its chat's next text in the sorted ``rows``; -1 without one."""
    rows[:] = rows[np.lexsort((rows[:, PHOTO], rows[:, ID], rows[:, AT], rows[:, CHAT]))]
    places = np.arange(len(rows))
    texts = np.where(rows[:, PHOTO] == 0, places, len(rows))
    following = np.minimum.accumulate(texts[::-1])[::-1]
    at = np.flatnonzero(rows[:, PHOTO] == 1)
    text = following[at]
    there = text < len(rows)
    there[there] = rows[text[there], CHAT] == rows[at[there], CHAT]
    return at, np.where(there, text, -1)


class _NextText(StatefulProcessor):
    """State of a group of chats: rows by hour until the watermark has passed their minute, and the photos that wait.

    When a timer fires, the minutes that the watermark has passed are settled in order of time: photos join those that wait, a
    text takes all of its chat's that have not waited too long. Rows are walked by stretches of whole hours of bounded size,
    and results depend on the rows' own times alone. State is read and written by the hour and not by the row, for all
    chats of the group at once. There is one timer ahead: for the next minute that can be settled, or the end of a photo's wait.
    """

    def __init__(self, wait: int):
        self.wait = wait  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "rows binary")
        self.photos = handle.getValueState("photos", "rows binary")

    def _add(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, AT], kind="stable")]
        hours, starts = np.unique(rows[:, AT] // HOUR, return_index=True)
        for hour, part in zip(hours.tolist(), np.split(rows, starts[1:])):
            old = self.hours.getValue((hour,))
            self.hours.updateValue((hour,), ((bytes(old[0]) if old else b"") + part.tobytes(),))
        self.handle.registerTimer(_end(int(rows[0, AT])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows:
            held.append(frame[["chat_id", "at", "message_id", "photo"]].to_numpy(np.int64))
            n += len(frame)
            if n >= HELD:
                self._add(np.concatenate(held))
                held, n = [], 0
        if n:
            self._add(np.concatenate(held))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // SLOT_MS * SLOT  # rows before it are settled, all others wait
        kept = sorted(k[0] for k in self.hours.keys())
        due = [h for h in kept if h * HOUR < passed]
        before = self.photos.get() if self.photos.exists() else None
        waiting = _rows(bytes(before[0])) if before else np.empty((0, 4), np.int64)
        left = kept[len(due)] * HOUR if len(due) < len(kept) else None  # no later than the first row of what is left
        held, n = [], 0
        for i, hour in enumerate(due):
            rows = _rows(bytes(self.hours.getValue((hour,))[0]))
            later = rows[:, AT] >= passed
            if later.any():
                left = int(rows[later, AT].min())
            if not later.all():
                held.append(rows[~later])
                n += len(held[-1])
                if later.any():
                    self.hours.updateValue((hour,), (rows[later].tobytes(),))
                else:
                    self.hours.removeKey((hour,))
            if n and (n >= HELD or i == len(due) - 1):
                rows = np.concatenate([waiting, *held])
                held, n = [], 0
                at, text = _matched(rows)
                found, taken = at[text >= 0], text[text >= 0]
                yield from self._said(key, rows[found], np.where(rows[taken, AT] - rows[found, AT] <= self.wait, taken, -1), rows)
                waiting = rows[at[text < 0]]
        gone = waiting[:, AT] + self.wait < passed  # all texts that could have ended their wait are settled
        yield from self._said(key, waiting[gone], np.full(int(gone.sum()), -1), waiting)
        waiting = waiting[~gone]
        if waiting.tobytes() != (bytes(before[0]) if before else b""):
            self.photos.update((waiting.tobytes(),)) if len(waiting) else self.photos.clear()
        ahead = ([] if left is None else [left]) + ([int(waiting[:, AT].min()) + self.wait] if len(waiting) else [])
        if ahead:
            self.handle.registerTimer(_end(min(ahead)))

    def _said(self, key, photos: np.ndarray, text: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Photos with the message at the place ``text`` of ``rows``, -1 for none, in frames of bounded size."""
        for i in range(0, len(photos), FRAME):
            part, place = photos[i : i + FRAME], text[i : i + FRAME]
            chat = pd.array(part[:, CHAT], "Int64") if key[0] >= 0 else pd.array([None] * len(part), "Int64")
            said = pd.arrays.IntegerArray(rows[place, ID], place < 0)
            yield pd.DataFrame({"image_id": pd.array(part[:, ID], "Int64"), "chat_id": chat, "text_id": said})

    def close(self) -> None:
        pass


def associate_images(updates: DataFrame, wait: str = "1 day", late: str = "10 minutes", groups: int = 64) -> DataFrame:
    """``image_id, chat_id, text_id``: every photo with the first later text of its chat (in order of ts, message_id).

    A photo that has waited longer than ``wait`` when that text comes, or when the watermark passes the minute in which its wait
    ends, has a null text. Rows may come up to ``late`` out of order; later ones are dropped, as are rows without a time. A photo
    comes out once the minute of its text lies behind the watermark. One batch or many give the same rows. Chats are
    dealt out to ``groups``, which share state; rows without a chat are a group, and one chat, of their own. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    group = F.when(F.col("chat_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("chat_id"), F.lit(groups)).cast("int")).alias("chats")
    said = updates.where("kind in ('photo', 'text', 'captioned') and ts is not null")
    seen = said.select(group, F.coalesce("chat_id", F.lit(0)).cast("long").alias("chat_id"), "message_id", "ts", (F.col("kind") == "photo").cast("long").alias("photo"), F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return seen.groupBy("chats").transformWithStateInPandas(_NextText(pd.Timedelta(wait) // pd.Timedelta(microseconds=1)), StructType.fromDDL(FOUND), "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
