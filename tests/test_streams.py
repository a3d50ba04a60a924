"""Streams: rounds of a queue driven by the clock, and photos that meet the next text whatever the batches."""

import datetime as dt
import random

import pandas as pd
import pytest

from marginalia.streaming import images, queue

CAPTURES = "message_id long, priority int"


def rounds(spark, root, checkpoint, source, batch, keep=2, process=lambda q: q.select("message_id")):
    stream = spark.readStream.schema(CAPTURES).json(source)
    running = queue.process_periodically(stream, root, checkpoint, process, batch, keep=keep).trigger(processingTime="1 second").start()
    return queue.drain(spark, running, root, stream.schema, keep=keep, most_seconds=120)


def done(spark, root):
    return sorted((r["round"], r["message_id"]) for r in spark.read.schema("message_id long, round int").parquet(f"{root}/done").collect())


def test_a_backlog_is_worked_off_without_new_input(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(14)] + [(None, 0), (3, 0)], CAPTURES).coalesce(1).write.json(f"{tmp_path}/in")
    at = [f"{tmp_path}/{x}" for x in ("root", "marks", "in")]
    assert rounds(spark, *at, batch=4) >= 4
    first = done(spark, at[0])
    order = sorted(range(14), key=lambda i: (i % 3, i))
    assert [m for _, m in sorted(first, key=lambda x: (x[0], x[1] % 3, x[1])) if m != 3] == [m for m in order if m != 3]
    assert {m for _, m in first} == set(range(14)) and max(r for r, _ in first) == 3
    spark.createDataFrame([(100 + i, 0) for i in range(5)], CAPTURES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    rounds(spark, *at, batch=4)  # goes on behind the last round, over a snapshot
    later = [x for x in done(spark, at[0]) if x not in first]
    assert sorted(m for _, m in later) == [100, 101, 102, 103, 104] and len({r for r, _ in later}) == 2


def test_a_round_reads_a_bounded_number_of_paths_and_repeats_itself(spark, tmp_path):
    root, keep = str(tmp_path / "log"), 3
    schema = spark.createDataFrame([], CAPTURES).schema
    left, seen = set(), 0
    for number in range(11):
        new = list(range(seen, seen + (5 if number < 6 else 0)))
        seen += len(new)
        spark.createDataFrame([(i, 0) for i in new], CAPTURES).coalesce(1).write.parquet(f"{root}/added/round={number}")
        left |= set(new)
        rows = queue.waiting(spark, schema, root, number, "message_id", keep)
        assert {r["message_id"] for r in rows.collect()} == left
        folders = {f.rsplit("/", 2)[-3] + f.rsplit("/", 2)[-2] for f in rows.inputFiles()}
        assert len(folders) <= 2 * keep + 1
        taken = sorted(left)[:3]
        for _ in range(2):  # a round that is repeated overwrites what it wrote
            spark.createDataFrame([(i,) for i in taken], "message_id long").write.mode("overwrite").parquet(f"{root}/done/round={number}")
            after = queue.waiting(spark, schema, root, number, "message_id", keep, with_done=True)
            assert {r["message_id"] for r in after.collect()} == left - set(taken)
            if number and number % keep == 0:
                after.write.mode("overwrite").parquet(f"{root}/waiting/round={number}")
        left -= set(taken)


def test_a_failing_round_is_repeated(spark, tmp_path):
    spark.createDataFrame([(i, 0) for i in range(6)], CAPTURES).coalesce(1).write.json(f"{tmp_path}/in")
    at, calls = [f"{tmp_path}/{x}" for x in ("root", "marks", "in")], []

    def process(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows.select("message_id")

    with pytest.raises(Exception, match="lost"):
        rounds(spark, *at, batch=2, process=process)
    rounds(spark, *at, batch=2, process=process)
    assert sorted(m for _, m in done(spark, at[0])) == list(range(6))


def test_photos_meet_texts_in_one_batch_or_many(spark, tmp_path):
    schema, r, at = "message_id long, chat_id long, ts timestamp, kind string, text string", random.Random(1), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(150):
        at += dt.timedelta(seconds=r.choice([1, 20, 200, 40_000]) if r.random() < 0.2 else r.randint(0, 60))
        rows.append((i, r.choice([1, 1, 1, 2]), at, r.choice(["photo", "photo", "text", "command", "captioned"]), "x"))
    rows += [(150, 1, None, "photo", "x"), (151, None, at, "photo", "x"), (152, None, at, "text", "x"), (153, 9, at + dt.timedelta(days=3), "text", "x")]
    shuffled = [x for k in range(0, len(rows), 3) for x in r.sample(rows[k : k + 3], len(rows[k : k + 3]))]
    key = "spark.sql.streaming.stateStore.providerClass"
    before, found = spark.conf.get(key), []
    spark.conf.set(key, images.ROCKSDB)
    try:
        for parts in (1, 4):
            for k in range(parts):
                spark.createDataFrame(shuffled[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{parts}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in{parts}")
            out = images.associate_images(stream, "6 hours", "2 days").writeStream.format("parquet").option("path", f"{tmp_path}/out{parts}").option("checkpointLocation", f"{tmp_path}/cp{parts}")
            out.trigger(availableNow=True).start().awaitTermination()
            found.append(sorted(map(tuple, spark.read.schema(images.FOUND).parquet(f"{tmp_path}/out{parts}").collect())))
    finally:
        spark.conf.set(key, before)
    want = []
    for i, chat, ts, kind, _ in rows[:150] + rows[151:]:
        if kind == "photo":
            later = min(((t, j) for j, c, t, k, _ in rows if c == chat and k in ("text", "captioned") and t and (t, j) > (ts, i)), default=None)
            want.append((i, chat, later[1] if later and later[0] - ts <= dt.timedelta(hours=6) else None))
    assert found[0] == found[1] == sorted(want)


class _Held:
    """State of one group in memory; counts how often it is read and written."""

    def __init__(self):
        self.maps, self.values, self.timers, self.calls = {}, {}, set(), 0

    def getMapState(self, name, *_):
        held, outer = self.maps.setdefault(name, {}), self

        class Map:
            def count(self, out):
                outer.calls += 1
                return out

            def getValue(self, k):
                return self.count(held.get(k))

            def containsKey(self, k):
                return self.count(k in held)

            def updateValue(self, k, v):
                self.count(held.__setitem__(k, v))

            def removeKey(self, k):
                self.count(held.pop(k))

            def keys(self):
                return self.count(iter(list(held)))

        return Map()

    def getValueState(self, name, *_):
        values = self.values

        class Value:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values.get(name))
            update = staticmethod(lambda v: values.__setitem__(name, v))
            clear = staticmethod(lambda: values.pop(name, None))

        return Value()

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _settled(rows, watermarks, wait_ms=3_600_000):
    """What comes out of a group whose rows (chat, ms, id, photo) come at once, while the watermark goes on; and its state."""
    handle, p = _Held(), images._NextText(wait_ms * 1000)
    p.init(handle)
    frame = pd.DataFrame(rows, columns=["chat_id", "ms", "message_id", "photo"]).assign(at=lambda f: (f.ms * 1000).round().astype("int64"))
    found = [f for k in range(0, len(frame), 500) for f in p.handleInputRows((1,), iter([frame[k : k + 500]]), _Now(0))]
    for ms in watermarks:
        fired = {t for t in handle.timers if t <= ms}
        handle.timers -= fired
        for _ in sorted(fired):
            found += list(p.handleExpiredTimer((1,), _Now(ms), None))
    return sorted((int(r.image_id), int(r.chat_id), None if pd.isna(r.text_id) else int(r.text_id)) for f in found for r in f.itertuples()), handle


def test_photos_read_state_by_the_hour_and_not_by_the_row():
    r, minute = random.Random(5), 60_000
    rows = [(r.randint(1, 40), r.randint(0, 300 * minute), i, r.randint(0, 1)) for i in range(5000)]
    want = []
    for chat, ms, i, photo in rows:
        if photo:
            later = min(((t, j) for c, t, j, p in rows if c == chat and not p and (t, j) > (ms, i)), default=None)
            want.append((i, chat, later[1] if later and later[0] - ms <= 20 * minute else None))
    once, handle = _settled(rows, [10**9], 20 * minute)
    assert once == sorted(want) and handle.calls < 500
    assert _settled(rows, range(0, 400 * minute, 7_777_777), 20 * minute)[0] == once
    assert _settled(rows, range(0, 400 * minute, 91_234), 20 * minute)[0] == once


def test_a_wait_that_ends_within_a_minute_is_not_cut_by_the_watermark():
    rows = [(1, 1000, 1, 1), (1, 3_600_900, 2, 0)]  # the text comes in time, in a minute that the watermark first only reaches
    assert _settled(rows, [3_601_500, 10**8])[0] == _settled(rows, [10**8])[0] == [(1, 1, 2)]


def test_times_within_a_millisecond_keep_their_order():
    assert _settled([(1, 5.002, 9, 1), (1, 5.003, 3, 0), (1, 5.001, 2, 0)], [10**8])[0] == [(9, 1, 3)]
