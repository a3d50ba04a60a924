"""The plan to resume a run, phase by phase, against a walk through the phases by hand."""

import random

from marginalia.operators import condense

PHASES = [(0, "core", "a"), (0, "core", "b"), (1, "pattern", "c"), (1, "pattern", "d"), (2, "synthesis", "e"), (3, "guidance", "f")]
SCHEMAS = {"phases": "position int, phase string, dimension string", "saved": "run_id string, dimension string, seq int, error string", "checkpoints": "run_id string, seq int, position int, mark string", "now": "run_id string, mark string"}


def plan(spark, saved, checkpoints, now):
    tables = [spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in (("phases", PHASES), ("saved", saved), ("checkpoints", checkpoints), ("now", now))]
    return sorted((r["run_id"], r["position"], r["action"], tuple(r["pending"])) for r in condense.resume_plan(*tables).collect())


def by_hand(saved, checkpoints, now):
    out = []
    for run, mark in now:
        last = max((c for c in checkpoints if c[0] == run), key=lambda c: c[1], default=None)
        same, resumed = bool(last) and last[3] == mark, False
        results = {}
        for r, dimension, _, error in sorted(saved, key=lambda x: x[2]):
            if r == run:
                results[dimension] = error
        for position in sorted({p for p, _, _ in PHASES}):
            dims = sorted(x for p, _, x in PHASES if p == position)
            left = [x for x in dims if not (same and (position <= last[2] or x in results and results[x] is None))]
            action = "restart" if not same else "done" if not left else "wait" if resumed else "resume"
            resumed = resumed or action == "resume"
            out.append((run, position, action, tuple(left)))
    return sorted(out)


def test_cases(spark):
    saved = [("mid", "c", 1, "lost"), ("mid", "c", 2, None), ("mid", "d", 1, None), ("mid", "d", 2, "lost"), ("mid", "f", 1, None), ("edited", "c", 1, None)]
    checkpoints = [("mid", 1, 0, "m"), ("mid", 0, 3, "m"), ("edited", 1, 2, "old"), ("all", 1, 3, "x")]
    now = [("mid", "m"), ("edited", "new"), ("all", "x"), ("none", "y")]
    got = {(run, position): (action, pending) for run, position, action, pending in plan(spark, saved, checkpoints, now)}
    assert [got["mid", i] for i in range(4)] == [("done", ()), ("resume", ("d",)), ("wait", ("e",)), ("done", ())]
    assert {got[run, i][0] for run in ("edited", "none") for i in range(4)} == {"restart"} and {got["all", i] for i in range(4)} == {("done", ())}


def test_random_runs(spark):
    r = random.Random(3)
    names = [f"r{i}" for i in range(40)]
    saved = [(r.choice(names), r.choice("abcdefz"), i, r.choice([None, None, "lost"])) for i in range(300)]
    checkpoints = [(r.choice(names), i, r.randint(-1, 3), r.choice("mn")) for i in range(60)]
    now = [(n, "m") for n in names]
    assert plan(spark, saved, checkpoints, now) == by_hand(saved, checkpoints, now)
    assert plan(spark, [], [], []) == []
