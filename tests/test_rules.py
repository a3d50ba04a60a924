"""Cases of the quality gate, of image numbers, resuming, hub notes and rounds of the queue, as DataFrames."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import notes as W, text as T
from marginalia.operators import catalog as C, hosts as H, condense
from marginalia.operators.files import unique_names
from marginalia.operators.order import earlier_in_group, row_index
from marginalia.sources import files
from marginalia.streaming import queue

BODY = "I keep coming back to the same thought, and it *matters* to me."
GOOD = f"---\nsource: chat\ncaptured_at: 2026-06-12T12:00:00\nsurface: phone\ntags: [raw]\n---\n# A thought\n\n## Raw Capture\n{BODY}\n\n## Initial Interpretation\nA note on a thought.\n"
URL = "https://example.com/article"
CASES = [
    ("good", BODY, GOOD, "telegram", None),
    ("fenced", BODY, f"```markdown\n{GOOD}\n```", "telegram", None),
    ("entities on each line", BODY, "\n".join("&nbsp;" + x for x in GOOD.split("\n")), "telegram", "frontmatter"),
    ("entity inserted", BODY, GOOD.replace("keep", "&nbsp;keep"), "telegram", "corruption"),
    ("escaped tag", BODY, GOOD.replace("tags: [raw]", "tags: \\[raw]"), "telegram", "corruption"),
    ("escaped stars", BODY, GOOD.replace("*matters*", "\\*matters\\*"), "telegram", "corruption"),
    ("its own entity", "a &nbsp; b is all I said", GOOD.replace(BODY, "a &nbsp; b is all I said"), "telegram", None),
    ("no frontmatter", BODY, f"# Title\n\n## Raw Capture\n{BODY}\n", "telegram", "frontmatter"),
    ("rewritten", BODY, GOOD.replace(BODY, "The author keeps returning to one idea."), "telegram", "verbatim"),
    ("white space apart", BODY.replace(" ", "\n  "), GOOD, "telegram", None),
    ("empty body", "  \n ", GOOD, "image", None),
    ("null body", None, GOOD, "image", None),
    ("url alone", URL, GOOD.replace(BODY, "nothing of it"), "source", None),
    ("url and few letters", f"{URL} see", GOOD.replace(BODY, "nothing of it"), "pdf", None),
    ("reason of a link", f"{URL} {BODY}", GOOD.replace("## Raw Capture", "## Why This Was Captured"), "source", None),
    ("first section counts", f"{URL} {BODY}", GOOD.replace("## Raw Capture", "## Page Content\nother\n\n## Raw Capture"), "source", "verbatim"),
    ("document text", BODY, GOOD.replace("## Raw Capture", "## Extracted PDF Text"), "pdf", None),
    ("page content is no section of documents", BODY, GOOD.replace("## Raw Capture", "## Page Content"), "pdf", "verbatim"),
    ("no section", BODY, GOOD.replace("## Raw Capture", "## Other"), "telegram", "verbatim"),
]


def test_validator_cases_and_modes(spark):
    df = spark.createDataFrame([(i, b, m, k) for i, (_, b, m, k, _) in enumerate(CASES)], "doc_id int, body string, markdown string, kind string")
    strict = {r.doc_id: (r.ok, r.reason) for r in C.validate(df).collect()}
    lenient = {r.doc_id: (r.ok, r.reason) for r in C.validate(df, "lenient").collect()}
    off = {r.doc_id: (r.ok, r.reason) for r in C.validate(df, "off").collect()}
    for i, (name, *_, reason) in enumerate(CASES):
        assert strict[i] == (reason is None, reason), name
        assert lenient[i] == (True, reason) and off[i] == (True, None), name
    with pytest.raises(ValueError):
        C.validate(df, "loose")


def test_image_numbers(spark):
    at = lambda h: dt.datetime(2026, 6, 12, h)
    images = spark.createDataFrame([(1, at(9), "d1", ".jpg"), (2, at(8), "d1", ".jpg"), (3, at(8), "d1", ".png"), (4, at(8), "d2", ".jpg"), (5, at(9), "d1", ".jpg")], "message_id int, ts timestamp, day string, extension string")
    there = spark.createDataFrame([("d1", ".jpg", "image-007.jpg"), ("d1", ".jpg", "image-x.jpg"), ("d1", ".jpg", "cover.jpg"), ("d2", ".jpg", "image-1041.jpg"), ("d3", ".jpg", None)], "day string, extension string, name string")
    got = {r.message_id: r["name"] for r in C.number_images(images, there).collect()}
    assert got == {2: "image-008.jpg", 1: "image-009.jpg", 5: "image-010.jpg", 3: "image-001.png", 4: "image-1042.jpg"}
    assert C.number_images(images.limit(0), there).count() == 0


def test_any_edit_changes_the_mark_of_a_run(spark):
    rows = [(1, "a", "text"), (1, "b", "other"), (2, "a", None)]
    mark = lambda r: {x.run_id: x.mark for x in condense.corpus_mark(spark.createDataFrame(r, "run_id int, dimension string, content string")).collect()}
    base = mark(rows)
    assert mark(rows[::-1]) == base
    assert mark([(1, "a", "tex!"), *rows[1:]])[1] != base[1] and mark([*rows, rows[0]])[1] != base[1] and mark([(1, "b", "text"), (1, "a", "other"), rows[2]])[1] != base[1]


def test_hub_note(spark):
    text = spark.range(1).select(W.hub_stub(F.lit("Tide"), F.lit("2026-01-02").cast("date")).alias("t")).first().t
    assert text.startswith("---\ntype: hub\nstatus: empty\ncreated_at: 2026-01-02\n---\n\n# Tide\n\n## What This Hub Is\n")
    assert [x for x in text.split("\n") if x.startswith("## ")] == ["## What This Hub Is", "## What This Hub Is Not", "## Open Questions", "## Linked Notes"]


def test_rounds_of_the_queue(spark, tmp_path):
    """Rounds of three: urgent ones first, the rest later, nothing twice; new arrivals join in."""
    feed, root, marks = (str(tmp_path / x) for x in ("feed", "root", "marks"))
    kinds = "message_id long, priority int"

    def run():
        rows = spark.readStream.schema(kinds).parquet(feed)
        queue.drain(spark, queue.process_periodically(rows, root, marks, lambda q: q, 3).trigger(processingTime="1 second").start(), root, rows.schema, most_seconds=120)
        return sorted((r.round, r.message_id) for r in spark.read.schema(f"{kinds}, round int").parquet(f"{root}/done").collect())

    spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 1), (5, 3)], kinds).coalesce(1).write.parquet(feed)
    first = run()
    assert first == [(0, 1), (0, 2), (0, 4), (1, 3), (1, 5)]
    spark.createDataFrame([(6, 1)], kinds).coalesce(1).write.mode("append").parquet(feed)
    later = run()
    assert [m for _, m in later if (_, m) not in first] == [6] and len(later) == 6


def test_missing_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert files.exists(spark, str(tmp_path / "empty")) and not files.exists(spark, str(tmp_path / "none"))


def test_row_index_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (2, 3), (1, 4)], "k int, i int")
    got = row_index(df, "k", "i").collect()
    assert sorted((r.row_index, r.i) for r in got) == [(0, 1), (1, 4), (2, 2), (3, 3)] and {r.row_count for r in got} == {4}


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), ("    ", 0), ("one two  three\n", 3), ("x" * 200_000, 1)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(T.word_count(F.col("t")).alias("n")).first().n == n


def test_entry_without_what_the_subpackage_needs():
    """Where a library of the subpackage is missing, the other queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'parse_note' in q and 'op5_filter_urls' not in q and 'parse_note' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_hosts_like_the_standard_library(spark):
    """Public or not as the standard library's address rules have it, over edges of every block and random addresses."""
    rng = random.Random(5)
    wanted = {}
    blocks = [ipaddress.ip_network(x) for x in " ".join((H.CLOSED_4, H.OPEN_4, H.CLOSED_6, H.OPEN_6)).split()]
    for block in blocks:
        for at in (int(block[0]) - 1, int(block[0]), int(block[-1]), int(block[-1]) + 1):
            if 0 <= at < 2**block.max_prefixlen:
                a = type(block[0])(at)
                wanted[str(a)] = a
                if a.version == 6:
                    wanted[f"[{a.exploded.upper()}]"] = a
                else:
                    wanted[f"::ffff:{a}"] = a
    for _ in range(300):
        a = ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice((0, 3, 3, 16, 80)) | rng.choice((0, 1 << 125)))
        wanted[str(a)] = a
        b = ipaddress.IPv4Address(rng.getrandbits(32))
        wanted[str(b)] = b
    refused = lambda a: (a := getattr(a, "ipv4_mapped", None) or a) and (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)
    # the first is neither private nor global, the second a block for documentation that older libraries do not know: not public here
    more = [ipaddress.ip_network(x) for x in ("100.64.0.0/10", "3fff::/20")]
    expected = {h: bool(refused(a)) or any(a.version == x.version and a in x for x in more) for h, a in wanted.items()}
    df = H.judge_hosts(spark.createDataFrame([(h,) for h in wanted], "host string"), H.special_blocks(spark))
    assert {r.host: not r.public for r in df.collect()} == expected


def test_hosts_and_a_hundred_thousand_blocks(spark):
    """The longest prefix by trying every length, for random nested blocks of both kinds; no nested loops but over the few lengths."""
    rng, rows, of = random.Random(11), [], {}
    base = [rng.getrandbits(128) for _ in range(300)]
    for _ in range(100_000):
        bits = rng.randint(0, 128) if rng.random() < 0.9 else rng.randint(0, 24)
        net = ipaddress.IPv6Network((rng.choice(base) ^ rng.getrandbits(rng.randint(1, 128)), bits), strict=False)
        if rng.random() < 0.3:
            net = ipaddress.IPv4Network((rng.getrandbits(32), rng.randint(0, 32)), strict=False)
        closed = rng.random() < 0.5
        rows.append((str(net), closed))
        key = (net.prefixlen + (96 if net.version == 4 else 0), int(net[0]) + (0xFFFF << 32 if net.version == 4 else 0))
        of[key] = of.get(key, False) or closed
    blocks = spark.createDataFrame([*rows, ("nonsense", True), ("1.2.3.4/99", True), (None, True), ("::/0", None)], "cidr string, closed boolean")
    asked = [str(ipaddress.IPv6Address(rng.choice(base) ^ rng.getrandbits(rng.randint(1, 100)))) for _ in range(500)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(500)]
    asked += [x.split("/")[0] for x, _ in rows[:200]] + ["::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "0.0.0.0", "255.255.255.255"]

    def judged(host):
        a = ipaddress.ip_address(host)
        n = int(a) + (0xFFFF << 32 if a.version == 4 else 0)
        found = [of[k] for length in range(129) if (k := (length, n >> (128 - length) << (128 - length))) in of]
        return not (found and found[-1])

    got = H.judge_hosts(spark.createDataFrame([(h, "x") for h in [*asked, asked[0], None]], "host string, more string"), blocks)
    assert got.columns == ["host", "more", "public"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = [(r["host"], r["public"]) for r in got.collect()]
    assert len(found) == len(asked) + 2
    assert all(public is None if host is None else public == judged(host) for host, public in found)
    assert H.judge_hosts(spark.createDataFrame([], "host string"), blocks).count() == 0
    assert H.judge_hosts(spark.createDataFrame([("10.0.0.1",)], "host string"), blocks.limit(0)).first()["public"]


@pytest.mark.parametrize("host, closed", [("fe80::1%eth0", True), ("[::1]", True), ("1:2:3", True), ("1::2::3", True), ("2606:4700:::1", True), ("2606:4700::g", True), ("999.1.1.1", True), ("8.8.8.8", False), ("2606:4700::1", False), ("::ffff:8.8.8.8", False), ("a.localhost", True), ("localhost.example.org", False), ("", False), (None, None)])
def test_odd_hosts(spark, host, closed):
    public = H.judge_hosts(spark.createDataFrame([(host,)], "host string"), H.special_blocks(spark)).first()["public"]
    assert public is (None if closed is None else not closed)


def test_search_terms(spark):
    rows = [("b", "Red Fish"), ("a", "no"), ("c", None), ("red-hat", None), ("d", "red"), ("d", "red")]
    notes = spark.createDataFrame(rows, "stem string, raw_capture string")
    found = C.search_terms(notes, ["RED", "c", "RED", "%"], 3)
    assert sorted(map(tuple, found.collect())) == [("RED", 1, "b"), ("RED", 2, "d"), ("RED", 3, "d"), ("c", 1, "c")]
    assert C.search_terms(notes, []).count() == 0
    assert C.search_terms(notes.limit(0), ["a"]).count() == 0


def test_sums_in_groups_split_a_hot_group(spark):
    """Against a loop by hand: one group with most rows, null groups, null values, more rows than ranges."""
    rng = random.Random(9)
    rows = [(i, "hot" if i % 5 else rng.choice(["a", None, "b"]), rng.choice([None, 0, 3, 7])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, g string, v int")
    wanted, at = {}, {}
    for i, g, v in sorted(rows):
        wanted[i] = at.get(g, 0)
        at[g] = wanted[i] + (v or 0)
    found = earlier_in_group(df, F.col("v"), ["g"], "i")
    assert found.columns == ["i", "g", "v", "earlier"]
    assert {r.i: r.earlier for r in found.collect()} == wanted
    assert earlier_in_group(df.limit(0), F.col("v"), ["g"], "i").count() == 0


def test_unique_names_beyond_a_thousand(spark):
    rows = spark.range(1205).select("id", F.lit("f").alias("folder"), F.lit("a.b.pdf").alias("name"))
    names = {r.id: r.unique_name for r in unique_names(rows, "folder", "name", "id").collect()}
    assert names == {i: "a.b" + (f"-{i:03d}" if i else "") + ".pdf" for i in range(1205)}
