"""Folders, archives and runs on small fixtures; parts of notes at their edges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import archive as A, markup as W, routing as R
from marginalia.operators import files as O, runs
from marginalia.sources import files, sinks

NOTE = "---\ncaptured_at: 2024-03-04\ntags: [a]\n---\n# {}\n\n## Raw Capture\nbody\n"


@pytest.fixture()
def vault(tmp_path):
    for folder, name, text in [("notes", "2024-01-02--a.md", NOTE.format("A")), ("notes", "2024-01-03--b.md", "no front"), ("notes", "x.txt", "no"), ("reflections", "c.md", NOTE.format("C")), ("tweets", "77.md", "---\ntweet_id: 5\n---\nhi"),
                               ("tweets", "78.md", "bare"), ("hubs", "h.md", "---\nstatus: mature\n---\n[[2024-01-02--a|A]] [[Other]]"), ("images/2024", "p.JPG", "x"), ("images/2024", "p.txt", "x"), ("sources", "s.md", "s")]:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    return f"file:{tmp_path}"


def test_scan_content(spark, vault):
    found = files.scan_content(spark, vault)
    notes = {r.stem: r for r in found["notes"].collect()}
    assert str(notes["2024-01-02--a"].created_at)[:10] == "2024-03-04" and str(notes["2024-01-03--b"].created_at)[:10] == "2024-01-03"
    assert [r.source_type for r in found["reflections"].collect()] == ["reflection"]
    assert {(r.tweet_id, r.text) for r in found["tweets"].collect()} == {("5", "hi"), ("78", "bare")}
    assert [(r.title, r.status, r.linked_notes) for r in found["hubs"].collect()] == [("h", "mature", ["2024-01-02--a"])]
    assert [(r.format, r.size_bytes) for r in found["images"].collect()] == [("jpg", 1)]
    assert {r.folder for r in files.scan_vault(spark, vault).collect()} == {"notes", "reflections", "sources", "tweets"}
    assert "hubs" not in files.content_folders(vault, hubs="exclude") and files.scan_notes(spark, f"{vault}/gone").count() == 0


@pytest.mark.parametrize("name, head, tail", [("data/tweets.js", "window.YTD.tweets.part0 = ", ";\n"), ("tweet.js", "", "")])
def test_archive(spark, tmp_path, name, head, tail):
    post = {"id_str": "1", "full_text": "RT @x hi", "created_at": "Sat Oct 10 20:19:24 +0000 2020", "entities": {"hashtags": [{"text": "h"}]}}
    (tmp_path / name).parent.mkdir(exist_ok=True)
    (tmp_path / name).write_text(head + json.dumps([{"tweet": post}, {**post, "id_str": "2"}, {"tweet": {"id_str": "3"}}]) + tail)
    path = files.archive_file(spark, f"file:{tmp_path}")
    assert path.endswith(name)
    got = files.scan_archive(spark, path).orderBy("tweet_id").collect()
    assert [(r.tweet_id, r.is_retweet, r.hashtags, str(r.created_at)) for r in got] == [("1", True, ["h"], "2020-10-10 20:19:24"), ("2", True, ["h"], "2020-10-10 20:19:24")]
    assert files.archive_file(spark, f"file:{tmp_path}/gone") is None


def test_archive_in_byte_ranges(spark, tmp_path):
    """Split points in strings, escapes, braces inside texts and nested objects; equal to parsing each file as a whole."""
    r, posts = random.Random(6), []
    for i in range(300):
        text = "".join(r.choices(["a", "}", "{", '"', "\\", "[", "]", ",", "é", "\n", "中", "\\\"", " "], k=r.randint(1, 80)))
        posts.append({"id_str": str(i), "full_text": text, "entities": {"hashtags": [{"text": "h}"}] * r.randint(0, 3), "urls": []}, "created_at": "2020-10-10 20:19:24"})
    for k, indent in enumerate([None, 1]):
        half = [{"tweet": p} if i % 2 else p for i, p in enumerate(posts[k * 150 : k * 150 + 150])]
        (tmp_path / f"part{k}.js").write_text("window.YTD.tweets.part0 = " + json.dumps(half, indent=indent, ensure_ascii=bool(k)) + ";\n")
    (tmp_path / "empty.js").write_text("window.YTD.tweets.part9 = []")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "777")
        raw = spark.read.option("lineSep", "}").text(f"file:{tmp_path}/*.js")
        assert raw.rdd.getNumPartitions() > 50
        got = files.scan_archive(spark, f"file:{tmp_path}/*.js").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((x.tweet_id, x.text, x.hashtags) for x in got) == sorted((p["id_str"], p["full_text"], ["h}"] * len(p["entities"]["hashtags"])) for p in posts)
    elements = files.json_elements(spark, f"file:{tmp_path}/part1.js").orderBy("element").collect()
    assert [json.loads(e.json).get("id_str") or json.loads(e.json)["tweet"]["id_str"] for e in elements] == [p["id_str"] for p in posts[150:]]


def test_runs(spark, tmp_path):
    run = tmp_path / "2024-05"
    (run / "guidance").mkdir(parents=True)
    (run / "guidance" / "shadow-work.md").write_text("---\nconfidence: low\n---\n# Shadow\ntext")
    (run / "manifest.json").write_text('{"generated_at": "2024-06-01T00:00:00", "total_tokens": 3}')
    (run / "core-analysis").mkdir()
    for name in ("psychological-profile", "visual-patterns", "shadow-play"):
        (run / "core-analysis" / f"{name}.md").write_text("text")
    core = {d.title: (d.dimension, d.confidence, d.known) for d in files.scan_analysis_docs(spark, f"file:{run}", ("core-analysis",)).collect()}
    assert core == {"Psychological Profile": ("psychological", "medium", True), "Visual Patterns": ("visual", "medium", False), "Shadow Play": ("shadow_play", "medium", False)}
    docs = files.scan_analysis_docs(spark, f"file:{run}", ("guidance", "synthesis")).collect()
    assert [(d.phase, d.dimension, d.title, d.confidence, d.known) for d in docs] == [("guidance", "shadow_work", "Shadow", "low", True)]
    assert str(files.scan_manifest(spark, f"file:{run}").first().run_date)[:10] == "2024-05-01"
    sinks.write_phase_checkpoint(spark, f"{tmp_path}/runs", "r", "p", ["a"], ["b"], "m")
    assert spark.read.parquet(f"{tmp_path}/runs").first().pending == ["b"]
    images = spark.createDataFrame([(1, 2, "p", "t")], "message_id long, chat_id long, file_path string, captured_at string")
    sinks.append_pending_images(images, f"{tmp_path}/pending")
    assert spark.read.parquet(f"{tmp_path}/pending").first().status == "pending"
    sinks.write_category_summaries(spark.createDataFrame([("r", "c", "", "x")], "run_id string, category string, note string, content string"), f"{tmp_path}/sums")
    assert json.loads(spark.read.parquet(f"{tmp_path}/sums").first().frontmatter) == {"category": "c"}
    spark.createDataFrame([(1, "x")], "id long, body string").write.parquet(f"{tmp_path}/queue")
    assert files.scan_captures(spark, f"{tmp_path}/queue").first().image_paths is None
    spark.createDataFrame([("d", 1, "x")], "doc string, page_no int, page_text string").write.parquet(f"{tmp_path}/pages")
    assert files.scan_document_pages(spark, f"{tmp_path}/pages").count() == 1


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, found", [("![[a.png]] ![x](b/c.JPG)", ["a.png", "b/c.JPG"]), ("![[a.png|500]] [[b.png]]", ["a.png"]), ("", []), (None, [])])
def test_embeds(spark, text, found):
    assert one(spark, text, W.embeds) == found


@pytest.mark.parametrize("text, found", [("> [!insight]\n> - a\n> b\ntext", ["a", "b"]), ("> [!note]\n> a", []), ("", [])])
def test_callouts(spark, text, found):
    assert one(spark, text, W.callouts) == found


@pytest.mark.parametrize("text, day", [("2024-02-30", None), ("1-2-2024", "2024-02-01"), ("2024/2/1", "2024-02-01"), (None, None)])
def test_typed_day(spark, text, day):
    assert (lambda x: str(x) if x else None)(one(spark, text, A.typed_day)) == day


@pytest.mark.parametrize("text, said", [("PDF: a.pdf", R.NO_CONTEXT), ("PDF: a.pdf more", "more"), ("other", "other"), (None, R.NO_CONTEXT)])
def test_document_context(spark, text, said):
    assert one(spark, text, lambda t: R.document_context(t, F.lit("a.pdf"))) == said


def test_page_budget_keeps_the_crossing_page(spark):
    pages = spark.createDataFrame([("d", i, "x" * 40) for i in range(6)] + [("e", 0, None)], "doc string, page_no int, page_text string")
    got = O.page_budget(pages, 100, 100).where("doc = 'd'").orderBy("page_no").collect()
    assert [(r.page_no, r.is_last) for r in got] == [(0, False), (1, False), (2, True)]
    assert O.page_budget(pages, 2, 10_000).where("doc = 'd'").count() == 2


def test_costs_of_a_million_tokens(spark):
    got = {r.tier: r for r in runs.cost_rollup(spark.createDataFrame([("c", 1_000_000)], "k string, tokens long"), "k").collect()}
    assert got["high"].calls + got["low"].calls == 26 and got["high"].tokens_in == 1_000_000 + 2000 * 10 + 9 * 24_500
    assert got["low"].max_cost == pytest.approx((16 * 24_500 * 3 + 75_000 * 15) / 1e6)


def test_a_kept_document_is_processable_by_its_type_whatever_its_size(spark):
    rows = spark.createDataFrame([("/v/a.PDF", 21 * 1024 * 1024), ("/v/b.pdf", 1), ("/v/c.pdf", None), ("/v/d.txt", 1), ("/v/e", 1), (None, 1)], "path string, size long")
    assert [(r.name, r.extension, r.processable) for r in O.document_info(rows).orderBy(F.col("path").asc_nulls_last()).collect()] == [
        ("a.PDF", ".pdf", True), ("b.pdf", ".pdf", True), ("c.pdf", ".pdf", True), ("d.txt", ".txt", False), ("e", "", False), (None, None, False)]


def test_summaries_of_many_runs_are_few_files(spark, tmp_path):
    rows = spark.range(900).select((F.col("id") % 300).alias("run_id"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("category"), F.lit("").alias("note"), F.col("id").cast("string").alias("content"))
    for _ in range(2):
        sinks.write_category_summaries(rows.repartition(4), f"{tmp_path}/sums")
    kept = spark.read.schema("frontmatter string, content string, run_id long").parquet(f"{tmp_path}/sums")
    assert len(kept.inputFiles()) <= 8
    got = [tuple(r) for r in kept.select("run_id", F.get_json_object("frontmatter", "$.category"), "content").collect()]
    assert sorted(got) == sorted(2 * [(i % 300, f"c{i % 3}", str(i)) for i in range(900)])
    for part in kept.select(F.input_file_name().alias("f"), "run_id").groupBy("f").agg(F.collect_list("run_id").alias("ids")).collect():
        assert part.ids == sorted(part.ids)
