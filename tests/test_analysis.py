"""Pages, sinks and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import pages as P
from marginalia.operators import catalog as C, sampling
from marginalia.sources import sinks
from marginalia.streaming import captures, images


@pytest.mark.parametrize("html, want", [
    ("<html><body><h1>Hi</h1><p>Some body text.</p></body></html>", "# Hi\n\nSome body text."),
    ("<body><nav>no</nav><main><p>a <b>b</b> <a href='/x'>c</a></p><ul><li>d<li>e</ul></main><p>out</p></body>", "a **b** [c](/x)\n\n  * d\n  * e"),
    ("<div class='x ad'>no</div><article><p>1<div id=comments>no</div></article><article>2</article>", "1"),
    ("<p>plain &amp; simple", "plain & simple"), ("<div>" * 5000 + "deep", "deep"), ("", ""), (None, "")])
def test_markdown(spark, html, want):
    row = P.extract_pages(spark.createDataFrame([(1, html, None)], "page_id int, html string, url string")).first()
    assert (row.markdown_content, row.success) == (want, want != "")


def test_sample_without_rows(spark):
    none = spark.createDataFrame([], "stem string, created_at date, score double, token_estimate int")
    assert sampling.stratified_temporal_sample(none, 0.5).count() == sampling.sample_if_needed(none, 10).count() == 0


def test_sinks(spark, tmp_path):
    notes = spark.createDataFrame([("a", "notes", "2024-01-01", "x"), ("b", "inbox", "2024-01-02", None)], "stem string, folder string, capture_date string, content string")
    sinks.write_notes(notes, f"{tmp_path}/notes")
    assert {r.stem for r in spark.read.parquet(f"{tmp_path}/notes").where("folder = 'inbox'").collect()} == {"b"}
    pages = notes.select("stem", "capture_date", F.lit("<p>").alias("html"), F.lit(None).cast("string").alias("url"), F.lit("text").alias("markdown_content"))
    sinks.write_page_artifacts(pages, f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").first().extracted == "<!-- source: unknown -->\n\ntext"
    results = spark.createDataFrame([("r", "p", "d", "", "body")], "run_id string, phase string, dimension string, error string, content string")
    sinks.write_analysis_results(results, f"{tmp_path}/results")
    assert json.loads(spark.read.parquet(f"{tmp_path}/results").first().frontmatter) == {"dimension": "d"}
    checked = spark.createDataFrame([(1, None), (2, "empty")], "id int, reason string")
    assert [r.id for r in sinks.write_rejects(checked, f"{tmp_path}/rejects").collect()] == [1]
    assert spark.read.parquet(f"{tmp_path}/rejects").first().reason == "empty"
    sinks.write_manifest(notes.agg(F.count("*").alias("n")), f"{tmp_path}/manifest")
    assert spark.read.json(f"{tmp_path}/manifest").first().n == 2


def test_images_wait_for_the_next_text(spark, tmp_path):
    """Three runs over one checkpoint: what waits in one is found by a later one, nothing is read twice, and nothing comes out before
    the watermark has passed it."""
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()

    def put(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("message_id", "chat_id", "ts", "kind", "text"), r))) for r in rows))
        rows = images.associate_images(captures.stream_messages(spark, str(source)))
        captures.write_once(rows, out, f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
        return {(r.image_id, r.text_id) for r in spark.read.schema("image_id long, chat_id long, text_id long").parquet(out).collect()}

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, images.ROCKSDB)
    try:
        at = "2024-01-01T00:00:{:02d}Z"
        assert put("a.json", [(1, 7, at.format(1), "photo", None), (2, 7, at.format(2), "text", "x"), (3, 7, at.format(3), "photo", None), (4, 8, at.format(4), "photo", None)]) == set()
        assert put("b.json", [(5, 7, at.format(5), "command", "/x"), (6, 7, at.format(6), "captioned", "y"), (7, 9, at.format(7), "text", "z"), (9, 9, "2024-01-01T01:00:00Z", "photo", None)]) == {(1, 2), (3, 6)}
        assert put("c.json", [(8, 9, "2024-03-01T00:00:00Z", "text", "later")]) == {(1, 2), (3, 6), (4, None), (9, None)}
    finally:
        spark.conf.set(key, before)


def test_messages_come_once(spark, tmp_path):
    rows = [{"message_id": i % 3, "chat_id": 1, "ts": f"2024-01-01T00:00:0{i}Z", "kind": "text", "text": ["Mood: x", "idea: y", "  "][i % 3]} for i in range(6)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    made = captures.ingest(captures.dedup_messages(captures.stream_messages(spark, f"{tmp_path}/*.json")))
    captures.write_once(made, f"{tmp_path}/out", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.message_id, r.type, r.mood, r.body, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "Thought", "x", "", "empty"), (1, "Idea", None, "y", None), (2, "Thought", None, "", "empty")]


def test_next_text_of_a_hot_chat(spark):
    """One chat holds most messages and spans many ranges; photos wait across ranges; null chats and times count too."""
    kinds = ["photo", "command", "photo", "document", "photo"]
    rows = [(1, i // 3, i, "text" if i % 97 == 0 else "captioned" if i % 89 == 0 else kinds[i % 5]) for i in range(1500)]
    rows += [(None, 5, 2000, "photo"), (None, 5, 2001, "text"), (2, None, 2002, "photo"), (2, 1, 2003, "text"), (3, 1, 2004, "text"), (3, 2, 2005, "photo")]
    found = C.next_text(spark.createDataFrame(rows, "chat_id int, ts int, message_id int, kind string"))
    place = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = set()
    for r in rows:
        if r[3] == "photo":
            texts = sorted((place(x), x[2]) for x in rows if x[0] == r[0] and x[3] in ("text", "captioned") and place(x) > place(r))
            want.add((r[2], r[0], texts[0][1] if texts else None))
    assert found.columns == ["image_id", "chat_id", "text_id"]
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want) and set(got) == want
