"""The html of main content: by hand, and what must hold for every page of the table."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import pages as P
from marginalia.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("html, container, main", [
    (None, "", ""), ("", "", ""), ("plain < text & more", "", "plain &lt; text &amp; more"),
    ("<body class=x><nav>menu</nav><p>Hello</body>", "body", '<body class="x"><p>Hello</p></body>'),
    ("<main>m</main><article id=a><h1>T</h1><p>x &amp; y &lt; z</p></article>", "article", '<article id="a"><h1>T</h1><p>x &amp; y &lt; z</p></article>'),
    ("<article>one</article><article>two</article>", "article", "<article>one</article>"),
    ("<header><article>gone</article></header><div role=main>kept</div>", '[role="main"]', '<div role="main">kept</div>'),
    ("<div class='post big'>p</div><div class='entry-content'>e</div>", ".entry-content", '<div class="entry-content">e</div>'),
    ("<div id=content>c<div class='ad top'>buy</div><div class=adorn>a</div></div>", "#content", '<div id="content">c<div class="adorn">a</div></div>'),
    ("<main>a<br>b<img src='x.png' alt='say \"hi\"'><script>if (a<b) {}</script><form>f</form></main>", "main", "<main>a<br/>b<img src=\"x.png\" alt='say \"hi\"'/></main>"),
    ("<main><p title='&quot;both&quot; &#39;kinds&#39;' hidden>t<!-- c --></p></main>", "main", '<main><p title="&quot;both&quot; \'kinds\'" hidden="">t</p></main>'),
    ("<div class=content><section id=comments>no</section><aside>no</aside>yes</div>", ".content", '<div class="content">yes</div>'),
])
def test_main_content_by_hand(html, container, main):
    assert P.main_content(html) == (container, main)


def test_deep_pages_are_no_recursion():
    depth = 50_000
    assert P.main_content("<main>" + "<b>" * depth + "x")[1] == "<main>" + "<b>" * depth + "x" + "</b>" * depth + "</main>"


def test_operator_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, "<main>a</main>"), (2, None), (3, ""), (4, "<![if x]>text"), (5, "<article>" + "x " * 100_000), (1, "<main>a</main>")], "page_id int, html string").withColumn("error", F.lit("mine"))
    got = sorted((r.page_id, r.container or "", len(r.main_html or "")) for r in P.page_main_content(rows).collect())
    assert [g[:2] for g in got] == [(1, "main"), (1, "main"), (2, ""), (3, ""), (4, ""), (5, "article")] and got[5][2] == 200_000 + len("<article></article>")
    assert P.page_main_content(rows.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    rows = QUERIES["page_main_content"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.error is None for r in rows)
    gone = re.compile(r"<(script|style|nav|header|footer|aside|noscript|iframe|form)[ >]")
    assert not any(gone.search(r.main_html) for r in rows)
    again = [P.main_content(r.main_html) for r in rows]
    assert again == [(r.container or "", r.main_html) for r in rows]
    assert sum(r.container is not None for r in rows) > len(rows) / 2


def test_titles_are_decoded_as_browsers_show_them(spark):
    pages = spark.createDataFrame([("<html><head><title> token = &quot;5a&quot; &amp;amp; &lt;b&gt; </title></head></html>", "https://a.b/")], "html string, url string")
    assert P.page_metadata(pages).first().title == 'token = "5a" &amp; <b>'
