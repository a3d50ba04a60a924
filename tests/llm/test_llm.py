"""Operators against brute force on small and awkward inputs."""

import hashlib
import math
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import chat, components, fingerprints, html_extract, langid, minhash, mixing, packing, sharding, urls, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long, before string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, ties, repeated rows, a clashing column name, a hot source and near copies."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(60)]
    texts += [texts[0]] * 5 + [texts[1] + " tail"] + ["", None, "A b\tC", "a b c", "one", "é ﬁ", "É FI", "x" * 5000]
    rows = [(i, t, ["en", "fr", None][i % 3], "hot" if i % 2 else ["s1", "s2", None][i % 3], len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_plan_covers_and_fits():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([5, 16, 100])
        counts = {s: r.randint(1, 9) for s in r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 12)))}
        fixed, rest = packing.dominance_reduction(counts, capacity)
        bins = [b for many, b in [*fixed, *packing.best_fit(rest, capacity)] for _ in range(many)]
        assert all(sum(b) <= capacity for b in bins)
        used = defaultdict(int)
        for b in bins:
            for s in b:
                used[s] += 1
        assert used == counts
        assert len(bins) <= 11 / 9 * -(-sum(s * c for s, c in counts.items()) // capacity) + counts_over_half(counts, capacity) + 1


def counts_over_half(counts, capacity):
    return sum(c for s, c in counts.items() if 2 * s > capacity)


def exact_bins(items, capacity):
    """The fewest bins, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best[0]


def test_dominance_never_costs_a_bin():
    r = random.Random(2)
    for _ in range(150):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        counts = {s: items.count(s) for s in items}
        fixed, rest = packing.dominance_reduction(counts, 20)
        left = [s for s, c in rest.items() for _ in range(c)]
        assert sum(m for m, _ in fixed) + exact_bins(left, 20) == exact_bins(items, 20)


def test_middling_sizes_are_fixed_together():
    """Three in a bin each, none small: the plan goes by the number of sizes, not of pieces."""
    r = random.Random(4)
    counts = {s: r.randint(2000, 3000) for s in range(550, 681)}
    fixed, rest = packing.dominance_reduction(counts, 2048)
    used = defaultdict(int, rest)
    for many, b in fixed:
        assert sum(b) <= 2048
        for s in b:
            used[s] += many
    assert used == counts and len(fixed) <= 2 * len(counts)
    assert sum(map(len, packing.plan(counts, 2048).values())) <= 6 * len(counts)


def test_packing_round_trip(spark, docs, empty):
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed_digest(docs, max_tokens=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in docs.collect():
        want = np.array([*ids.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for i, p in enumerate(sorted(by_doc[d.doc_id], key=lambda r: r.piece)):
            assert (p.piece, p.start) == (i, at) and (i == 0 or p.length == 64)
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert packing.packed_digest(empty).count() == 0


def test_packing_of_special_strings_and_other_ids(spark):
    """Added tokens of the vocabulary are one id, as the json file has it; ids of any type; clashing names stay."""
    text = "a <|endoftext|> b"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert want == [64, 220, 50256, 275] and packing.encoder()(text) == want
    for kind in ("int", "string", "decimal(20,0)", "date"):
        df = spark.sql(f"select cast({'date(18000)' if kind == 'date' else '7'} as {kind}) as doc_id, '{text}' as text" if kind != "date" else f"select date'2020-01-01' as doc_id, '{text}' as text")
        row = packing.packed_digest(df).collect()
        assert len(row) == 1 and row[0].length == 5 and row[0].ids_crc32 == zlib.crc32(np.array([*want, 0], "<u4").tobytes())
    pieces = spark.createDataFrame([(i, 0, 1 + i % 7, "x", "y") for i in range(40)], "doc_id int, piece int, length long, before string, _bucket string").selectExpr("*", "'z' as _value", "'w' as _at", "'v' as _start")
    packed = packing.pack(pieces, 16)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and {tuple(r[3:8]) for r in packed.collect()} == {("x", "y", "z", "w", "v")}


def test_a_million_equal_triples():
    counts = {s: 1_000_000 for s in (680, 682, 686)}
    assert len(packing.plan(counts, 2048)[680]) <= 3 and packing.dominance_reduction(counts, 2048)[1] == {}


def test_chat_ids_of_any_type(spark):
    for kind in ("int", "string", "decimal(20,0)"):
        df = spark.createDataFrame([("5", 0, "user", "x"), ("5", 1, "assistant", "y <|endoftext|>"), (None, 0, "user", None)], "c string, turn int, role string, text string").selectExpr(f"cast(c as {kind}) as conv_id", "turn", "role", "text", "'a' as shown", "'b' as tokens")
        back = chat.read_back(chat.format_conversations(df)).collect()
        assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in back) == [("5", 2, 15), ("None", 1, 0)]


def test_one_very_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} " * (1 + i % 5)) for i in range(3000)] + [(1, 3000, "assistant", "long " * 50_000)]
    back = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))).collect()
    assert back[0].n_turns == 3001 and back[0].loss_chars == sum(len(x[3]) for x in rows if x[2] == "assistant")
    assert back[0].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()


def test_long_piece_takes_the_other_encoder():
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("ab" * 3000, "x " + " " * 2500 + "y"):
        assert packing.encoder()(text) == want.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\s><\\\\s>", "<|im_end|>\n<|im_start|>user\n", "<<s>>[[INST]]"])
def test_escape_round_trip(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text


def test_chat_windows(spark):
    r = random.Random(5)
    rows = [(1, 0, "system", "be </s> kind")] + [(1, i, ["user", "assistant"][i % 2 == 0], "word " * r.randint(1, 60)) for i in range(1, 40)]
    rows += [(2, 0, "assistant", None), (2, 1, None, "<|im_end|>"), (2, 1, None, "<|im_end|>"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df, chat.Budget(tokens=120, history_turns=3, history_tokens=80))
    made = formatted.where("conv_id = 1").orderBy("window").collect()
    assert len(made) > 3 and all("be <\\/s> kind" in w.formatted for w in made)
    assert sum(w.n_new for w in made) == 40 and all(w.n_tokens <= 120 or w.n_new == 1 for w in made)
    back = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    for conv in (1, 2, None):
        mine = [x for x in rows if x[0] == conv]
        assert back[conv].n_turns == len(mine)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        learnt = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert (back[conv].loss_chars, back[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def fair_queue(rows, plan):
    """The stream of all turns by virtual finish time, cut at the budget: words taken of each row."""
    turns = sorted(((r.before + r.size + e * r.source_size) / r.target, r.source or "", e, i) for i, r in enumerate(plan) for e in range(3) if r.size)
    left, taken = sum(r.size for r in plan), [0] * len(plan)
    for *_, i in turns:
        taken[i] += min(left, plan[i].size)
        left -= min(left, plan[i].size)
    return taken


def test_mixing(spark, docs, empty):
    named = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"))
    plan = mixing.mix_plan(docs).join(named, "doc_id").collect()
    assert len(plan) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in plan)
    assert fair_queue(docs, plan) == [r.taken for r in plan] and sum(r.taken for r in plan) == sum(r.size for r in plan)
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        per[(r.target, r.source_size)][0] += r.taken
    longest = max(r.size for r in plan)
    assert all(abs(taken - target) <= len(per) * longest and target <= 3 * size + 1e-6 for (target, size), (taken, *_) in per.items())
    assert abs(sum(t for t, _ in per) - sum(r.size for r in plan)) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert n == sum(r.taken for r in plan)
    again = lambda: sorted(map(str, mixing.mix_plan(docs.repartition(5)).select("doc_id", "taken").collect()))
    assert again() == again()
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_keeps_repeated_rows_apart(spark):
    """Equal id and text in two sources, repeated rows, columns of internal names: every word stays with its source."""
    rows = [(1, "a b c d", "x", "own"), (1, "a b c d", "y", "own"), (2, "e f", "x", "own"), (2, "e f", "x", "own"), (3, None, None, "own"), (4, "g h i j k l", None, "own")]
    names = "doc_id long, text string, source string, size string"
    df = spark.createDataFrame(rows, names).selectExpr("*", "'t' as t", "'at' as at", "'_id' as _id", "'row' as row", "'_row' as _row", "'_turn' as _TURN", "'before' as before", "'words' as words", "'x' as `a.b`")
    plan = mixing.mix_plan(df).collect()
    mixed = mixing.mix(df).collect()
    want = defaultdict(int)
    for r in plan:
        want[r.source_size, r.target] += r.taken
    got = defaultdict(int)
    for r in mixed:
        got[r.source] += len(r.text.split())
        assert (r["size"], r["t"], r["at"], r["_id"], r["row"], r["_row"], r["_TURN"], r["before"], r["words"], r["a.b"]) == ("own", "t", "at", "_id", "row", "_row", "_turn", "before", "words", "x")
    assert sorted(got.values()) == sorted(v for v in want.values() if v)


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 64))
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(np.concatenate([base, base[:20] + 0.1 * r.standard_normal((20, 64)), base[:3]]))]
    rows += [(100, None, 1), (101, [0.0] * 64, 1), (102, [float("nan")] * 64, 1), (103, rows[0][1], None), (104, [1.0, None], 0), (105, [2.0, 1.0], 0), (106, [4.0, 2.0], 0)]
    got = {x.vec_id: x for x in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [x for x in rows if x[1] and x[2] is not None and None not in x[1] and np.isfinite(x[1]).all() and np.any(x[1])]
    near = defaultdict(set)
    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98:
                near[a[0]].add(b[0])
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near[i]), min(seen), i == min(seen))


def test_grid_prunes_and_loses_nothing():
    """Against all pairs of a block: the same pairs, few comparisons, fewer of them in larger sets."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    labels, found = np.array(table["label"].to_pylist()), {}
    compared = pairs = 0
    for lb in sorted(set(labels.tolist())):
        v = np.array([x for x, y in zip(table["embedding"].to_pylist(), labels) if y == lb], float) @ vectors.rotation(64)
        for k in range(8):
            part = v[:, 8 * k : 8 * k + 8]
            i, j, n = vectors.grid_pairs(part, None, vectors.block_room(64, 8, 0.98))
            d = ((part[:, None] - part[None]) ** 2).sum(2) <= vectors.block_room(64, 8, 0.98)
            assert {(min(a, b), max(a, b)) for a, b in zip(i, j)} == {(a, b) for a, b in zip(*np.nonzero(np.triu(d, 1)))} and len(i) == np.triu(d, 1).sum()
            compared += n
        pairs += len(v) * (len(v) - 1) // 2
    assert compared < 0.1 * pairs
    r = np.random.default_rng(2)
    p, q = r.standard_normal((700, 8)) / 8, r.standard_normal((500, 8)) / 8
    i, j, _ = vectors.grid_pairs(p, q, 0.02)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(((p[:, None] - q[None]) ** 2).sum(2) <= 0.02)))


@pytest.mark.parametrize("group", [7, 40, 20_000])
def test_vectors_in_cells_and_chunks(spark, group):
    """Labels larger than a group: coarse cells, visitors and chunks of a crowded cell lose no link."""
    r = np.random.default_rng(4)
    base = r.standard_normal((150, 12))
    near = np.concatenate([base, base[:60] + 0.04 * r.standard_normal((60, 12)), base[0] + 0.02 * r.standard_normal((60, 12))])
    rows = [(i, [float(x) for x in v], "hot" if i % 3 else "b") for i, v in enumerate(near)] + [(0, [float(x) for x in near[1]], "hot"), (None, [1.0] * 12, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as key", "2 as cid", "3 as n")
    got = vectors.link_vectors(df, block=5, group=group).collect()
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    c = unit @ unit.T >= 0.98
    label = np.array([x[2] for x in rows[: len(near)]])
    c &= label[:, None] == label[None]
    n = c.sum(1) - 1 + c[:, 1] * (label == "hot")
    assert {(x.vec_id, x.n_links) for x in got if x.vec_id not in (0, None)} == {(i, int(m)) for i, m in enumerate(n) if i}
    assert len(got) == len(rows) and vectors.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("url, verdict", [("http://a.casino-win.net/x", "block"), ("http://casinos.net/", "allow"), ("http://free.bets.net", "block"), ("http://free-free.net", "allow"), (None, "allow"), ("x", "allow")])
def test_url_vocabulary(url, verdict):
    assert urls.vocabulary_verdict(url, urls.automaton(urls.TERMS)) == verdict


def test_url_rules(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/en/12?q=1"), (2, "https://x.com/de/casino"), (3, "https://x.com/fr/casino"), (4, "https://x.org"), (5, None), (6, "casino")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("sub.example.org", "/en/12", "example.org/en/1", "block"), 2: ("x.com", "/de/casino", "com/de/", "block"), 3: ("x.com", "/fr/casino", "com/fr/", "allow"), 4: ("x.org", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "block")}


def test_html():
    article = "It is the first of the many things that we have to say about this, and it is not the last of them. " * 3
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>{article}</p></div><article><h1>A &amp; B</h1><p>{article}<script>var a = "</p>";</script><p>Er.</article>
    <aside><p>{article}</p></aside><section id=comments><p>{article}</p></section><form><p>{article}</p></form><footer>&copy; x</footer></body></html>"""
    assert html_extract.main_text(page) == f"A & B\n\n{article.strip()}\n\nEr."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""


HTML_TEXT = "The road to the village was long and it was not easy to walk in the rain, but they were all there at the end of the day. " * 2


@pytest.mark.parametrize("page", [
    '<body style="overflow-x:hidden"><p>{}</p></body>', '<div title="the hidden road"><p>{}</p></div>', '<div data-hidden="false" data-role="navigation"><p>{}</p></div>', '<div id="text" data-id="sidebar"><p>{}</p></div>',
    "<div title='a class=\"ad\" b'><p>{}</p></div>", '<main role="form" hidden class="sidebar"><p>{}</p></main>', '<body aria-hidden="true"><p>{}</p></body>', '<div class="page has-sidebar"><p>{}</p></div>', '<div class="content-with-sidebar no-header"><article><p>{}</p></article></div>',
    '<div class="sidebar-left"><div class="header"><article><p>{}</p></article></div></div>', '<div class="menu"><div role=main><p>{}</p></div></div><article class="card"></article>', '<DIV DATA-X=1 CLASS=text><p>{}</p></DIV>',
])
def test_html_keeps_what_only_looks_marked(page):
    assert html_extract.main_text(page.format(HTML_TEXT)) == HTML_TEXT.strip()


@pytest.mark.parametrize("page", [
    "<div hidden><p>{}</p></div>", "<div hidden=''><article><p>{}</p></article></div>", '<div data-x="y"class="ad"><p>{}</p></div>', "<div aria-hidden = true><p>{}</p></div>", '<div role="navigation" role="none"><p>{}</p></div>', "<div class='page sidebar'><p>{}</p></div>",
    "<div id=comments><article class=depth-1><p>{}</p></article></div>", "<div class=sidebar><article class=card><p>{}</p></article></div><article>One.</article>", "<div class=sidebar><article class=comment-body><p>{}</p></article></div>", "<nav class=menu><article><p>{}</p></article></nav>",
])
def test_html_drops_what_is_marked(page):
    assert HTML_TEXT.strip() not in html_extract.main_text(page.format(HTML_TEXT))


@pytest.mark.parametrize("names", ["container with-sidebar", "post-content no-comments", "layout has-menu", "article-body share-enabled", "post comments-open"])
@pytest.mark.parametrize("frame", ["<div class='{}'><article><p>{}</p></article></div>", "<div class='{}'><p>{}</p></div>"])
def test_html_container_of_the_article_stays(names, frame):
    assert html_extract.main_text(frame.format(names, HTML_TEXT)) == HTML_TEXT.strip()


def test_html_drops_nothing_else_of_the_article():
    page = f"""<p><a href=x>a link list outside</a></p><article><h1>T</h1><p class=by>By X</p><p>{HTML_TEXT}</p><p>See <a href=a>one long link text</a> and <a href=b>another long link text</a>.</p>
    <ul><li><a href=c>first</a></li><li><a href=d>second</a></li></ul><pre>x = 1\ny = 2</pre><p>Fin.</p></article><p>{HTML_TEXT}</p>"""
    text = HTML_TEXT.strip()
    assert html_extract.main_text(page) == "\n\n".join(["T", "By X", text, "See one long link text and another long link text.", "first", "second", "x = 1 y = 2", "Fin."])


def test_html_without_an_article_goes_by_blocks():
    """Dense running text is good, links and sparse text bad, short blocks as their nearest decided neighbour."""
    sparse = "Buy Acme Turbo 3000 now, limited edition, free shipping, best price, order today, click here, Acme Turbo 3000, best price."
    page = f"<div><a href=x>Home</a></div><div>Menu</div><h2>Near</h2><p>{HTML_TEXT}</p><h2>Between</h2><p>{HTML_TEXT}</p><p>{sparse}</p><p>tail</p>"
    text = HTML_TEXT.strip()
    assert html_extract.main_text(page) == "\n\n".join(["Near", text, "Between", text])


class Independent(HTMLParser):
    """Another reading of a page: text of blocks outside the named elements, by the standard library's parser."""

    def __init__(self, skip):
        super().__init__(convert_charrefs=True)
        self.skip, self.deep, self.out = skip, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.deep += tag in self.skip
        self.out += [""] if tag in html_extract.BLOCK else []
        self.out[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.deep -= tag in self.skip
        self.out += [""] if tag in html_extract.BLOCK else []

    def handle_data(self, data):
        self.out[-1] += "" if self.deep else data


@pytest.mark.parametrize("layout", [
    "<header><h2>Site</h2></header><nav><a href=/>x</a></nav><article>{}</article><footer>f</footer>", "<body><nav>n</nav><main><article>{}</article></main><aside>{}</aside></body>",
    "<div class=wrap><div id=content><article>{}</article></div></div><form>{}</form>", "<table><tr><td><nav>n</nav></td><td><article>{}</article></td></tr></table>",
])
def test_html_equals_an_independent_parser(layout):
    r = random.Random(layout)
    for _ in range(20):
        inner = "".join(r.choice([f"<p>{HTML_TEXT}</p>", "<h2>A &amp; B &lt;3 &#233;</h2>", "<ul><li>one</li><li>two <b>bold</b></li></ul>", "<p>short<br>line</p>", "<blockquote>said  it\n\tso</blockquote>", "<pre>a\n b</pre>", "<!-- no --><p>x</p>"]) for _ in range(r.randint(1, 8)))
        page = layout.replace("{}", f"<h1>Title</h1><p>{HTML_TEXT}</p>" + inner)
        other = Independent({"header", "nav", "footer", "aside", "form"})
        other.feed(page)
        assert html_extract.main_text(page) == "\n\n".join(t for x in other.out if (t := " ".join(x.split())))


@pytest.mark.parametrize("junk", ["<a ", "<![CDATA[", "<!--", "<a '>' ", "<a href=\"x'", "<div>", "</i><b>", "<li>", "<ul><li><div>", "<div class=ad><article>", "<script ", "<textarea></textarea ", "&#", "&#99999999999", "<", "<x y='"])
def test_html_broken_markup_takes_linear_time(junk):
    began = time.process_time()
    html_extract.main_text(f"<p>{HTML_TEXT}</p>" + junk * (1_000_000 // len(junk)))
    assert time.process_time() - began < 8


def test_html_through_spark(spark):
    long = "<article>" + f"<p>{HTML_TEXT}</p>" * 20_000 + "</article>"
    rows = [(1, None, "t", 5), (2, "", "t", 5), (3, f"<article><p>{HTML_TEXT}</p></article>", "t", 5), (3, f"<article><p>{HTML_TEXT}</p></article>", "t", 5), (4, long, "t", 5), (5, "no tags at all", "t", 5), (6, "&#" + "9" * 6000 + "; &#x41; <b", None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long").selectExpr("*", "'u' as url", "'l' as label")
    got = html_extract.extract(df)
    assert sorted(got.columns) == sorted(df.columns)
    by_id = {r.page_id: r for r in got.collect()}
    assert got.count() == 7 and (by_id[1].text, by_id[2].text, by_id[1].n_chars) == ("", "", 0)
    assert by_id[3].text == HTML_TEXT.strip() and by_id[4].text == "\n\n".join([HTML_TEXT.strip()] * 20_000) and by_id[4].n_chars == len(by_id[4].text)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_sharding(spark, docs, empty):
    rows = sharding.shard_manifest(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    many = spark.range(20000).withColumnRenamed("id", "doc_id")
    sizes = [r["count"] for r in sharding.assign_shards(many, sharding.tree(16)).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and min(sizes) > 1050 and max(sizes) < 1450
    assert sharding.shard_manifest(empty).count() == 0


def spark_xxhash64(*values):
    """Spark's chained xxhash64 of strings, ints and longs."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack(f"<{kind}", v), h)
    return h


def tree_shard(doc_id, leaves):
    """The tree descended by hand: at each level the child of the smallest exponential draw."""
    for level in ("region", "rack", "shard"):
        weights = defaultdict(int)
        for x in leaves:
            weights[getattr(x, level)] += x.weight
        weights = {k: w for k, w in weights.items() if w}

        def draw(child):
            return -math.log(((spark_xxhash64(("s", level), ("i", child), ("q", doc_id)) >> 11) + 0.5) / 2**53) / weights[child]

        pick = min(weights, key=draw)
        leaves = [x for x in leaves if getattr(x, level) == pick]
    return pick


def test_sharding_against_the_tree_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "é", "long " * 50_000, *["t"] * 300])] + [(5, "t"), (5, "other"), (2**62, "x")]
    got = sharding.shard_manifest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), tree_shard(i, sharding.tree(16)), tree_shard(i, sharding.tree(17))) for i, t in rows]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(want)
    assert sharding.assign_shards(spark.createDataFrame([(None, 3)], "doc_id long, shard int"), sharding.tree(16)).first().shard in range(16)


def test_sharding_moves_only_below_changed_weights(spark):
    many = spark.range(6000).withColumnRenamed("id", "doc_id")
    base = list(sharding.tree(16))
    before = {r.doc_id: r.shard for r in sharding.assign_shards(many, base).collect()}
    heavier = [x._replace(weight=3) if x.shard == 5 else x for x in base]
    after = {r.doc_id: r.shard for r in sharding.assign_shards(many, heavier).collect()}
    region, rack = base[5].region, base[5].rack
    for i, was in before.items():
        now = after[i]
        if now != was:  # into shard 5, or into its rack or region, whose weights grew with it
            assert base[now].region == region and (base[was].region != region or base[now].rack == rack and (base[was].rack != rack or now == 5))
    assert sum(v == 5 for v in after.values()) > 2 * sum(v == 5 for v in before.values())
    gone = {r.doc_id: r.shard for r in sharding.assign_shards(many, [x._replace(weight=0) if x.shard == 5 else x for x in base]).collect()}
    assert 5 not in gone.values()


def test_write_shards(spark, tmp_path):
    many = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    sharding.write_shards(many, sharding.tree(16), str(tmp_path / "shards"), files=2)
    back = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "shards")).collect()}
    assert back == {r.doc_id: r.shard for r in sharding.assign_shards(many, sharding.tree(16)).collect()}


def test_language(spark, empty):
    r = random.Random(1)
    words = {"en": ["the", "of", "shore", "thing"], "fr": ["le", "de", "eau", "éreux"]}
    rows = [(i, " ".join(r.choices(words[k := ["en", "fr"][i % 2]], k=20)), k) for i in range(200)] + [(900, None, "en"), (901, "12 !!", "en"), (902, "thingshore", None)]
    got = {x.doc_id: x for x in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200]) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en" and all(0 <= x.score <= 1 for x in got.values())
    assert langid.identify_documents(empty).count() == 0


def backoff_by_hand(learnt, text, longest=4):
    """(best language, its share) from raw counts; words first, unseen ones by their longest known n-grams."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    count = {n: defaultdict(lambda: defaultdict(int)) for n in range(longest + 1)}
    for t, lg in learnt:
        for w in words(t):
            count[0][w][lg] += 1
            for n in range(1, longest + 1):
                p = f"^{w}$"
                for i in range(len(p) - n + 1):
                    count[n][p[i : i + n]][lg] += 1
    langs = sorted({lg for _, lg in learnt})
    total = {n: {lg: sum(c[lg] for c in count[n].values()) for lg in langs} for n in count}
    log = lambda n, s: np.array([math.log((count[n][s][lg] + 0.5) / (total[n][lg] + 0.5 * len(count[n]))) for lg in langs])
    score = np.zeros(len(langs))
    for w in words(text):
        if w in count[0]:
            score += log(0, w)
            continue
        for n in range(longest, 0, -1):
            p = f"^{w}$"
            known = [g for i in range(len(p) - n + 1) if (g := p[i : i + n]) in count[n]]
            if known:
                score += np.mean([log(n, g) for g in known], axis=0)
                break
    share = np.exp(score - score.max())
    return langs[int(score.argmax())], float(share.max() / share.sum())


def test_language_against_counts_by_hand(spark):
    r = random.Random(9)
    stems = {"en": ["the", "thing", "of", "over"], "de": ["der", "ding", "über", "von"], "sv": ["det", "ting", "över", "av"]}
    rows = [(i, " ".join(r.choice(stems[lg]) + r.choice(["", "s", "en", "x1y"]) for _ in range(r.randint(1, 6))), lg) for i in range(240) for lg in [r.choice(["en", "de", "sv"])]]
    rows += [(1000, "zzz qqq", None), (1001, "thex dingen överen", None), (1002, "the " * 60_000 + "der", None), (1001, "thex dingen överen", None), (1003, "ﬁ ½ x", None), (1004, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as _p", "2 as _found", "3 as score", "4 as n", "5 as s")
    got = langid.identify_documents(df).collect()
    assert len(got) == len(rows) and all((x._p, x._found, x.n, x.s) == (1, 2, 4, 5) for x in got)
    learnt = [(t, lg) for i, t, lg in rows if lg and zlib.crc32(str(i).encode()) % 3 != 1]
    for x in got:
        lang, share = backoff_by_hand(learnt, x.text) if re.search(r"[^\W\d_]", x.text) else ("und", 0.0)
        assert abs(x.score - share) < 1e-3 and (x.lang_pred == lang or abs(share - 0.5) < 1e-3), x.text[:50]


def test_language_ties_and_samples(spark):
    """Equal evidence goes to the first language; a share of one in a million still draws."""
    rows = [(i, "same words", lg) for i in range(30) for lg in ("b", "a")]
    got = langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {x.lang_pred for x in got} == {"a"}
    many = spark.range(200_000).selectExpr("id as doc_id", "'w' as text", "'x' as lang")
    n = langid.counts(many, langid.Limits(docs=400, longest=1)).where("n = 0").first().c
    assert 300 < n < 500


def test_near_duplicates(spark, docs, empty):
    rows = docs.collect()

    def shingles(t, k):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(urls.ASCII_LOWER))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = {r.doc_id: shingles(r.text, 2) for r in rows}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 80:
                x, y = sorted((parent[a], parent[b]))
                parent = {i: x if p == y else p for i, p in parent.items()}
    got = minhash.near_duplicates(docs, minhash.Near(words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), parent[i], parent[i] == i) for i in sets}
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """One doc_id with two texts, each with a near copy; near copies among rows without a doc_id."""
    one, two, three, four = ([f"{x}{i}" for i in range(40)] for x in "abcd")
    copy = lambda w: " ".join([*w[:-1], "end"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, copy(one)), (3, copy(two)), (None, " ".join(three)), (None, copy(three)), (None, copy(one)), (None, " ".join(four)), (7, copy(four)), (8, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs, minhash.Near(words=2)).collect()]
    third = [r for r in got if r in rows[4:6]]
    assert len(third) == 1
    assert sorted(map(str, got)) == sorted(map(str, [rows[0], rows[1], rows[8], rows[9], rows[10], *third]))
    found = minhash.near_duplicates(docs, minhash.Near(words=2)).collect()
    assert sorted(str((r.doc_id, r.component_id, r.kept)) for r in found) == sorted(map(str, [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, False), (None, 1, False), (None, 7, False), (7, 7, True), (8, 8, True), (None, None, True)]))


def test_near_group_beyond_its_pivot(spark):
    """A chain: neighbours are alike, the ends are not; all become one component."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Near(words=1)).collect()
    assert {r.component_id for r in got} == {0}


def test_long_regular_words_keep_apart():
    """Two words that share every polynomial modulo 2^64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    cut = minhash.Shingler(2)
    assert cut(word)[0] != cut(other)[0] and (cut(word) == cut(word.upper())).all()


def test_near_duplicates_of_string_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [("b", long), ("a", long + " end"), ("c", "x y z"), (None, ""), ("d", "X y\tZ")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", *[f"'{c}' as `{c}`" for c in ("h", "_h", "_id", "_k", "k1", "rep", "bucket", "lead", "a.b")])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Near(words=2)).collect()}
    assert got == {"b": (299_999, "a", False), "a": (300_000, "a", True), "c": (2, "c", True), "d": (2, "c", False), None: (0, None, True)}
    stay = minhash.drop_near_duplicates(df, minhash.Near(words=2)).collect()
    assert {r.doc_id for r in stay} == {"a", "c", None} and all(r[c] == c for r in stay for c in ("h", "_h", "_id", "_k", "k1", "rep", "bucket", "lead", "a.b"))


def test_url_vocabulary_from_a_table(spark):
    """Thousands of terms against a search for each; nulls, empty and very long urls, clashing names, repeated rows."""
    r = random.Random(6)
    letters = "abcdefghij"
    terms = sorted({"".join(r.choices(letters, k=r.randint(2, 5))) for _ in range(6000)})
    rows = [(t.upper() if i % 2 else f" {t} ", 1.0 if i % 5 == 0 else 0.5) for i, t in enumerate(terms)] + [(None, 1.0), ("", 1.0), ("zz", None), (terms[1], 0.1)]
    made = urls.vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert made == {t: 1.0 if i % 5 == 0 else 0.5 for i, t in enumerate(terms)}
    pages = [(i, "http://h/" + "".join(r.choices(letters + "-/.", k=r.randint(0, 40)))) for i in range(400)] + [(900, None), (901, ""), (902, "http://h/" + "ab" * 200_000), (903, "http://h/" + "zz/" * 100_000), (903, "http://h/" + "zz/" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'k' as _by", "'x' as host", "7 as `a.b`")
    got = urls.filter_urls(df, rules=(), terms=made).collect()
    strict, soft = ({t for t, w in made.items() if w == x} for x in (1.0, 0.5))
    assert len(got) == len(pages) and all(x._by == "k" and x["a.b"] == 7 for x in got)
    for x in got:
        words = set(re.split("[^a-z0-9]", (x.url or "").lower()))
        assert x.verdict == ("block" if words & strict or len(words & soft) >= 2 else "allow")
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_fingerprints(spark, docs, empty):
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip(" ")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(docs).collect()}
    seen = {}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        t, x, g = r.text or "", after.text or "", got[r.doc_id]
        k = len(t) // 4
        edited = t[: len(t) - k] + x[:k]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(canon(t), g.fingerprint) == g.fingerprint
        assert g.near_next == float(canon(t) == canon(x)) and g.near_edited == float(canon(t) == canon(edited))
    assert len(set(seen.values())) == len(seen)
    assert fingerprints.fingerprint_with_edits(empty).count() == 0


def test_colliding_digests_are_told_apart(spark, docs, monkeypatch):
    real = fingerprints.digest
    monkeypatch.setattr(fingerprints, "digest", lambda canon, seed=0: real(canon, seed) if seed else (F.lit(7).cast("long"), F.lit(7).cast("long")))
    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip(" ")
    by_text, found = defaultdict(set), fingerprints.fingerprint(docs).collect()
    for r in found:
        by_text[canon(r.text)].add(r.fingerprint)
    assert len(found) == docs.count() and all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    edited = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_with_edits(docs).collect()}
    assert edited == {r.doc_id: r.fingerprint for r in found}


def test_fingerprints_of_repeated_and_null_ids(spark):
    """Rows of one doc_id or none follow by length; repeated rows have a result each; columns of internal names stay."""
    rows = [(None, "bb"), (None, "a"), (3, "xxxx"), (3, "xxxx"), (3, "yy"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_with_edits(df).collect()), key=str)
    chain = ["a", "bb", "yy", "xxxx", "xxxx", ""]
    ids = [None, None, 3, 3, 3, 4]
    edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(chain, chain[1:] + chain[:1])]
    assert got == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in zip(ids, chain, edits)), key=str)
    clash = df.selectExpr("text", "doc_id as canon", "doc_id as f1", "'x' as f2", "1 as fingerprint")
    back = fingerprints.fingerprint(clash)
    assert back.columns == ["text", "canon", "f1", "f2", "fingerprint"] and sorted(map(str, back.select("canon", "f1", "f2").collect())) == sorted(map(str, clash.select("canon", "f1", "f2").collect()))


PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, near copies, a table without letters."""
    r = random.Random(8)
    words = {"en": ["the", "shore", "thing", "over", "lamp", "of"], "fr": ["le", "bord", "chose", "sur", "lampe", "du"]}
    rows = [(i, " ".join(r.choices(words[lg], k=r.randint(8, 60))), lg, f"s{i % 3}") for i in range(60) for lg in [r.choice(["en", "fr"])]]
    long = [r.choice(words["en"]) + str(r.randint(0, 99)) for _ in range(4000)]
    rows += [(100, " ".join(long), "en", "s0"), (101, " ".join([*long[:-1], "end"]), "en", None), (102, None, "en", "s1"), (103, "", None, None), (104, "12 34 !!", "fr", "s1"), (None, "the shore of the thing over the lamp", None, "s2"), rows[5], rows[5]]
    return spark.createDataFrame([(*x, len(x[1]) if x[1] else None) for x in rows], PIPE).repartition(3)


def test_pipeline_stages_by_hand(spark):
    import corpus_pipeline as cp

    docs, sf = odd_documents(spark), ""
    rows = docs.collect()
    stages = dict(cp.STAGES)
    # language: decided by the operator that is tested by hand above
    kept = stages["language ID"](spark, docs, sf)
    model = [(x.text, x.lang) for x in rows if x.text and x.lang and zlib.crc32(str(x.doc_id).encode()) % 3 != 1]
    want = [x for x in rows if x.text and re.search(r"[^\W\d_]", x.text) and backoff_by_hand(model, x.text)[1] >= cp.LEAST_SCORE]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want)) and kept.columns == docs.columns
    # near duplicates: the smallest id of each component of five-word shingle sets
    stay = stages["MinHash near-dedup"](spark, docs, sf).collect()

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    groups = [{i} for i in range(len(rows))]
    for i, x in enumerate(rows):
        for j in range(i):
            a, b = shingles(x.text), shingles(rows[j].text)
            if a and len(a & b) * 100 >= 80 * len(a | b):
                groups[i] |= groups[j]
        for k in groups[i]:
            groups[k] = groups[i]
    order = lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0)
    first = {str(rows[min(g, key=order)]) for g in groups}
    assert sorted(map(str, stay)) == sorted(first)
    # mixture: as many words as came in, nothing more than three times
    mixed = stages["mixing sources to target weights"](spark, docs, sf).collect()
    n = lambda rows: sum(len((x.text or "").split()) for x in rows)
    assert n(mixed) == n(rows) and all(x.n_chars == len(x.text) for x in mixed)
    # packing: texts come back from the sequences
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.token_pieces(docs.where("doc_id < 50"), max_tokens=64)
    made = packing.sequences(packing.pack(pieces, 64)).collect()
    flat = [i for s_ in made for i in np.frombuffer(bytes(s_.ids), "<u4").tolist()]
    assert all(len(s_.ids) <= 256 for s_ in made) and len(flat) == sum(len(ids.encode(x.text, add_special_tokens=False).ids) + 1 for x in rows if x.doc_id is not None and x.doc_id < 50)
    assert {x for s_ in made for x in s_.doc_ids} == {x.doc_id for x in rows if x.doc_id is not None and x.doc_id < 50}
    empty = spark.createDataFrame([], PIPE)
    assert all(stage(spark, empty, sf).count() == 0 for stage in stages.values())


INTERNAL = "before _bucket _value _total _start _at _before _row _turn _found _by _h _id _k t s n words row at size canon f1 f2 seed key cid k1 k2 lead rep bucket part host2 source_key target".split()


def test_columns_of_internal_names_stay(spark):
    """Every operator that gives its callers' rows back leaves their other columns as they are."""
    docs = odd_documents(spark).where("doc_id < 40").selectExpr("*", *[f"'{c}!' as `{c}`" for c in INTERNAL], "'dot' as `a.b`")
    pages = docs.selectExpr("*", "concat('http://h.org/', doc_id) as url", "concat('<p>', text) as html")
    out = {
        "pack": packing.pack(docs.selectExpr("*", "0 as piece", "1 + doc_id % 5 as length"), 8), "mix": mixing.mix(docs), "urls": urls.filter_urls(pages), "html": html_extract.extract(pages),
        "shards": sharding.assign_shards(docs, sharding.tree(4)), "language": langid.identify_documents(docs), "near": minhash.drop_near_duplicates(docs), "fingerprint": fingerprints.fingerprint(docs),
    }
    for name, df in out.items():
        got = df.select(*[f"`{c}`" for c in [*INTERNAL, "a.b"]]).distinct().collect()
        assert [tuple(r) for r in got] == [(*[f"{c}!" for c in INTERNAL], "dot")], name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.run(spark, sf).count() > 0
