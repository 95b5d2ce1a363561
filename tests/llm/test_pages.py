"""Main text and archives: against known pages, brute force and a round trip."""

import base64
import gzip
import hashlib
import heapq
import io
import random
import time
from collections import Counter

import pytest
from conftest import SF_SMALL
from helpers import same_rows
from pyspark.sql import functions as F

from labelflow.llm import html_main, warc
from labelflow.llm.common import table

PAGE = "page_id bigint, url string, html string"


# -- main text

@pytest.fixture(scope="module")
def model(spark):
    return html_main.fit_regions(table(spark, SF_SMALL, "pages"))


def test_marked_articles(spark, model):
    pages = table(spark, SF_SMALL, "pages")
    got = {r.page_id: r for r in html_main.extract_main(pages, model).collect()}
    import html as h
    import re
    for r in pages.collect():
        inner = re.sub(r"<[^>]*\Z", "", r.html.split("<article>")[1].split("</article>")[0])
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav>only a menu</nav>", ""),
    ("<p>one<p>two  <b>bold\n</b> end", "one\ntwo bold end"),
    ("<article><p>a &lt; b &amp;amp; c&nbsp;d</p></article>", "a < b &amp; c d"),
    ("<article><p>x<br>y</p><!-- <p>no</p> --><script>var p='<p>no</p>';</script><style>p{}</style><p>z</p></article>", "x y\nz"),
    ("<article><p title='a>b' data-x=\"<p>\">kept</p><p>cut <a href=\"/x", "kept\ncut"),
    ("<article><h1>T</h1><p>One.</p><aside><p>Side text of many words that would win by length alone</p></aside><p>Two.</p><div class='ad-box'>Buy</div><p>Three.</p></article>", "T\nOne.\nTwo.\nThree."),
    ("<div id='header'>Site</div><ul class='menu'><li><a>Home</a></li></ul><div id='content'><p>The story goes on and on.</p><p>Second part <span class='ad'>buy</span> here.</p></div>"
     "<div id='comments'><p>I liked this story so much that I say so at great length, really.</p></div><form><p>Your name please</p></form><div class='footer'>All rights</div>",
     "The story goes on and on.\nSecond part here."),
    ("<article><p>text</p><section class='comments'><article><p>first comment, rather long to read</p></article></section></article>", "text"),
    ("3 < 4 and <5", "3 < 4 and <5"),
])
def test_known_pages(model, page, text):
    assert model.extract(page or "") == text


REST = "<div class='ad'>Buy this now</div><article><h1>T</h1><p>One two three.</p></article><div class='footer'>All rights</div>"


@pytest.mark.parametrize("page, text", [
    (f"<html class='has-sidebar'><body class='no-sidebar comments-open'>{REST}</body></html>", "T\nOne two three."),
    ("<body class='menu'><div class='nav'>Home</div><div id='content'><p>One two three.</p></div></body>", "One two three."),
    (f"<body><form id='aspnetForm'><div id='header'>Site</div>{REST}</form></body>", "T\nOne two three."),
    ("<form id='aspnetForm'><ul class='menu'><li>Home</li></ul><div id='content'><p>One two three four.</p></div></form>", "One two three four."),
    ("<nav>Home</nav><article class='post share'><p>One two.</p><div class='share'>Tweet this</div></article>", "One two."),
    ("<article><h2 id='toc_1'>First</h2><p>One.</p><h2 id='related-work'>Next</h2><p>Two.</p></article>", "First\nOne.\nNext\nTwo."),
    (f"<div class='layout-sidebar'>{REST}</div>", "T\nOne two three."),
    ("<div class='with-sidebar'><div class='content'><p>One two three.</p></div><div class='sidebar'>Links</div></div>", "One two three."),
    ("<article class='post share'><p>One.</p></article><div id='comments'><article class='comment'><p>A long comment on all of it.</p></article></div>", "One."),
    ("<div id='content'><p>One two three.</p></div><aside><article><p>A teaser of another page, of more words.</p></article></aside>", "One two three."),
    ("<div class='main-menu'>Home</div><div role='main' class='sidebar-left'><p>One two three.</p></div>", "One two three."),
])
def test_names_of_the_frame(model, page, text):
    assert model.extract(page) == text


def test_labelled_pages_outweigh_the_prior(spark):
    page = "<div class='widget'><h3>More</h3></div><div class='banner'><article><p>{0}</p></article></div><div class='plain'>{1}</div>"
    pages = spark.createDataFrame([(i, f"u{i}", page.format("word " * 50 + str(i), "other " * 9)) for i in range(40)], PAGE)
    fitted = html_main.fit_regions(pages)
    assert fitted.words["banner"] > 0 > fitted.words["widget"]
    assert fitted.extract("<div class='banner'><p>One two three.</p></div><div class='widget'>Links</div>") == "One two three."


def test_pages_with_defined_cases(spark, model):
    rows = [(1, None, None), (None, "u", "<p>a</p>"), (1, None, None), (2, "v", "<article>" + "<p>w</p>" * 30_000)]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"text": F.lit("z"), "n_chars": F.lit(1)})
    got = html_main.extract_main(pages, model).collect()
    want = [(1, None, "", 0), (None, "u", "a", 1), (1, None, "", 0), (2, "v", "\n".join(["w"] * 30_000), 59_999)]
    assert same_rows(got, want)
    empty = spark.createDataFrame([], PAGE)
    assert html_main.extract_main(empty, html_main.fit_regions(empty)).collect() == []


def test_unclosed_quotes_take_linear_time(model):
    assert model.extract("<p>a</p>" + "<a href='" * 20_000) == "a"


@pytest.mark.parametrize("page, text", [
    ("<div id='content'><h1>Title</h1><p>Body text one.</p><div class='ad'>Buy now</div><p>Two.</p></div>", "Title\nBody text one.\nTwo."),
    (f"<div id='story'><p>Body text one.</p><div class='ad'>{'buy ' * 16}</div><p>Two.</p></div><div class='nav'>{'x ' * 20}</div>", "Body text one.\nTwo."),
    (f"<div id='x'><p>Body text one of many.</p><div class='ad'>{'buy ' * 40}</div><p>Two and three.</p></div>", "Body text one of many.\nTwo and three."),
    (f"<div id='content'><div><p>One.</p></div><div class='promo'><div>{'buy ' * 40}</div></div><div><p>A longer second part of it.</p></div></div>", "One.\nA longer second part of it."),
    ("<article><p>One</p><span class='ad'>buy <i class='promo'>now</span> <p>Two.</p></article>", "One\nTwo."),
])
def test_text_behind_furniture(model, page, text):
    assert model.extract(page) == text


@pytest.mark.parametrize("page, words", [
    ("<div>" * 100_000 + "deep", 1), ("<div><p>word " * 50_000, 50_000), ("<span class='ad'>x" * 50_000, 0), ("a <span class='ad'>x</span> " * 50_000, 50_000),
    ("<b class='ad'>" * 30_000 + "</i></p><p>" * 30_000 + "deep", 0)])
def test_deep_pages_take_linear_time(model, page, words):
    t = time.monotonic()
    assert len(model.extract(page).split()) == words
    html_main.count_page(f"<article>{page}")
    assert time.monotonic() - t < 60  # hours, if every tag walked its ancestors


def test_counts_against_a_walk_up_every_block():
    rng, bits = random.Random(3), """<div>|</div>|<div class='ad'>|<p>|</p>|words here and|more|<article>|</article>|<span class=ad>|</span>|<form>|</form>|<div id=content>|<aside>|</aside>
        |<ul><li>|</ul>|<header>|</header>|<article class='comment'>|<section class='post'>|</section>|<nav>|</nav>|<main>|</main>|<div class='banner post'>|<i class=promo>|</i>""".split("|")
    counted = 0
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 50)))
        page = html_main.parse(text)
        frame = html_main.Frame(page)
        rows = []
        for kind, what, e in page.items:
            around = []
            while e >= 0:
                around.insert(0, e)
                e = page.parent[e]
            own = next((i for i, x in enumerate(around) if x in frame.own), -1)
            below = around[own + 1:]
            furniture = any(x not in frame.framed and html_main.is_furniture(page.keys[x]) for x in below)
            rows.append((kind, what, {k for x in (below if furniture else around) for k in page.keys[x] if not furniture or k in html_main.FURNITURE}, kind == "block" and own >= 0 and not furniture, furniture))
        inside, want = [i for i, r in enumerate(rows) if r[3]], Counter()
        for i, (kind, what, keys, good, furniture) in enumerate(rows if inside else []):
            if kind == "tag" and not furniture:
                want["tag", what, inside[0] <= i <= inside[-1]] += 1
            for k in keys if kind == "block" else ():
                want["word", k, good] += len(what.split(" "))
        assert html_main.count_page(text) == want
        counted += bool(want)
    assert counted > 500


@pytest.mark.parametrize("seed", range(20))
def test_best_region_is_the_best(seed):
    rng = random.Random(seed)
    score = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 40))]
    lo, hi = html_main.best_region(score)
    assert sum(score[lo:hi]) == max([0.0] + [sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)])


# -- archives

ROWS = [(5, "https://www.b.example.com/x?Q=1", "same"), (3, "http://a.example.com/", "same"), (9, "http://a.example.com/", "same"), (4, "http://c.org/é x", None), (6, "not a url", ""), (7, None, "<p>ünï</p>\r\n\r\nWARC/1.1"),
        (None, "http://a.example.com/z", "same"), (3, "http://a.example.com/", "same"), (None, "http://[bad", "alone"), (None, "http://q.net", "alone"), (-2, "http://n.net/\r\nX: y", "neg"), (8, "http://n.net/", "neg"), (11, "http://long.net/", "é" * 300_000)]


def brute(rows, min_bytes=0):
    body = [(h or "").encode() for *_, h in rows]
    out = []
    for (i, *_), b in zip(rows, body):
        same = [r[0] for r, c in zip(rows, body) if c == b and r[0] is not None]
        first = min(same, default=None) if len(b) >= min_bytes else None
        back = first if first is not None and first != i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if back is None else "revisit", back))
    return out


RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGE).withColumns({"run": F.lit("z"), "offset": F.lit(1), "payload": F.lit("y"), "sha": F.lit("x"), "first": F.lit(0)}).repartition(4)
    got = warc.archive_round_trip(pages)
    assert same_rows(got.select(*RESULT).collect(), brute(ROWS))
    assert got.where("record_type <> indexed_type").count() == 0
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).collect() == []


def test_small_payloads_are_all_responses(spark, tmpdir_path):
    runs = warc.write_archives(spark.createDataFrame(ROWS, PAGE), tmpdir_path, min_bytes=5)
    assert same_rows(warc.read_archives(runs, tmpdir_path).select(*RESULT).collect(), brute(ROWS, 5))


def test_files_are_plain_warc(spark, tmpdir_path):
    runs = warc.write_archives(spark.createDataFrame(ROWS, PAGE).repartition(2), tmpdir_path).collect()
    for r in runs:
        raw = open(f"{tmpdir_path}/{r.run}", "rb").read()
        one = gzip.GzipFile(fileobj=io.BytesIO(raw[r.offset: r.offset + r.length])).read()
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        got = warc.parse_record(one)
        assert (got["page_id"], got["record_type"], got["payload_digest"]) == (r.page_id, r.record_type, r.digest)


def test_damage_is_noticed():
    good = warc.warc_record("http://a.b/", 1, b"payload", warc.base32_sha1(b"payload"), None, None)
    assert warc.parse_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"payload\r\n", b"peyload\r\n"))
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(gzip.compress(good)[:-9])))


def test_history_is_in_global_order(spark):
    rng = random.Random(16)
    rows = [(i, "http://hot.example.com/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.net/{rng.randrange(9)}", f"p{i}") for i in rng.sample(range(2000), 2000)]
    pages = spark.createDataFrame(rows, PAGE).repartition(7)
    from labelflow.llm.common import scratch
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small tables would be one run and one partition
    try:
        runs = warc.write_archives(pages, scratch(spark, "test-warc"))
        merged = warc.merge_runs(runs)
        assert merged.rdd.getNumPartitions() > 3
        got = [(r.url_key, r.timestamp) for r in merged.collect()]  # collect keeps partition order
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert runs.select("run").distinct().count() > 3
    assert len(got) == 2000 and got == sorted(got)


def test_captures_are_numbered_over_partition_edges(spark, tmpdir_path):
    rng = random.Random(18)
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h{rng.randrange(40)}.net/", f"p{i}") for i in rng.sample(range(600), 600)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = warc.write_archives(spark.createDataFrame(rows, PAGE).repartition(7), tmpdir_path)
        index = warc.capture_index(runs)
        got = warc.read_archives(index, tmpdir_path).orderBy("position").collect()
        spans = warc.merge_runs(runs).where("url_key = 'com,example,hot)/'").select("part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert spans > 2 and [r.position for r in got] == list(range(600))
    seen, want = {}, []
    for i, u, _ in sorted(rows, key=lambda r: (warc.url_key(r[1]), r[0])):
        seen[u] = seen.get(u, 0) + 1
        want.append((warc.url_key(u), i, seen[u]))
    assert [(r.url_key, r.page_id, r.capture) for r in got] == want
    with pytest.raises(Exception, match="does not name"):
        warc.read_archives(index.where("position <> 300"), tmpdir_path).collect()


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    lists = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
    got = [(x, w, i) for w, i, x in warc.LoserTree(lists)]
    assert [x for x, *_ in got] == list(heapq.merge(*lists))
    assert all(lists[w][i] == x for x, w, i in got) and got == sorted(got)


def test_url_key():
    assert warc.url_key("https://www.Blog.example.com:8080/A/b?X=1#f") == "com,example,blog)/a/b?x=1"
    assert warc.url_key("") == "" and warc.url_key("http://[bad") == "http://[bad"


@pytest.mark.parametrize("i", [None, 0, 5, -1, 2 ** 63 - 1, -2 ** 63])
def test_record_ids(i):
    assert warc.page_of(warc.record_id("http://a", i)) == i
