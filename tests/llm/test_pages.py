import html as h
import random
import re

import numpy as np
import pyarrow.parquet as pq

from siftline.llm import pages


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = pages.common(np.array(a, np.int64), np.array(b, np.int64))
        assert found == sorted(set(found)) and len(found) == lcs(a, b)
        rest = iter(b)
        assert all(any(y == a[i] for y in rest) for i in found)


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header>Site <b>head</b></header><nav><ul><li>Menu<li>More</ul></nav><div class="ad big">Buy &lt;now&gt;</div>
<article><header><h1>Title &amp; more</h1><span>by line</span></header><p>One<b>two</b> three &eacute;&#x20AC;<br>four
five<p class=advert>Ad text<p>six <!-- <p>not</p> --> 3 < 4</p><form>f</form><ul><li>item<li>next</ul><section id="comments"><p>great!</p></section></article>
<div>outside</div><footer>foot</footer></body></html>"""


def text_of(page):
    found = pages.lines(page)
    inside = any(k == pages.INSIDE for _, k in found)
    return " ".join(t for t, k in found if k == (pages.INSIDE if inside else pages.OPEN))


def test_lines():
    assert text_of(PAGE) == "Title & more Onetwo three é€ four five six 3 < 4 item next"
    assert text_of("") == "" and text_of("plain <b>text") == "plain text"
    assert text_of("<p>a<script>if (x<1) '<p>no'") == "a"
    assert text_of("<div id='cookie-notice'>x</div><div hidden>y</div><div role=search>z</div>body") == "body"
    pages.lines("<a " * 50_000 + "<p '" * 50_000)


def articles(table):
    for i, page in zip(table["page_id"], table["html"]):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        yield i, " ".join(h.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())


def test_fixture_pages_give_their_articles(spark):
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()
    got = {r.page_id: r for r in pages.op7_pages(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(table["page_id"])
    for i, want in articles(table):
        assert got[i].text == want and got[i].n_chars == len(want)


def test_differencing_finds_templates_that_no_markup_tells(spark):
    """The test pages share no lines but article text. Without their article elements
    none of it may go; with a menu and an imprint in plain elements, those must."""
    path = "/root/testdata/sf0.1/pages.parquet"
    table = pq.read_table(path).to_pydict()
    want = dict(articles(table))
    rows = spark.read.parquet(path)
    bare = rows.selectExpr("page_id", "url", "regexp_replace(html, '</?article>', ' <hr> ') AS html")
    assert {r.page_id: r.text for r in pages.main_text(bare).collect()} == want
    menu = "<div>Start page</div><div>All the topics of this site</div><div>"
    dressed = rows.selectExpr("page_id", "url", f"replace(replace(html, '<article>', '{menu}'), '</article>', '</div><div>Imprint and contact</div>') AS html")
    assert {r.page_id: r.text for r in pages.main_text(dressed).collect()} == want
    lines = spark.createDataFrame([(r.page_id, r.url, *map(list, zip(*pages.lines(r.html)))) for r in dressed.collect()], "row long, url string, texts array<string>, kinds array<int>")
    gone = {r.row: len(r.gone) for r in pages.gone_lines(lines).collect()}
    assert len(gone) == len(want) and min(gone.values()) == 3


def test_aligned_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for most in (1 << 21, 0):
        monkeypatch.setattr(pages, "_PAIRS", most)
        for _ in range(200):
            a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 25))] for _ in range(2))
            x, y = pages.aligned(a, b)
            assert x == sorted(set(x)) and y == sorted(set(y)) and len(x) == len(y) == lcs(a, b)
            assert [a[i] for i in x] == [b[j] for j in y]


def test_what_neighbours_share(spark):
    menu, foot = "<div>Home</div><div>About this site and its many pages</div>", "<div>All rights are reserved, as everywhere</div>"
    quote = "<p>A passage that several pages of the site quote word for word.</p>"
    own = lambda i, n: "".join(f"<p>Paragraph {j} of page {i} says something else each time.</p>" for j in range(n))
    rows = []
    for i in range(8):  # a quote in half of the pages stays; menus and footers go
        rows.append((i, f"http://a.com/{i}", menu + own(i, 4) + (quote if i % 2 else "") + foot))
    for i in range(20, 26):  # a short article under a long template
        rows.append((i, f"http://b.com/{i}", menu * 9 + f"<p>Short {i}</p>" + foot))
    for i in range(40, 46):  # copies with scattered changes, and one whole copy twice
        parts = [f"<p>Line {j} of a text that is copied with few changes.</p>" for j in range(12)]
        parts[(i * 5) % 12] = f"<p>changed {i}</p>"
        parts[(i * 7 + 3) % 12] = f"<p>changed too {i}</p>"
        rows.append((i, f"http://c.com/{i}", "".join(parts)))
    rows.append((46, "http://c.com/46", rows[-1][2]))
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    plain = lambda x: " ".join(re.sub("<[^>]*>", " ", x).split())
    for i in range(8):
        assert got[i] == plain(own(i, 4) + (quote if i % 2 else ""))
    for i in range(20, 26):
        assert got[i] == f"Short {i}"
    for i in range(40, 46):
        assert got[i] == plain(next(r[2] for r in rows if r[0] == i))
    assert got[46] == got[45]


def test_neighbours_of_one_template_among_several():
    own = [20, 20, 20, 30, 200, 200, 200, 40]
    apart, plain, inside = ([kind] * 8 for kind in (pages.APART, pages.OPEN, pages.INSIDE))
    lonely, same = [[0], [], [], []], [0, 1, 2, 3, 7]  # neighbours with other templates, and one with the same
    assert pages.deleted(own, apart, lonely) == []
    assert pages.deleted(own, apart, [*lonely, same]) == pages.deleted(own, plain, [*lonely, same, same]) == same
    assert pages.deleted(own, plain, [*lonely, same]) == pages.deleted(own, inside, [*lonely, same, same]) == []
    assert pages.deleted(own, plain, [*lonely, [0, 1, 2, 6, 7], [0, 1, 2, 6, 7]]) == [0, 1, 2, 7]  # a quote before the last line stays
    assert pages.deleted(own, apart, [*lonely, [0, 1, 7]]) == []  # too few first lines
    assert pages.deleted([300, 300, 300, 900, 900], apart, [*lonely, [0, 1, 2]]) == []  # and too much text


def test_differencing_decides_on_fixture_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    lines = spark.createDataFrame([(r.page_id, r.url, *map(list, zip(*pages.lines(r.html)))) for r in rows], "row long, url string, texts array<string>, kinds array<int>")
    gone = pages.gone_lines(lines).collect()
    assert len(gone) > 100
    kinds = {r.row: r.kinds for r in lines.collect()}
    assert all(kinds[r.row][k] != pages.INSIDE for r in gone for k in r.gone)


def test_pages_of_hostile_nesting_take_linear_time():
    import time

    start = time.time()
    pages.lines("<div>" * 50_000 + "</x>" * 50_000)
    pages.lines("<b>" * 50_000 + "<p></p>" * 50_000)
    pages.aligned(list(range(100_000)), list(range(1, 100_001)))
    assert time.time() - start < 10


def test_differencing_deletes_the_template(spark):
    body = lambda i: f"<body><div>Welcome to the site</div><div>All rights reserved</div><div>Own text of page {i} is long enough to be the article, {'word ' * i}</div><div>See you again</div></body>"
    rows = [(i, f"http://a.example.com/x/{i}", body(i), "gone") for i in range(1, 6)]
    rows += [(10, "http://b.example.com/x", body(1), "k"), (11, "http://c.example.com/y", body(9), "k"), (12, "http://c.example.com/y", body(9), "k"), (12, "http://c.example.com/y", body(9), "k")]
    rows += [(20, None, None, "k"), (21, "no scheme", "<p>x", "k"), (None, "http://a.example.com/", "", None)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, row string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(1, 6):
        assert text[i] == f"Own text of page {i} is long enough to be the article, {'word ' * i}".strip()
    assert text[10].startswith("Welcome") and text[11] == text[12] and text[11].startswith("Welcome")
    assert text[20] == "" and text[21] == "x" and text[None] == ""
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host_and_path(spark):
    from pyspark.sql import functions as F

    rows = [("HTTP://A.Example.com/P/q?x#y",), ("no",), (None,), ("a://b#c",), ("x://y://z/w",), ("http://h?/p",), ("s://h\n/p",)]
    got = spark.createDataFrame(rows, "u string").select(pages.host_of(F.col("u")), pages.path_of(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("a.example.com", "/P/q"), ("", ""), ("", ""), ("b", ""), ("y:", "//z/w"), ("h", ""), ("h\n", "/p")]
