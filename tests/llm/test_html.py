"""Main texts of pages of known templates."""

import pytest

from ledgerloom.llm import html

SITE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header class="masthead">Site</header>
<nav><ul><li><a href="/a">a {i}</a><li><a href="/b">b</a></ul></nav><div class="ad">Buy {i}</div><div class="cookie-notice">We use cookies</div>
{body}<aside>related {i}</aside><div id="comments"><p>First! {i}</div><form><label>Mail</label><input></form><footer>&copy; Site {i}</footer></body></html>"""


@pytest.fixture(scope="module")
def extract(spark):
    def run(rows):
        df = spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, host string, pages int")
        return {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_texts(df).collect()}

    return run


def test_article(extract):
    body = "<article><h1>Title {i} &amp;amp; more</h1><p><b>First</b> line&nbsp;{i}<br>and\n  next<p>Second &lt;{i}&gt;<ul><li>one<li>two</ul><div class='ad-box'>no</div><section class='comments'>no</section></article>"
    got = extract([(i, f"https://one.example/{i}", SITE.format(i=i, body=body.format(i=i))) for i in range(6)])
    assert got[3] == (f"Title 3 &amp; more\nFirst line 3 and next\nSecond <3>\none\ntwo", len("Title 3 &amp; more\nFirst line 3 and next\nSecond <3>\none\ntwo"))


def test_repeated_article_text_stays(extract):
    body = "<article><p>The same words on every page.</p><p>Own {i}</p></article>"
    got = extract([(i, "https://two.example/", SITE.format(i=i, body=body.format(i=i))) for i in range(8)])
    assert all(t == f"The same words on every page.\nOwn {i}" for i, (t, _) in got.items())


def test_template_decides_inside_articles(extract):
    body = "<article><h1>Title {i}</h1><p>Own {i}</p><div class='x9'><h4>Stay close</h4><p>This line is on every page.</p></div><div class='k2'><h2>Abstract</h2><p>Sum of {i}</p></div><p class='z'>Tell others</p></article>"
    got = extract([(i, f"https://four.example/{i}", SITE.format(i=i, body=body.format(i=i))) for i in range(8)])
    assert all(t == f"Title {i}\nOwn {i}\nAbstract\nSum of {i}" for i, (t, _) in got.items())
    copies = extract([(i, f"https://five.example/{i}", SITE.format(i=1, body=body.format(i=1))) for i in range(8)])  # nothing varies: no template
    assert all(t == "Title 1\nOwn 1\nStay close\nThis line is on every page.\nAbstract\nSum of 1\nTell others" for t, _ in copies.values())


def test_names_of_parts_of_articles_stay(extract):
    body = ("<article><h1>T {i}</h1><h2 id='related-work'>Related work</h2><p>a {i}</p><h2 id='Legal_status'>Legal status</h2><section id='discussion'><p>b {i}</p></section><h3 id='search-results'>Search results</h3>"
            "<div class='share-price'>{i} euro</div><section class='reviews'><p>c {i}</p></section><div class='post-comments'><p>First! {i}</p></div><div class='share-bar'><a href='/s{i}'>Share {i}</a></div></article>")  # fmt: skip
    expected = "T {i}\nRelated work\na {i}\nLegal status\nb {i}\nSearch results\n{i} euro\nc {i}"
    got = extract([(i, f"https://six.example/{i}", SITE.format(i=i, body=body.format(i=i))) for i in range(8)])
    assert all(t == expected.format(i=i) for i, (t, _) in got.items())


def test_pages_without_article(extract):
    body = "<div class='content'><p>Long own text number {i}.</p><p>More of it, {i}.</p></div><div class='x7'>Printed on each page</div><div class='links'><a href='/1'>alpha</a> <a href='/2'>beta {i}</a></div>"
    got = extract([(i, "https://three.example/", SITE.format(i=i, body=body.format(i=i))) for i in range(8)])
    assert all(t == f"Long own text number {i}.\nMore of it, {i}." for i, (t, _) in got.items())


def test_hosts_of_one_layout_keep_their_own_templates(spark, extract):
    page = "<div class='content'><p>Own text {i} of {h}.</p></div><div class='x7'>Printed by {h}</div>"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # both hosts come in one batch
    try:
        got = extract([(10 * k + i, f"https://{h}.example/{i}", page.format(i=i, h=h)) for k, h in enumerate(("eins", "zwei")) for i in range(6)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(t == f"Own text {i % 10} of {('eins', 'zwei')[i // 10]}." for i, (t, _) in got.items()) and len(got) == 12


def test_odd_pages(extract):
    got = extract([(1, None, None), (2, "no host", ""), (3, "https://a/", "plain words"), (4, "https://a/", "<p>unclosed <b>bold"), (5, "https://a/", "<script>x</script><!-- c -->"), (6, "https://a/", "<article>" + "<div>" * 500 + "deep" + "</article>"),
                   (6, "https://a/", "<article>" + "<p>long " * 5000), (7, "https://b/", "&#x41;&eacute;&zzzz; &amp")])
    assert got[1] == got[2] == got[5] == ("", 0) and got[3][0] == "plain words" and got[4][0] == "unclosed bold" and got[7][0] == "Aé&zzzz; &"
    assert extract([]) == {}


def test_classes_are_by_occurrence(spark):
    row = lambda page, path, text, count: ("h", page, path, 0 if path else None, f"s{path}", 1, False, text, count, 0, 0)
    rows = spark.createDataFrame([row(1, 0, None, 1), row(2, 0, None, 1), row(1, 1, None, 2), row(2, 1, None, 3), row(1, 2, None, 2), row(2, 2, None, 3), row(1, 3, None, 1), row(2, 3, None, 1), row(1, 3, 7, 1)],
                                 "host string, page long, path long, parent long, step string, depth int, inside boolean, text long, count long, chars long, links long")
    got = html.templates(rows).first()
    assert sorted([sorted(t["path"] for t in c["tokens"]) for c in got["classes"]]) == [[0, 3], [1, 2]] and got["pages"] == 2


def test_without_the_template_the_result_is_another(extract):
    """Articles with lines that only the host's pages together tell from their own."""
    body = ("<article><h1>Title {i}</h1><p>Own {i}</p><p>The same sentence in each article.</p><p>Share this page on X</p><div class='q1'><p>Read our terms</p></div>"
            "<p class='b7'>Subscribe to the newsletter</p><p>We share {i} ideas</p></article>")  # fmt: skip
    pages = [SITE.format(i=i, body=body.format(i=i)) for i in range(8)]
    got = extract([(i, f"https://seven.example/{i}", h) for i, h in enumerate(pages)])
    assert all(t == f"Title {i}\nOwn {i}\nThe same sentence in each article.\nWe share {i} ideas" for i, (t, _) in got.items())
    alone = [html.extracted(html.parsed(h), html.Template(0, None)) for h in pages]
    assert all("Share this page on X" in t and "Read our terms" in t for t in alone)


def test_ends_that_are_left_out(extract):
    got = extract([(1, "https://a1/", "<html><head><title>t</title><body><article><p>Hello</p><p>there</article>"), (2, "https://a2/", "<head><meta charset=x><title>t<body><article><p>Hello"), (3, "https://a3/", "<html><head>Hello <b>there</b>"),
                   (4, "https://a4/", "<article><p>Pick <select><option>one<option>two</p><p>Hello</p></article>"), (5, "https://a5/", "<article><p>Say<textarea>typed<p>Hello</article>"), (6, "https://a6/", "<title>t<p>Hello")])
    assert [got[i][0] for i in range(1, 7)] == ["Hello\nthere", "Hello", "Hello there", "Pick\nHello", "Say\nHello", "Hello"]


def test_nothing_else_is_dropped(extract):
    got = extract([(1, "https://b1/", "<article><p>E=<math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds</p><p>a<script>x()</script>b<svg><text>s</text></svg>c</p><noscript><p>No script</p></noscript><p class='legal'>Legal</p><p class='warning'>Warned</p><p class='notice'>Noticed</p><object><p>Object</p></object></article>")])
    assert got[1][0] == "E=mc2 holds\nabsc\nNo script\nLegal\nWarned\nNoticed\nObject"


def test_deep_pages(extract):
    import time

    deep = "<article>" + "<div>" * 100_000 + "deep" + "</div>" * 50_000 + "<p>more" + "</article>"
    began = time.time()
    got = extract([(i, "https://deep/", deep) for i in range(3)] + [(9, "https://deep/", "<p>plain")])
    assert got[0][0] == got[2][0] == "deep\nmore" and got[9][0] == "plain" and time.time() - began < 60


def test_agrees_with_sql(spark, small, duck, same_rows):
    same_rows(html.op3_html_extraction(spark, small), duck, html.OP3_SQL)


def test_names_of_elements_are_made_once():
    """Elements written alike share one name; very long names are not kept. Lines are not counted."""
    html._named.cache_clear()
    page = html.parsed("<div class='b a' id=q.r role=nav>x\n</div>" * 50 + f"<div class='{'k' * 1000}'>y</div>")
    assert (html._named.cache_info().misses, html._named.cache_info().hits) == (1, 49) and page.getpos()[0] == 1
    assert [n.step for n in page.nodes[1:]] == ["div.a.b.nav.#q-r", "div." + "k" * 1000]
