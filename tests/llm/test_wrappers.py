import html
import json
import re

import pytest

from wavelake.llm.wrappers import _aligned, _item, extract, extracted, judged, merged, op9_wrappers, read

from .conftest import SF


def alone(page):
    tree = read(page)
    return extracted(tree, judged(json.loads(json.dumps(_item(tree)))))


def article(page):
    """The article element's text, by its tags alone."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (html.unescape(x) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner)))
    return " ".join(" ".join(x.split()) for x in blocks if x.strip())


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op9_wrappers(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_blocks_references_and_broken_markup():
    page = """<html><head><title>T</title></head><body class="single post"><header class=top><h2>Site</h2></header><div id=menu><a href=1>Home</a></div>
    <div id="cookie-notice">We use cookies</div><div class="post-content"><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp; two.<p>Three<br>four <span class="ad">BUY</span> five</p><ul><li>x<li>y</ul>
    <aside>side</aside><form>Sign <button>Go</button></form></div><div class="comments"><p>Nice!</p></div><footer>(c)</footer><script>if(a<b){"</div>"}</script></body></html>"""
    assert alone(page) == "Head & line One bold two. Three four five x y"
    assert [alone(x) for x in ("", "plain < 3", "<p>open <b>x", "<!-- a", "<a href='x", "<div>" * 3000 + "x")] == ["", "plain < 3", "open x", "", "", "x"]


def test_names_of_what_holds_the_page():
    text = "<h1>Title</h1><p>" + "words of the article " * 20 + "</p>"
    assert alone(f"<body><div class='layout has-sidebar'><div class='sidebar'>Side</div><article><div class='entry-header'><h1>Title</h1></div><p>Words.</p><div class='related'>More</div></article></div></body>") == "Title Words."
    assert alone(f"<body><div class='page-header'>Top</div><div class='with-sidebar'><div class='content'>{text}</div><div class='side'>x</div></div></body>").startswith("Title words of")


def test_options_groups_and_slots():
    pages = [f"<body><h1>T{k}</h1>{'<div class=note0><p>x</p></div>' if k % 2 else ''}{'<p>text</p>' * (k + 1)}<div class=end>same</div></body>" for k in range(4)]
    wrapper = _item(read(pages[0]))
    for p in pages[1:]:
        wrapper = merged(wrapper, _item(read(p)))
    body = wrapper[7][0][7]
    assert [(x[0], x[1], x[2]) for x in body] == [("h1", 0, 0), ("div.note0", 1, 0), ("p", 0, 1), ("div.end", 0, 0)]
    assert body[0][7][0][6] is None and body[3][7][0][6] == "same" and wrapper[3] == 4


def test_a_host_tells_frame_from_text(spark):
    rows = [(k, "http://h.org/%d" % k, f"<body><div><a href=x>Home</a></div><div><h1>Title {k}</h1><p>Words of page {k} and more of them.</p></div><div>All rights kept</div></body>") for k in range(6)]
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Title {k} Words of page {k} and more of them." for k in range(6)}


def stripped(page):
    """A page whose elements say nothing: div for article, nav and others, no class, id or role."""
    page = re.sub(r"<(/?)(?:article|main|header|footer|nav|aside)\b", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_hosts_whose_tags_say_nothing(spark):
    """Only the host's wrapper can tell the article there; of pages alone on their host few come out right."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = {r.page_id: re.match(r"https?://([^/]*)", r.url)[1].lower() for r in pages}
    sizes = {h: sum(x == h for x in host.values()) for h in set(host.values())}
    rows = [(r.page_id, r.url, stripped(r.html)) for r in pages if sizes[host[r.page_id]] >= 3]
    truth = {r.page_id: article(r.html) for r in pages}
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(found[i] == truth[i] for i, _, _ in rows)
    lone = sum(alone(page) == truth[i] for i, _, page in rows)
    assert right >= 0.9 * len(rows) and lone < 0.5 * right


def test_alignment_of_long_sequences():
    a = [(f"t{k % 7}", frozenset()) for k in range(20_000)]
    b = a[:9000] + [("x", frozenset())] + a[9000:]
    pairs = _aligned(a, b)
    assert [p for p, _ in pairs if p is not None] == list(range(len(a))) and [q for _, q in pairs if q is not None] == list(range(len(b)))
    assert sum(p is not None and q is not None for p, q in pairs) >= 0.4 * len(a)
    one, two = [("a", frozenset("p")), ("a", frozenset("q")), ("b", frozenset())], [("a", frozenset("q")), ("b", frozenset())]
    assert _aligned(one, two) == [(0, None), (1, 0), (2, 1)]


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (2, "", "", 2), (3, "u", "<p>" + "word " * 200_000, 3), (3, "u", "<p>" + "word " * 200_000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extract(pages).collect()
    assert len(found) == 4 and sorted(len(r.text) for r in found) == [0, 0, 999_999, 999_999] and extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [199, 201, 5000])
def test_constant_texts_of_any_length_go(spark, size):
    notice = ("the same notice on all pages " * 200)[:size].strip()
    own = [f"page {k} has this text of its own, " * 12 for k in range(4)]
    pages = [(k, f"http://plain.example/{k}", f"<html><body><div><p>{t}</p></div><div><div>{notice}</div></div></body></html>") for k, t in enumerate(own)]
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {k: t.strip() for k, t in enumerate(own)}
