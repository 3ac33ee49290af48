"""Extraction from markup, on small pages with expected rows written by hand."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelight.operators.extraction import best_of_srcset, crawl, dom_products, enriched, judged_images, page_contexts, pagination_links, scrape, single_products
from framelight.operators.review import number_pages
from framelight.sources import html
from framelight.sources.html import page_nodes, structured_products

URL = "https://shop.example.com/c/ovens"
LISTING = """<html><head><title>Ovens | Shop</title><script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"],"name":"Oven One Deluxe","image":["/i/1.png"],"url":"/p/one"},
{"@type":"Product","name":"Other","image":{"url":"/i/none.png"}}]}</script><script type="application/ld+json">{bad</script></head>
<body><header class="site"><a href="/"><img src="/i/top.png" alt="Top banner"></a></header><h1>Ovens</h1><nav class="breadcrumb">Home Ovens</nav>
<div class="product-card"><a href="/p/one"><img data-src="/i/1.png" srcset="/i/1s.png 320w, /i/1.png 640w"></a><h3 class="title">Oven One</h3></div>
<div class="item"><a href="/p/two"><img src="/i/2.png" width="89"></a><h3>Too Small</h3></div>
<li><a href="/p/three"><img src="/i/3.png" alt="Oven Three"></a><h4>Oven Three</h4></li>
<section><h2>You may also like</h2><div class="product"><a href="/p/x"><img src="/i/x.png" alt="Kettle X"></a></div></section>
<p><a href="/p/four"><img src="/i/4.png" alt="Oven Four"></a></p><p><img src="data:image/png;base64,xx" alt="Inline"></p><p><img src="/i/5.png" alt="Alone Here"></p>
<div class="product"><a href="https://other.example.org/p"><img src="/i/6.png" alt="External Oven"></a></div>
<footer><img src="/i/f.png" alt="Oven footer"></footer>
<div class="pagination"><a href="?page=2">2</a><a href="?page=3">3</a><a href="/about">About</a></div><a rel="next" href="?page=2">Next</a></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return page_nodes(spark.createDataFrame([(1, URL, LISTING), (2, URL, None), (3, URL, "<div><p>unclosed <img src='a.png'>")], "page_id long, url string, html string")).cache()


def test_products(nodes):
    got = {r.name: r for r in dom_products(nodes).filter("page_id = 1").collect()}
    assert sorted(got) == ["External Oven", "Oven Four", "Oven One", "Oven Three"]
    one = got["Oven One"]
    assert (one.image_url, one.product_url, one.page_membership_method, one.page_membership_confidence) == ("https://shop.example.com/i/1.png", "https://shop.example.com/p/one", "catalog_card", "high")
    assert got["Oven Four"].page_membership_method == "strong_product_link_recovery" and got["Oven Three"].product_url.endswith("/p/three")
    assert got["External Oven"].product_url is None and got["External Oven"].page_membership_confidence == "medium"
    assert {r.name for r in dom_products(nodes, strict=False).filter("page_id = 1").collect()} == {*got, "Alone Here"}


def test_structured_data_enriches_only(nodes):
    assert [(r.name, r.image_url) for r in structured_products(nodes).orderBy("at").collect()] == [("Oven One Deluxe", "https://shop.example.com/i/1.png"), ("Other", "https://shop.example.com/i/none.png")]
    got = {r.image_url[-5:]: r for r in scrape(nodes).filter("page_id = 1").collect()}
    assert got["1.png"].name == "Oven One Deluxe" and got["1.png"].structured_data_match and not got["3.png"].structured_data_match and len(got) == 4
    assert enriched(dom_products(nodes), structured_products(nodes).limit(0)).count() == dom_products(nodes).count()


def test_contexts_and_pages(spark, nodes):
    got = {r.page_id: r.page_context for r in page_contexts(nodes).collect()}
    assert got[1] == f"{URL} | Ovens | Shop | Ovens | Home Ovens"
    assert [r.link for r in pagination_links(nodes).filter("page_id = 1").orderBy("pos").collect()] == [f"{URL}?page=2", f"{URL}?page=3"]
    web = spark.createDataFrame([(URL, [f"{URL}?page=2"]), (f"{URL}?page=2", [f"{URL}?page=4", URL]), (f"{URL}?page=4", [f"{URL}?page=2"])], "url string, links array<string>")
    pages = crawl(spark.createDataFrame([("l", URL + "/")], "listing_id string, url string"), web)
    assert [(r.url, r.page_number) for r in number_pages(pages).orderBy("page_number").collect()] == [(URL, 1), (f"{URL}?page=2", 2), (f"{URL}?page=4", 4)]


@pytest.mark.parametrize(("srcset", "best"), [("a.png 100w, b.png 300w", "b.png"), ("a.png 1x, b.png 2x", "b.png"), ("a.png, b.png", "a.png"), ("a.png 2x, b.png 900w", "a.png"), ("", None), ("a.png bad, b.png 2w", "b.png")])
def test_srcset(spark, srcset, best):
    assert spark.range(1).select(best_of_srcset(F.lit(srcset))).first()[0] == best


def test_single_products(spark, nodes):
    pages = [
        (1, "https://x.example/p/two?a=1", '<script type="application/ld+json">[{"@type":"Product","name":"One","image":"1.png"},{"@type":"Product","name":"Two","image":"2.png","url":"/p/two/"}]</script>'),
        (2, "https://x.example/p/3", '<h1> Big  Oven </h1><meta property="og:image" content="/o.png"><img src="/z.png">'), (3, "https://x.example/p/4", '<img src="/a.png" alt="Nice kettle">'), (4, "https://x.example/p/5", "<p>nothing</p>"),
    ]
    got = {r.page_id: (r.name, r.image_url[-5:], r.source) for r in single_products(page_nodes(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    assert got == {1: ("Two", "2.png", "single_product_jsonld"), 2: ("Big Oven", "o.png", "single_product_og"), 3: ("Nice kettle", "a.png", "single_product_dom")}


def test_crawl_goes_far_past_many_links(spark):
    """25 hops where the next page is the last of 50 links, and more than a thousand links on a page."""
    url = lambda i: f"{URL}?page={i}" if i > 1 else URL
    web = [(url(i), [f"https://shop.example.com/about/{j}" for j in range(1200 if i == 1 else 49)] + [url(i + 1)]) for i in range(1, 40)]
    pages = crawl(spark.createDataFrame([("l", URL)], "listing_id string, url string"), spark.createDataFrame([(u, [x for x in links if "page" in x]) for u, links in web], "url string, links array<string>"))
    assert [r.url for r in pages.orderBy("pos").collect()] == [url(i) for i in range(1, 26)]
    wide = crawl(spark.createDataFrame([("l", URL)], "listing_id string, url string"), spark.createDataFrame(web, "url string, links array<string>"))
    assert [r.url for r in wide.orderBy("pos").collect()] == [URL, *(f"https://shop.example.com/about/{j}" for j in range(24))]


GOOD = """<html><head><title>Ovens</title></head><body><h1>Range</h1><div class="product-card"><a href="/p/1"><img src="/i/1.png" alt="Deck Oven"></a><h3 class="title">Deck Oven</h3></div>{more}
<div class="pagination"><a href="/c?page=2">2</a></div></body></html>"""
BROKEN = [
    '<a href="http://[bad">3</a><div class="pagination"><a href="http://[bad/?page=3">3</a></div>',
    '<div class="product"><a href="http://[bad"><img src="/i/9.png" alt="Good Oven"></a></div><div class="product"><a href="/p/8"><img src="http://[bad/8.png" alt="Other Oven"></a></div>',
    '<script type="application/ld+json">{"@type":"Product","name":"Deck Oven","image":"http://[bad","url":"/p/1"}</script>',
    '<script type="application/ld+json">' + '{"a":' * 30_000 + "1" + "}" * 30_000 + "</script>",
    '<script type="application/ld+json">' + "[" * 100_000 + "</script>",
]


def test_what_cannot_be_read_stops_no_other_page(spark):
    """A malformed address counts as none, markup that nests too deep as no data; other pages are as they were."""
    base = "https://s.example.com/c"
    rows = [(1, base, GOOD.format(more="")), (2, "http://[bad", GOOD.format(more="")), *((10 + i, base, GOOD.format(more=more)) for i, more in enumerate(BROKEN))]
    nodes = page_nodes(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    products = {(r.page_id, r.name): r.image_url for r in scrape(nodes).collect()}
    assert {p for p, name in products if name == "Deck Oven"} >= {1, *range(10, 10 + len(BROKEN))} and (11, "Other Oven") not in products
    assert {r.page_id for r in page_contexts(nodes).collect()} == {r[0] for r in rows}
    links = {}
    for r in pagination_links(nodes).collect():
        links.setdefault(r.page_id, []).append(r.link)
    assert links == {p: [base + "?page=2"] for p, *_ in rows if p != 2}


def test_text_beyond_what_is_kept_is_seen_by_nothing(spark, monkeypatch):
    """Nodes with whole texts give the same products, contexts and links as nodes whose texts are cut."""
    long = "very long words " * 60
    more = f'<h1>{long}</h1><div class="breadcrumb">{long}</div><div class="product-card"><p>{long}</p><a href="/p/2">{long}<img src="/i/2.png"></a><h3 class="title">{long}</h3></div><nav><a href="/c?page=3">{long}</a></nav><section><h2>{long} you may also like</h2><div class="product"><a href="/p/4"><img src="/i/4.png" alt="{long}"></a></div></section>'

    def nodes(shown):
        monkeypatch.setattr(html, "SHOWN", shown)
        parser = html.Flattener()
        parser.feed(GOOD.format(more=more))
        parser.close()
        return spark.createDataFrame([(1, "https://s.example.com/c", i, tag, attrs, path, " ".join(texts)) for i, (tag, attrs, path, texts) in enumerate(parser.nodes)], html.NODES)

    cut, whole = nodes(300), nodes(10**9)
    assert whole.agg(F.max(F.char_length("text"))).first()[0] > 2000
    for what in (scrape, lambda n: scrape(n, strict=False), pagination_links, page_contexts):
        assert sorted(map(str, what(cut).collect())) == sorted(map(str, what(whole).collect())) != []


def test_names_beside_images(spark):
    """Only the first element of a kind counts, nearer ancestors win, noise and texts of other lengths do not; without any the image has no name."""
    long = "word " * 40
    pages = [
        "<div><h3>No</h3><h3>Second Heading</h3><p><img src='/i/0.png'></p></div>", "<div><h3>No</h3><i class='name'>By Class</i><p><img src='/i/1.png'></p></div>", "<div><h1>Far Heading</h1><p><b class='title'>Near Title</b><img src='/i/2.png'></p></div>",
        f"<div><h3>{long}</h3><p><img src='/i/3.png'></p></div>", "<div><h3>Newsletter</h3><h4>Real Name</h4><p><img src='/i/4.png'></p></div>", "<article>Whole Text <b><img src='/i/5.png'></b></article>", "<img src='/i/6.png'>", "<h2>After It</h2>", None,
    ]
    nodes = page_nodes(spark.createDataFrame([(i, URL, h) for i, h in enumerate(pages)], "page_id long, url string, html string"))
    got = {r.page_id: r.name for r in judged_images(nodes).collect()}
    assert got == {0: "Unnamed product", 1: "By Class", 2: "Near Title", 3: "Unnamed product", 4: "Real Name", 5: "Whole Text", 6: "Unnamed product"}
    assert judged_images(nodes.limit(0)).collect() == []


def test_nodes_go_on_in_small_batches(spark):
    """A batch of many pages is not held as nodes all at once."""
    text = "<ul>" + "<li><b class='x'>a</b></li>" * 49 + "</ul>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(400)), "url": ["https://s.example/"] * 400, "html": [text] * 399 + [None]})
    sizes = [len(b) for b in html.flattened(iter([pages]))]
    assert sum(sizes) == 399 * 99 and max(sizes) < html.BATCH + 99
    one = page_nodes(spark.createDataFrame([(7, "https://s.example/", text)], "page_id int, url string, html string")).filter("id = 2").first()
    assert one.asDict() == {"page_id": 7, "url": "https://s.example/", "id": 2, "tag": "b", "attrs": {"class": "x"}, "path": [1, 0], "text": "a"}


def test_pages_are_parsed_once_for_their_pagination(spark):
    """What is left of a page after its links were looked at is pagers and links that may lead on."""
    page = "<body>" + "".join(f"<a href='/about/{i}'>About {i}</a>" for i in range(48)) + "<a href='/c/1'>Top</a><div class='pagination'><a href='/c/1?page=2'>More</a></div><a rel='next' href='/c/1?page=3'>x</a><a href='/c/1?page=4'>4</a><a href='https://other.example/?page=5'>5</a></body>"
    pages = spark.createDataFrame([(1, "https://s.example/c/1", page)], "page_id long, url string, html string")
    found = pagination_links(page_nodes(pages))
    assert [(r.pos, r.link) for r in found.orderBy("pos").collect()] == [(1, "https://s.example/c/1?page=3"), (2, "https://s.example/c/1?page=2"), (3, "https://s.example/c/1?page=4")]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
