"""Fetching over stored responses: limits, refusals and odd rows; crawls by final addresses."""

from pyspark.sql import functions as F

from framelight.operators.extraction import crawl
from framelight.sources.responses import FORBIDDEN, NOWHERE, REFUSED, TOO_LARGE, TOO_MANY, UNREACHED, decoded, fetched, with_fetched

FORM = "url string, status int, location string, content_length string, body binary, more int"


def answers(spark, rows):
    return spark.createDataFrame([(u, s, to, length, body, 1) for u, s, to, length, body in rows], FORM)


def test_fetches(spark):
    a = "http://a.example.com"
    rows = [
        (f"{a}/ok", 200, None, None, b"fine"), (f"{a}/to", 302, "ok", None, b""), (f"{a}/spaces", 307, "  /ok ", None, None), (f"{a}/self", 301, f"{a}/self", None, b""), (f"{a}/scheme", 301, "ftp://a.example.com/", None, b""),
        (f"{a}/inside", 301, "http://10.0.0.1/", None, b""), (f"{a}/bad", 301, "http://[bad", None, b""), (f"{a}/none", 308, " ", None, b""), (f"{a}/said", 200, None, "99", b"x"), (f"{a}/large", 500, None, "what", b"x" * 11),
        (f"{a}/edge", 200, None, "10", b"x" * 10), (f"{a}/error", 404, None, None, b""), (f"{a}/empty", 200, None, None, None), (f"{a}/twice", 500, None, None, b"b"), (f"{a}/twice", 200, None, None, b"a"), (f"{a}/twice", 200, None, None, b"a"),
        (None, 200, None, None, b""), ("http://127.0.0.1/", 200, None, None, b"secret"), (f"{a}/see", 300, None, None, b"list"),
    ]
    asked = [r[0] for r in rows] + ["", "  ", None, f"{a}/nowhere", "http://[bad", f" {a}/ok "]
    got = {r.url: r for r in fetched(spark.createDataFrame([(u,) for u in asked], "url string"), answers(spark, rows), most_bytes=10).collect()}
    assert len(got) == len({(u or "").strip() for u in asked} - {""})
    short = {u.removeprefix(a): (r.error, r.hops, r.body and bytes(r.body)) for u, r in got.items()}
    assert short == {
        "/ok": (None, 0, b"fine"), "/to": (None, 1, b"fine"), "/spaces": (None, 1, b"fine"), "/self": (TOO_MANY, 5, None), "/scheme": (FORBIDDEN, 0, None), "/inside": (FORBIDDEN, 0, None), "/bad": (FORBIDDEN, 0, None),
        "/none": (NOWHERE, 0, None), "/said": (TOO_LARGE, 0, None), "/large": (TOO_LARGE, 0, None), "/edge": (None, 0, b"x" * 10), "/error": (REFUSED, 0, None), "/empty": (None, 0, None), "/twice": (None, 0, b"a"),
        "http://127.0.0.1/": (FORBIDDEN, 0, None), "/nowhere": (UNREACHED, 0, None), "http://[bad": (FORBIDDEN, 0, None), "/see": (None, 0, b"list"),
    }
    items = spark.createDataFrame([(1, f"{a}/ok", "x"), (2, f"{a}/ok", "x"), (3, None, "x"), (4, f"{a}/error", "x")], "n int, image_url string, url string")
    assert sorted((r.n, r.error, r.content and bytes(r.content)) for r in with_fetched(items, answers(spark, rows)).collect()) == [(1, None, b"fine"), (2, None, b"fine"), (3, None, None), (4, REFUSED, None)]
    assert fetched(spark.createDataFrame([], "url string"), answers(spark, [])).collect() == []
    one = spark.createDataFrame([(b"\xc3\xa4", None), (b"\xe4", "latin-1"), (b"\xff", "nonsense"), (None, None)], "b binary, e string").select(decoded(F.col("b"), F.col("e"))).collect()
    assert [r[0] for r in one] == ["ä", "ä", "�", None]


def test_a_crawl_is_capped_and_knows_pages_by_their_final_address(spark):
    """Against a queue worked off one by one."""
    import random

    rng = random.Random(4)
    u = lambda k: f"http://s.example.com/c?page={k}"
    final = {k: rng.choice([k, k, rng.randrange(400)]) for k in range(400)}
    links = {k: [rng.randrange(400) for _ in range(rng.randrange(12))] for k in range(400)}
    lost = {k for k in range(1, 400) if rng.random() < 0.1}
    starts = [0, 7, 30]
    most = 10

    def brute(start):
        queue, visited, pages = [start], set(), []
        while queue and len(pages) < most:
            k = queue.pop(0)
            visited.add(k)
            if k in lost or final[k] in pages:
                continue
            pages.append(final[k])
            for to in links[final[k]]:
                if to not in visited and to not in queue and len(visited) + len(queue) < 4 * most:
                    queue.append(to)
        return [u(k) for k in pages]

    lost -= set(starts)
    web = spark.createDataFrame([(u(k), u(final[k]), [u(to) for to in links[final[k]]]) for k in range(400) if k not in lost], "url string, final_url string, links array<string>")
    got = crawl(spark.createDataFrame([(s, u(s)) for s in starts], "listing_id long, url string"), web, most).orderBy("listing_id", "pos").collect()
    for s in starts:
        assert [r.url for r in got if r.listing_id == s] == brute(s)
    assert crawl(spark.createDataFrame([], "listing_id long, url string"), web, most).collect() == []
