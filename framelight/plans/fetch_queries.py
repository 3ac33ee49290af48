"""Queries over stored responses: the driver's tables make addresses that redirect, loop, fail or are too large; expected rows are SQL over the same numbers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.functions.lineage import met
from framelight.operators.extraction import crawl
from framelight.operators.review import number_pages
from framelight.plans.queries import query
from framelight.sources import responses as fetching
from framelight.sources.responses import decoded, followed, with_fetched, with_key

SHOP = "https://shop.example.com"
_LIMIT = 64  # bytes
# kinds of addresses: by p_partkey % 10, how many redirects there are before what ends the chain
_CHAIN = "CASE p_partkey % 10 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END"
_URL = f"'{SHOP}/f/' || CAST(p_partkey AS STRING) || '/'"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/f/k/0 to /f/k/n: redirects, then a page; 4 points back to itself, 5 to a private host, 6 is too large, 7 an error, 8 points nowhere, 9 is not there."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 10 <> 9").selectExpr("p_partkey", f"{_CHAIN} AS n", f"explode(sequence(0, {_CHAIN})) AS i")
    to = f"CASE WHEN p_partkey % 10 = 4 THEN CAST(1 - i AS STRING) WHEN i < n THEN '/f/' || CAST(p_partkey AS STRING) || '/' || CAST(i + 1 AS STRING) WHEN p_partkey % 10 = 5 THEN 'http://127.0.0.1/admin' END"
    points = "p_partkey % 10 IN (4, 8) OR i < n OR p_partkey % 10 = 5"
    return rows.selectExpr(f"{_URL} || CAST(i AS STRING) AS url", f"CASE WHEN {points} THEN 301 + i % 2 WHEN p_partkey % 10 = 7 THEN 404 ELSE 200 END AS status", f"{to} AS location", "encode(CASE WHEN p_partkey % 10 = 6 THEN repeat('x', 65) ELSE 'Product ' || CAST(p_partkey AS STRING) END, 'UTF-8') AS body")


_ERRORS = {3: fetching.TOO_MANY, 4: fetching.TOO_MANY, 5: fetching.FORBIDDEN, 6: fetching.TOO_LARGE, 7: fetching.REFUSED, 8: fetching.NOWHERE, 9: fetching.UNREACHED}


@query(f"""SELECT p_partkey AS pos, copy, CASE p_partkey % 10 {" ".join(f"WHEN {k} THEN '{e}'" for k, e in _ERRORS.items())} END AS error,
CASE WHEN p_partkey % 10 < 3 THEN 'Product ' || p_partkey END AS content FROM part, (SELECT unnest(range(3)) AS copy)""")
def fetched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with what their address led to; three items ask for each address, which is fetched once."""
    items = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS pos", f"{_URL} || '0' AS image_url", "explode(sequence(0L, 2L)) AS copy")
    return with_fetched(items, _responses(spark, sf_dir), most_bytes=_LIMIT).select("pos", "copy", "error", decoded(F.col("content")).alias("content"))


@query(f"""SELECT p_partkey AS pos, CASE p_partkey % 10 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 5 WHEN 5 THEN 2 ELSE 0 END AS hops,
CASE p_partkey % 10 WHEN 9 THEN NULL WHEN 6 THEN 200 WHEN 7 THEN 404 WHEN 8 THEN 301 WHEN 3 THEN 302 WHEN 4 THEN 302 WHEN 5 THEN 301 ELSE 200 END AS status,
'{SHOP}/f/' || p_partkey || '/' || CASE p_partkey % 10 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS final_url FROM part""")
def fetched_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each address leads, over at most five redirects, each checked."""
    urls = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{_URL} || '0' AS url")
    ended = followed(urls.select("url"), with_key(_responses(spark, sf_dir)), _LIMIT)
    return urls.join(met(ended), "url").select(F.col("p_partkey").alias("pos"), "hops", "status", "final_url")


_LAST = "(s_suppkey % 9 + 1)"


@query(f"""WITH p AS (SELECT s_suppkey, unnest(range(1, {_LAST} + 1)) AS i FROM supplier)
SELECT '{SHOP}/l/' || s_suppkey AS listing_id, '{SHOP}/l/' || s_suppkey || '?page=' || i AS url, i AS page_number, 'Page ' || i AS page_label FROM p WHERE i <> 5""")
def listing_crawl_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of listings by their final addresses: each is linked to by two addresses that redirect to it; page 5 is refused, page 4 links past it."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", f"{_LAST} AS n", f"explode(sequence(1L, {_LAST})) AS i")
    page = lambda i: f"'{SHOP}/l/' || CAST(s_suppkey AS STRING) || '?page=' || CAST({i} AS STRING)"
    way = lambda kind, i: f"'{SHOP}/{kind}/' || CAST(s_suppkey AS STRING) || '/' || CAST({i} AS STRING)"
    moved = rows.selectExpr(f"explode(array({way('go', 'i')}, {way('alt', 'i')})) AS url", "302 AS status", f"{page('i')} AS location", "encode('', 'UTF-8') AS body")
    there = rows.selectExpr(f"{page('i')} AS url", "CASE WHEN i = 5 THEN 500 ELSE 200 END AS status", "CAST(NULL AS STRING) AS location", "encode(CAST(i AS STRING), 'UTF-8') AS body")
    on = "CASE WHEN i = 4 THEN i + 2 ELSE i + 1 END"
    links = rows.selectExpr(f"{page('i')} AS final_url", f"CASE WHEN {on} <= n THEN array({way('go', on)}, {way('alt', on)}, {way('go', 'i')}) ELSE array() END AS links")
    asked = moved.select("url").unionByName(there.select("url"))
    ended = followed(asked, with_key(moved.unionByName(there)), fetching.PAGE_BYTES).filter("error IS NULL")
    start = rows.filter("i = 1").selectExpr(f"'{SHOP}/l/' || CAST(s_suppkey AS STRING) AS listing_id", f"{way('go', 'i')} AS url")
    return number_pages(crawl(start, ended.join(met(links), "final_url").select("url", "final_url", "links")))
