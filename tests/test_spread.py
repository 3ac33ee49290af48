"""How the queries' work is dealt to tasks, and what their joins move: read from plans."""

import os

import pytest
from pyspark.sql import functions as F

from framelight.functions.text import is_noise_name
from framelight.operators.extraction import dom_products
from framelight.plans.catalog import catalog
import framelight.plans.fetch_queries  # noqa: F401
from framelight.plans.page_queries import _images, _to_frame
from framelight.plans.queries import QUERIES
from framelight.sources.html import page_nodes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_dealt_to_tasks_and_never_joined(spark):
    least = 2 * spark.sparkContext.defaultParallelism
    assert _images(spark, SF).rdd.getNumPartitions() >= least
    framed = _to_frame(spark, SF, keep=("page_id", "name", "product_url"))
    assert "Join" not in plan(framed) and {"page_id", "name", "product_url", "item_category", "image_id", "data"} <= set(framed.columns)


def test_the_catalogue_is_dealt_to_tasks(spark):
    assert catalog(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["listing_products", "listing_products_loose", "listing_names_beside", "listing_rejections", "fetched_items", "fetched_chains"])
def test_made_rows_are_never_sent_whole_to_the_driver(spark, name):
    """On the smallest tables, where every estimate is small."""
    assert "BroadcastExchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_cleaned_once_for_all_noise_words(spark):
    shown = plan(spark.range(1).select(is_noise_name(F.col("id").cast("string")).alias("noise")))
    assert "exists(" not in shown and shown.count("regexp_replace") == 1


def test_images_and_links_of_pages_are_judged_once(spark):
    """What reads addresses is no part of the joins' plan, however often they read images and links."""
    page = """<div class="product"><a href="/p/1"><img src="/i/1.png" alt="Kettle one"></a></div><p><a href="/c?b=1&amp;a=2"><img src="/i/2.png" alt="Kettle two"></a></p>"""
    found = dom_products(page_nodes(spark.createDataFrame([(1, "https://x.example/c?a=2&b=1", page)], "page_id long, url string, html string")), strict=False)
    assert "absolute(" not in plan(found)
    assert [(r.name, r.product_url) for r in found.orderBy("pos").collect()] == [("Kettle one", "https://x.example/p/1"), ("Kettle two", "https://x.example/c?b=1&a=2")]
