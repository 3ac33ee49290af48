"""Queries over what is stored: versions of the master table, packages of media. Each stores what it reads in a new place of the shared folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.functions.lineage import shared_folder
from framelight.operators.normaliser import normalise
from framelight.plans.page_queries import _BROKEN, _CANVAS, _KIND, PER_PAGE, SHOP, _to_frame
from framelight.plans.queries import _DEDUPED, _FRESH, _OLD, _ROWS, _orders, query
from framelight.sinks.master import clear_pages, load_master, master, upsert_master
from framelight.sinks.media import as_png, media_files, package_mark, read_package, side_by_side, with_media_paths, write_package
from framelight.sinks.versions import Versions


@query(f"""WITH old AS ({_DEDUPED.format(_ROWS + _OLD)}), fresh AS ({_DEDUPED.format(_ROWS + _FRESH)}),
kept AS (SELECT * FROM old ANTI JOIN (SELECT DISTINCT m, s, p FROM fresh) USING (m, s, p)), whole AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
SELECT m AS main_category, s AS subcategory, p AS page_label, u AS product_url, price FROM whole WHERE p <> 'Page 7'""")
def committed_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: a stored master table after a committed upsert, a change that was rolled back, and pages that were cleared."""
    store = Versions(spark, shared_folder(spark, "master"))
    load_master(store, _orders(spark, sf_dir, _OLD), buckets=8)
    with store.change() as change:
        upsert_master(change, _orders(spark, sf_dir, _FRESH))
        change.commit()
    gone = _orders(spark, sf_dir, " true").filter("page_label = 'Page 7'").select("main_category", "subcategory", "page_label", "page_url").distinct()
    with store.change() as change:
        clear_pages(change, gone)
        change.commit()
    with store.change() as change:  # not committed: it leaves nothing
        clear_pages(change, _orders(spark, sf_dir, " true").limit(1))
    return master(store).select("main_category", "subcategory", "page_label", "product_url", "price")


_NAMED = f"p_name || ' ' || {_KIND}"
_HAS = {"current_image_file": "current", "normalized_image_file": "normalized", "comparison_image_file": "comparison"}


@query(f"""SELECT 'media/Home/General/Page ' || (p_partkey // {PER_PAGE}) || '/' || {_NAMED} || '__' || substr(sha256('product_url:{SHOP}/p/' || p_partkey), 1, 16) || '/' || f AS path, '89504E470D0A1A0A' AS begins
FROM part, (SELECT unnest(['current.png', 'normalized.png', 'before_after.png']) AS f) WHERE p_partkey % {_BROKEN} <> 0""")
def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of the images before, after and side by side, written by the tasks that make them, and read back by the paths that its rows have."""
    images = _to_frame(spark, sf_dir, keep=("page_id", "name", "product_url")).withColumn("now", F.struct("data", "height", "width", "channels"))
    framed = normalise(images, canvas=_CANVAS).filter("error IS NULL")
    listed = {"product_name": F.col("name"), "page_url": F.lit(""), "main_category": F.lit("Home"), "subcategory": F.lit(""), "page_label": F.concat(F.lit("Page "), F.col("page_id").cast("string"))}
    now, size = F.col("now"), F.lit(_CANVAS)
    drawn = {"current": as_png(now["data"], now["height"], now["width"], now["channels"]), "normalized": as_png("canvas", size, size, F.lit(3)), "comparison": side_by_side(now["data"], now["height"], now["width"], now["channels"], F.col("canvas"), size)}
    rows = with_media_paths(framed.withColumns(listed | drawn), _HAS)
    root = shared_folder(spark, "media")
    write_package(media_files(rows, _HAS), root, "audit")
    back = read_package(spark, root, "audit")
    assert package_mark(root, "audit")["files"] > 0
    return back.select("path", F.hex(F.substring("content", 1, 8)).alias("begins"))
