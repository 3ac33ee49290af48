"""A catalogue made of the ``part`` table: items of pages with the metrics of an image whose product is one box.

One SELECT in the SQL that Spark and DuckDB share, so that oracles start from the same rows without this engine."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.functions.categories import archetype, with_item_category
from framelight.functions.geometry import profile, subtype

KINDS = ["Coffee Machine", "Built-in Oven", "Refrigerator", "Induction Hob", "Range Hood", "Robot Vacuum Omni", "Microwave Oven", "Trolley", "Ice Maker", "Kitchen Shelf", "Cordless Wet and Dry Vacuum"]

CATALOG_SQL = f"""
SELECT page_id, pos, name, product_url, image_url, image_width, image_height, x1, y1, x2, y2, n_structural, n_components, accessory_area_ratio,
       CAST(x2 - x1 AS DOUBLE) / image_width AS width_occupancy, CAST(y2 - y1 AS DOUBLE) / image_height AS height_occupancy,
       CAST(x1 + x2 AS DOUBLE) / 2 / image_width AS center_x, CAST(y1 + y2 AS DOUBLE) / 2 / image_height AS center_y,
       CAST(y2 AS DOUBLE) / image_height AS baseline_y, CAST(x1 AS DOUBLE) / image_width AS left_padding, CAST(y1 AS DOUBLE) / image_height AS top_padding,
       CAST(image_width - x2 AS DOUBLE) / image_width AS right_padding, CAST(image_height - y2 AS DOUBLE) / image_height AS bottom_padding, suspect
FROM (
  SELECT p_brand AS page_id, p_partkey AS pos,
         p_name || ' ' || CASE p_partkey % {len(KINDS)} {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS name,
         'https://Shop.Example.com/product/' || CAST(p_partkey AS STRING) || '/' AS product_url,
         'https://cdn.example.com/img/' || CAST(p_partkey % 1500 AS STRING) || '.png' AS image_url,
         w AS image_width, h AS image_height, x AS x1, y AS y1, x + CAST(floor(CAST((w - x) * (60 + p_partkey * 13 % 38) AS DOUBLE) / 100) AS BIGINT) AS x2,
         y + CAST(floor(CAST((h - y) * (55 + p_partkey * 29 % 42) AS DOUBLE) / 100) AS BIGINT) AS y2,
         CASE WHEN p_partkey % 17 = 0 THEN 2 ELSE 1 END AS n_structural, CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 1 END AS n_components,
         CASE WHEN p_partkey % 13 = 0 THEN CAST(p_partkey % 20 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS accessory_area_ratio, p_partkey % 97 = 0 AS suspect
  FROM (
    SELECT p_partkey, p_name, p_brand, w, h, CAST(floor(CAST(w * (2 + p_partkey * 7 % 24) AS DOUBLE) / 100) AS BIGINT) AS x, CAST(floor(CAST(h * (1 + p_partkey * 11 % 22) AS DOUBLE) / 100) AS BIGINT) AS y
    FROM (SELECT p_partkey, p_name, p_brand, 600 + 100 * (p_partkey % 4) AS w, 600 + 100 * (p_partkey * 3 % 5) AS h FROM part) sized
  ) begun
) boxed
"""


def dealt(rows: DataFrame, each: int, key: str = "p_partkey") -> DataFrame:
    """rows dealt by key to tasks of about ``each`` rows: a file of many short rows would else be the work of one task, whatever is made of them later."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(parts, key)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), each=20_000)
    return spark.sql(CATALOG_SQL.replace("FROM part)", "FROM {part})"), part=part)


def analysed(items: DataFrame) -> DataFrame:
    """catalog's rows as a page scan's: metrics struct, category, archetype, subtype, profile and comparison groups."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    metrics = F.struct(
        "image_width", "image_height", "height_occupancy", "width_occupancy", F.col("height_occupancy").alias("body_height_occupancy"), F.col("width_occupancy").alias("body_width_occupancy"),
        F.col("height_occupancy").alias("full_height_occupancy"), F.col("width_occupancy").alias("full_width_occupancy"), "center_x", "center_y", F.col("center_x").alias("full_centroid_x"), F.col("center_y").alias("full_centroid_y"),
        F.abs(F.col("center_x") - 0.5).alias("center_offset_x"), F.abs(F.col("center_y") - 0.5).alias("center_offset_y"), "left_padding", "right_padding", "top_padding", "bottom_padding",
        F.least("left_padding", "right_padding", "top_padding", "bottom_padding").alias("min_edge_padding"), "baseline_y", F.col("baseline_y").alias("body_baseline_y"), "accessory_area_ratio", F.col("n_components").alias("component_count"), F.col("suspect").alias("segmentation_suspect"),
    )
    rows = with_item_category(items).select("page_id", "pos", "name", "product_url", "image_url", metrics.alias("metrics"), "item_category", subtype(w, h, F.col("n_structural"), F.col("n_components"), F.col("accessory_area_ratio")).alias("subtype"), w.alias("w"), h.alias("h"))
    rows = rows.withColumn("item_archetype", archetype(F.col("name"), F.col("product_url"), F.col("item_category"))).withColumn("profile", profile(F.col("item_category"), F.col("subtype"), F.col("w"), F.col("h")))
    return with_groups(rows.drop("w", "h"))


def with_groups(rows: DataFrame) -> DataFrame:
    family = F.coalesce("item_category", F.lit("Generic"))
    return rows.withColumn("profile_group_key", F.concat_ws("::", family, "item_archetype", "profile")).withColumn("group_key", F.concat_ws("::", "profile_group_key", "subtype"))
