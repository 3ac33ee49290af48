"""The category gate, deduplication and limits of a page's candidates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.functions.categories import code_category, code_place, code_score, confidence, evidence, page_category, ranked_codes, with_codes
from framelight.functions.text import casefold
from framelight.functions.urls import bare, candidate_key


def gated(items: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """items (page_id, pos, name, product_url, image_url, requested_category, page_context) with gate struct: effective
    category, kept, and for what is left out why. Products of another known category go; those without any evidence stay; those that
    ``forced`` (page_id, override_key, category) names stay and are marked, if the gate is on at all."""
    rows = items.withColumn("effective_category", F.coalesce(F.nullif("requested_category", F.lit("")), page_category(F.col("page_context"))))
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("product_url", F.lit("")), F.coalesce("image_url", F.lit("")))
    scored = lambda c: F.struct(code_place(c).alias("place"), code_score(c).alias("score"), code_category(c).alias("category"))
    rows = with_codes(rows, text).withColumn("scores", F.transform(ranked_codes(F.col("codes_")), scored)).withColumn("override_key", candidate_key(F.col("product_url"), F.col("image_url"), F.col("name")))
    if forced is None:
        rows = rows.withColumn("is_forced", F.lit(False)).withColumn("forced_category", F.lit(None).cast("string"))
    else:
        keys = forced.groupBy("page_id", "override_key").agg(F.max("category").alias("forced_category")).withColumn("is_forced", F.lit(True))
        rows = rows.join(keys, ["page_id", "override_key"], "left").withColumn("is_forced", F.coalesce("is_forced", F.lit(False)))
    category, scores = F.col("effective_category"), F.col("scores")
    on = category.isNotNull()
    other = F.get(F.filter(scores, lambda s: s["category"] != category), F.lit(0))
    same = F.exists(scores, lambda s: s["category"] == category)
    rows = rows.withColumn("other_", other)
    other = F.col("other_")
    out = on & ~F.col("is_forced") & ~same & other.isNotNull()
    rows = rows.withColumn("out_", out)
    out = F.col("out_")
    rows = rows.withColumn("evidence_", F.when(out, evidence(F.col("text_"), other["place"])))  # of what is left out only
    quoted = lambda terms: F.array_join(F.transform(terms, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    reason = F.concat(
        F.lit("Detected as "), other["category"], F.lit(" while the audit category gate is "), category, F.lit(". Evidence: "), quoted(F.col("evidence_")), F.lit(". No "), category,
        F.lit(" category phrase was found in the product name/URLs. This does not mean the website placed the product in the wrong collection; it only explains why the audit gate excluded it."),
    )
    return rows.select(
        *items.columns, "effective_category", "override_key", (on & F.col("is_forced")).alias("manual_filter_override"), F.when(on & F.col("is_forced"), F.col("forced_category")).alias("manual_category_override"), (~out).alias("kept"),
        F.when(out, "category_gate").alias("filter_stage"), F.when(out, reason).alias("filter_reason"), F.when(out, other["category"]).alias("detected_category"), F.when(out, other["score"]).alias("detected_category_score"),
        F.when(out, confidence(other["score"], scores)).alias("filter_confidence"), F.col("evidence_").alias("detected_category_evidence"), F.when(out, F.array().cast("array<string>")).alias("expected_category_evidence"),
        F.when(out, F.transform(scores, lambda s: F.struct(s["category"].alias("category"), s["score"].alias("score")))).alias("category_scores"),
    ).withColumn("kept", F.coalesce("kept", F.lit(True)))


def candidate_identity(product_url: Column, image_url: Column) -> Column:
    product = bare(product_url)
    return F.when(product != "", F.concat(F.lit("product::"), product)).otherwise(F.concat(F.lit("image::"), casefold(F.split(F.coalesce(image_url, F.lit("")), "#")[0])))


def dedupe_candidates(items: DataFrame, most: int | None = None) -> DataFrame:
    """One candidate for each address on a page, in the place where it was seen first: the first of those that have most of an
    address and a name. Then the first ``most`` of the page."""
    better = (F.coalesce("product_url", F.lit("")) != "").cast("int") + (F.coalesce("name", F.lit("")) != "Unnamed product").cast("int")
    rows = items.withColumn("key_", candidate_identity(F.col("product_url"), F.col("image_url"))).withColumn("better_", better)
    same = Window.partitionBy("page_id", "key_")
    rows = rows.withColumn("nth_", F.row_number().over(same.orderBy(F.desc("better_"), "pos"))).withColumn("slot_", F.min("pos").over(same))
    kept = rows.filter("nth_ = 1").drop("key_", "better_", "nth_")
    return limit_per_page(kept, most, "slot_").drop("pos").withColumnRenamed("slot_", "pos").select(*items.columns)


def limit_per_page(items: DataFrame, most: int | None, order: str = "pos") -> DataFrame:
    if most is None:
        return items
    return items.withColumn("nth_", F.row_number().over(Window.partitionBy("page_id").orderBy(order))).filter(F.col("nth_") <= most).drop("nth_")
