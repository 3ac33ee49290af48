"""Totals of scans, showcases and exports, and the rows of their reports.

Counts of empty tables are 0; a missing count of a page has the fallback that its function names, else 0."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelight.functions.text import python_fixed
from framelight.operators.review import unique_names

RECOVERED = "strong_product_link_recovery"  # fixed value: how a candidate came back that the listing's own rules had lost


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))


def page_counts(items: DataFrame, page: str = "page_id") -> DataFrame:
    """A row for each page of gated items (kept, manual_filter_override, page_membership_method): candidates before and after the gate,
    those it left out, those recovered, and those that an operator put back."""
    kept = F.col("kept")
    return items.groupBy(page).agg(
        F.count(F.lit(1)).alias("raw_candidate_count"), F.count_if(kept).alias("candidate_count"), F.count_if(~kept).alias("filtered_out_count"),
        F.count_if(F.col("page_membership_method") == RECOVERED).alias("recovered_membership_count"),
        F.count_if(kept & F.col("manual_filter_override")).alias("manual_included_count"),
    )


def scans_summary(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals over scanned pages: scouted counts raw candidates, or where that is null the matched ones."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pages.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pages"), _total(F.coalesce("raw_candidate_count", "candidate_count", F.lit(0))).alias("scouted"),
        _total(n("candidate_count")).alias("matched"), _total(n("filtered_out_count")).alias("filtered"), _total(n("flagged_count")).alias("issues"),
    )


def membership_totals(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Products verified on their page (where null: all candidates), those that only structured data names, and those recovered."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pages.groupBy(*(by or [])).agg(
        _total(F.coalesce("dom_verified_count", "candidate_count", F.lit(0))).alias("verified_total"),
        _total(F.greatest(F.lit(0), n("jsonld_discovered_count") - n("dom_verified_count"))).alias("structured_only_total"),
        _total(n("recovered_membership_count")).alias("recovered_total"),
    )


def showcase_counts(items: DataFrame) -> DataFrame:
    """Items (changed, normalization_error) of a showcase: all, replaced, unchanged, failed. A failed one counts as unchanged too."""
    changed = F.coalesce("changed", F.lit(False))
    failed = F.coalesce("normalization_error", F.lit("")) != ""
    return items.agg(F.count(F.lit(1)).alias("products"), F.count_if(changed).alias("replaced"), F.count_if(~changed).alias("unchanged"), F.count_if(failed).alias("errors"))


def showcase_shown(items: DataFrame, changed_only: bool = False, category: str | None = None) -> DataFrame:
    """The items that a showcase shows: all, or the changed ones; of one category, if it is named."""
    shown = items.filter(F.coalesce("changed", F.lit(False))) if changed_only else items
    return shown if category is None else shown.filter(F.col("item_category") == category)


def showcase_manifest(items: DataFrame, page: str = "page_id") -> DataFrame:
    """What lies where in a showcase's archive: a row for each item, its file's name unique on its page."""
    failed, text = F.coalesce("normalization_error", F.lit("")) != "", lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    status = F.when(failed, "replacement_failed").when(F.coalesce("changed", F.lit(False)), "corrected").otherwise("original_kept")
    return unique_names(items, page).select(
        page, F.col("name").alias("product_name"), status.alias("status_in_showcase"), text("profile"), text("subtype"),
        F.coalesce("image_url", F.lit("")).alias("source_image_url"), text("product_url"), F.concat(F.lit("showcase_images/"), "file_name", F.lit(".png")).alias("showcase_file"),
    )


def _export_columns(flagged_only: bool, error: Column, among: Column) -> list[Column]:
    failed = F.coalesce(error, F.lit("")) != ""
    return [F.count_if(among).alias("selected"), F.count_if(among & ~failed).alias("successes"), F.count_if(among & failed).alias("failures"), F.lit(flagged_only).alias("flagged_only")]


def export_counts(items: DataFrame, flagged_only: bool) -> DataFrame:
    """Items selected for an export (error null or empty: written): how many, with what success."""
    return items.agg(*_export_columns(flagged_only, F.col("error"), F.lit(True)))


def _review_columns(has_fix: Column) -> list[Column]:
    decision = F.coalesce("operator_decision", F.lit(""))
    return [
        F.count(F.lit(1)).alias("products"), F.count_if(F.coalesce("status", F.lit("")) != "pass").alias("needs_review"), F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.coalesce(has_fix, F.lit(False))).alias("generated_fixes"), F.count_if(decision == "complete_rework").alias("complete_rework"),
    ]


def review_counts(items: DataFrame) -> DataFrame:
    """Items (status, operator_decision, has_fix) of a review package: to be reviewed, passed, with a generated fix, to be remade."""
    return items.agg(*_review_columns(F.col("has_fix")))


def package_counts(items: DataFrame, flagged_only: bool) -> DataFrame:
    """review_counts of a showcase's items (changed, normalization_error) and export_counts of those that it changed or failed to change, in one pass."""
    error = F.col("normalization_error")
    selected = F.coalesce("changed", F.lit(False)) | error.isNotNull()
    return items.agg(*_review_columns(F.col("changed")), *_export_columns(flagged_only, error, selected))


def excluded_rows(items: DataFrame, with_page: bool = False) -> DataFrame:
    """What the gate left out, as text: 11 columns, or 13 with the page's label and address."""
    text = lambda c, name=None, default="": F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(name or c)
    page = [text("page_label"), text("page_url")] if with_page else []
    evidence = F.coalesce(F.array_join("detected_category_evidence", ", "), F.lit("")).alias("matched_evidence")
    return items.filter(~F.col("kept")).select(
        *page, text("name", "product_name", "Unnamed product"), text("effective_category", "expected_category"), text("detected_category"), text("filter_confidence"),
        text("detected_category_score"), evidence, text("filter_reason"), text("product_url"), text("image_url"), text("source"), text("page_membership_method"),
    )


TESTED, AUDITED = "Detection Test", "Advanced Audit"  # fixed values: the scans' names in lists


def excluded_everywhere(detection: DataFrame, audit: DataFrame) -> DataFrame:
    """What the gate left out of a single detection scan and of an audit's pages, told apart by source_kind. Where both are the same table it is read once,
    and each row that was left out stands for both."""
    tested, audited = F.lit("Latest Detection Test"), F.coalesce("page_label", F.lit("Page"))
    if detection is audit:
        both = F.explode(F.array(F.struct(tested.alias("label"), F.lit(TESTED).alias("kind")), F.struct(audited.alias("label"), F.lit(AUDITED).alias("kind"))))
        rows = excluded_rows(detection.withColumn("page_label", audited), True)
        return rows.select(both.alias("scan_"), *rows.columns).select(F.col("scan_.label").alias("page_label"), *[c for c in rows.columns if c != "page_label"], F.col("scan_.kind").alias("source_kind"))
    rows = excluded_rows(detection.withColumn("page_label", tested), True).withColumn("source_kind", F.lit(TESTED))
    return rows.unionByName(excluded_rows(audit.withColumn("page_label", audited), True).withColumn("source_kind", F.lit(AUDITED)))


def excluded_counts(rows: DataFrame) -> DataFrame:
    """How many of excluded_everywhere's rows there are by scan, by page, by detected category and by confidence, in one pass: dimension, value (of a page also
    its scan), n, and place, by which each dimension is listed (most first, then by name). Pages without exclusions are not listed; no rows give none."""
    named = rows.select(
        "source_kind", "page_label", F.coalesce(F.nullif("detected_category", F.lit("")), F.lit("Unknown")).alias("category"), F.coalesce(F.nullif("filter_confidence", F.lit("")), F.lit("unknown")).alias("confidence"),
    )
    dims = ["source_kind", "page_label", "category", "confidence"]
    sets = [[], [F.col("source_kind")], [F.col("source_kind"), F.col("page_label")], [F.col("category")], [F.col("confidence")]]
    of = {15: "all", 7: "scan", 3: "page", 13: "category", 14: "confidence"}  # by which dimensions are rolled up
    counted = named.groupingSets(sets, *dims).agg(F.grouping_id(*dims).alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("g").cast("int"))
    shown = counted.select(kind.alias("dimension"), F.when(kind == "page", F.col("source_kind")).alias("scan"), F.when(kind == "page", F.col("page_label")).otherwise(F.coalesce("source_kind", "category", "confidence", F.lit(""))).alias("value"), "n")
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value", "scan")  # one row for each page and category: the lists themselves
    return shown.withColumn("place", F.row_number().over(order))


def detection_report(scored: DataFrame) -> DataFrame:
    """Scored items as the report of one scan: 17 columns of text, numbers with 2 or 6 decimals."""
    m, six = F.col("metrics"), lambda c: python_fixed(c, F.lit(6))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return scored.select(
        "name", "image_url", text("product_url"), "profile", text("subtype"), text("comparison_group"), "status",
        python_fixed(F.col("consistency_score"), F.lit(2)).alias("consistency_score"), six(F.col("scale_ratio")).alias("scale_ratio_to_family_median"),
        six(m["height_occupancy"]).alias("height_occupancy"), six(m["width_occupancy"]).alias("width_occupancy"), six(m["center_offset_x"]).alias("horizontal_center_offset"),
        six(m["top_padding"]).alias("top_padding"), six(m["bottom_padding"]).alias("bottom_padding"), six(F.coalesce(m["accessory_area_ratio"], F.lit(0.0))).alias("accessory_area_ratio"),
        F.coalesce(m["component_count"], F.lit(1)).cast("string").alias("component_count"), F.array_join("issues", " | ").alias("issues"),
    )
