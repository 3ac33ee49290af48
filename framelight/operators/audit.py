"""Audit rows: decisions, texts, manual edits, identities, and the master table."""

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from framelight.functions.fixed_values import AUDIT_COLUMNS, EXPORT_HEADINGS
from framelight.functions.text import casefold, natural_key, python_fixed
from framelight.functions.urls import canonical_http_url

# What each decision shows: status, label, text before the automatic findings, suggested fix.
DECISIONS = {
    "keep_original": ("APPROVED ORIGINAL", "Keep original", "MANUAL REVIEW — original image approved. Automatic detector originally reported: ", "Keep the original website image. Operator rejected the generated replacement."),
    "use_fixed": ("APPROVED FIX", "Use fixed image", "MANUAL REVIEW — normalized replacement approved. Original automatic findings: ", "Use the approved normalized replacement image."),
    "complete_rework": (
        "COMPLETE REWORK", "Complete rework required",
        "MANUAL REVIEW — source image is not usable as-is and the generated fix is also not acceptable. A new/reworked source image is required. Automatic findings: ",
        "Do not use the original or generated fix. Replace/rebuild the product image from a clean source, then run it through the audit again.",
    ),
}

# Words of an issue and the fix they ask for; the first that matches counts.
FIXES = [
    (["zoomed out"], "Increase normalized product scale."),
    (["zoomed in", "too large"], "Reduce normalized product scale."),
    (["shifted too far right"], "Move the product left to the canonical center."),
    (["shifted too far left"], "Move the product right to the canonical center."),
    (["baseline"], "Align the primary-body baseline with its compatible subgroup."),
    (["vertical centering"], "Recenter the selected appliance envelope vertically."),
    (["edge", "padding"], "Increase safe padding or reduce scale so the full visible extent fits."),
    (["foreground detection", "segmentation"], "Review foreground/body detection; consider AI segmentation or a manual body override."),
]
OTHER_FIX = "Review normalization settings for this product."
MANUAL_REWORK = "MANUAL REVIEW — complete image rework required."  # fixed value


def suggested_fix(issues: Column) -> Column:
    """The fixes of all issues, each once, in order."""

    def of(issue: Column) -> Column:
        low, out = F.lower(issue), None
        for words, fix in FIXES:
            match = low.contains(words[0])
            for w in words[1:]:
                match = match | low.contains(w)
            out = (F if out is None else out).when(match, fix)
        return out.otherwise(OTHER_FIX)

    return F.when(F.coalesce(F.size(issues), F.lit(0)) <= 0, "No correction required.").otherwise(F.array_join(F.array_distinct(F.transform(issues, of)), " "))


def issue_level(score: Column, issues: Column) -> Column:
    n = F.coalesce(F.size(issues), F.lit(0))
    unsure = F.exists(F.coalesce(issues, F.array().cast("array<string>")), lambda i: F.lower(i).rlike("segmentation|foreground detection"))
    score = F.coalesce(score, F.lit(100.0))
    return F.when(unsure, "Manual review").when((score < 55) | (n >= 3), "High").when((score < 78) | (n >= 2), "Medium").when(n > 0, "Low").otherwise("Pass")


def latest_decisions(events: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Of decision events (keep_original, use_fixed, complete_rework, reset) the last of each key; a reset leaves none."""
    last = events.groupBy(*key).agg(F.max_by("decision", order).alias("operator_decision"))
    return last.filter(F.col("operator_decision").isin(*DECISIONS))


def decide(items: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """items after the operator's decisions: the automatic findings are kept as auto_status and auto_issues; approval of either image
    passes an item, a rework sends it to review; every scan's copies of a key follow."""
    rows = items.withColumn("auto_status", F.col("status")).withColumn("auto_issues", F.col("issues")).join(decisions.select(*key, "operator_decision"), key, "left")
    d = F.coalesce("operator_decision", F.lit(""))
    rows = rows.withColumn("status", F.when(d.isin("keep_original", "use_fixed"), "pass").when(d == "complete_rework", "review").otherwise(F.col("auto_status")))
    none = F.array().cast("array<string>")
    return rows.withColumn("issues", F.when(d.isin("keep_original", "use_fixed"), none).when(d == "complete_rework", F.array(F.lit(MANUAL_REWORK))).otherwise(F.col("auto_issues")))


def audit_rows(items: DataFrame, include_passed: bool = False) -> DataFrame:
    """items (page: main_category, subcategory, page_label, page_url, effective_category; item: name, product_url, status, issues,
    auto_issues, operator_decision, consistency_score, profile, subtype, comparison_group, metrics) as rows of the audit table, all text.
    Passed items come only if decided upon or asked for."""
    d, m = F.coalesce("operator_decision", F.lit("")), F.col("metrics")
    shown = items if include_passed else items.filter((F.col("status") != "pass") | (d != ""))
    joined = lambda c, empty: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, " | ")).otherwise(empty)
    automatic = F.when(F.coalesce(F.size("auto_issues"), F.lit(0)) > 0, F.col("auto_issues")).otherwise(F.col("issues"))

    def by_decision(i: int, other: Column, tail: Column | None = None) -> Column:
        out = None
        for k, v in DECISIONS.items():
            out = (F if out is None else out).when(d == k, F.lit(v[i]) if tail is None else F.concat(F.lit(v[i]), tail))
        return out.otherwise(other)

    named = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    main, sub, label = named(F.coalesce(F.nullif("main_category", F.lit("")), F.col("effective_category")), "Uncategorized"), named("subcategory", "General"), named("page_label", "Page")
    six = lambda c: python_fixed(F.coalesce(c, F.lit(0.0)), F.lit(6))
    blank = {c: F.lit("") for c in AUDIT_COLUMNS if c.startswith("manual_") or c.endswith("_image_file")}
    made = blank | {
        "main_category": main, "subcategory": sub, "page_label": label, "page_url": F.coalesce("page_url", F.lit("")), "product_name": F.coalesce("name", F.lit("Unnamed product")), "product_url": F.coalesce("product_url", F.lit("")),
        "status": by_decision(0, F.coalesce("status", F.lit(""))), "operator_decision": by_decision(1, F.lit("")), "consistency_score": python_fixed(F.coalesce("consistency_score", F.lit(0.0)), F.lit(2)),
        "problem_summary": by_decision(2, joined(F.col("issues"), "PASS — no issue detected"), joined(automatic, "No automatic issue text available")), "suggested_fix": by_decision(3, suggested_fix(F.col("issues"))),
        "profile": F.coalesce("profile", F.lit("")), "subtype": F.coalesce("subtype", F.lit("")), "comparison_group": F.coalesce("comparison_group", F.lit("")),
        "body_height_occupancy": six(m["body_height_occupancy"]), "body_width_occupancy": six(m["body_width_occupancy"]), "horizontal_center_offset": six(m["center_offset_x"]), "body_baseline_y": six(m["body_baseline_y"]),
        "full_edge_padding": six(m["min_edge_padding"]), "accessory_area_ratio": six(m["accessory_area_ratio"]), "component_count": F.coalesce(m["component_count"].cast("string"), F.lit("1")), "visual_report_section": F.concat_ws(" / ", main, sub, label),
    }
    return shown.select(*[made[c].alias(c) for c in AUDIT_COLUMNS])


def with_manual_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Audit rows with the edit (struct tuning) of their product_url, or else of their product_name; of several the last by ``seq``."""
    last = lambda key: edits.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max_by("tuning", "seq").alias(f"by_{key}"))
    found = rows.join(last("product_url"), "product_url", "left").join(last("product_name"), "product_name", "left").withColumn("t", F.coalesce("by_product_url", "by_product_name"))
    t, has = F.col("t"), F.col("t").isNotNull()
    signed = lambda c: F.concat(F.when(c >= 0, "+").otherwise(""), python_fixed(c, F.lit(4)))
    texts = {
        "manual_edit_applied": F.when(has, "Yes").otherwise("No"), "manual_zoom": F.concat(python_fixed(1.0 + t["scale_bias"], F.lit(3)), F.lit("x")), "manual_move_left_right": signed(t["x_nudge"]), "manual_move_up_down": signed(t["y_nudge"]),
        "manual_floor_line": signed(t["baseline_shift"]), **{f"manual_crop_{s}": python_fixed(t[f"crop_{s}"], F.lit(4)) for s in ("left", "right", "top", "bottom")}, "manual_body_mode": t["body_mode"], "manual_center_mode": t["anchor_mode"],
    }
    return found.select(*[F.coalesce(texts[c], F.lit("")).alias(c) if c in texts else F.col(c) for c in rows.columns])


@F.pandas_udf(StringType())
def folded_name(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC").str.casefold().str.strip()


def stable_id(product_url: Column, image_url: Column, page_url: Column, name: Column) -> Column:
    """64 hex digits of a record's first identity: its address, its image's, or its page and name."""
    product, image = canonical_http_url(product_url), canonical_http_url(image_url)
    named = F.concat(F.lit("page:"), canonical_http_url(page_url), F.lit("|name:"), folded_name(F.coalesce(name, F.lit(""))))
    seed = F.when(product != "", F.concat(F.lit("product_url:"), product)).when(image != "", F.concat(F.lit("image_url:"), image)).otherwise(named)
    return F.sha2(F.encode(seed, "UTF-8"), 256)


def page_identity() -> Column:
    label = lambda c: F.trim(casefold(F.coalesce(c, F.lit(""))))
    url = F.coalesce("page_url", F.lit(""))
    return F.struct(label("main_category").alias("main"), label("subcategory").alias("sub"), label("page_label").alias("page"), F.coalesce(F.nullif(canonical_http_url(url), F.lit("")), F.trim(casefold(url))).alias("url"))


def record_identity(image_url: Column | None = None) -> Column:
    """By address; without one by stable_id (32 digits). A name alone never identifies a product."""
    url = canonical_http_url(F.coalesce("product_url", F.lit("")))
    image = F.lit("") if image_url is None else image_url
    return F.when(url != "", F.struct(F.lit("url").alias("kind"), url.alias("key"))).otherwise(F.struct(F.lit("stable").alias("kind"), F.substring(stable_id(F.lit(""), image, F.col("page_url"), F.col("product_name")), 1, 32).alias("key")))


def dedupe_rows(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each product on its page, in the place of the first."""
    keyed = rows.withColumn("page_key", page_identity()).withColumn("record_key", record_identity())
    w = Window.partitionBy("page_key", "record_key")
    kept = keyed.withColumn("nth", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("slot", F.min(order).over(w)).filter("nth = 1")
    return kept.withColumn(order, F.col("slot")).drop("nth", "slot")


def upsert(stored: DataFrame, new: DataFrame, mode: str = "replace_page") -> tuple[DataFrame, DataFrame]:
    """The master table after new rows (both with ``seq``), and one row of counts: before, after, added, removed.
    replace_page: the pages of new rows are replaced; append: only products that no stored row has are added. No new rows
    change nothing. New rows come after the stored ones."""
    old, fresh = dedupe_rows(stored), dedupe_rows(new)
    if mode == "replace_page":
        kept = old.join(fresh.select("page_key").distinct(), "page_key", "left_anti")
    else:
        kept, fresh = old, fresh.join(old.select("page_key", "record_key"), ["page_key", "record_key"], "left_anti")
    both = kept.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = [count(x, n).withColumn("one", F.lit(1)) for x, n in ((old, "before"), (both, "after"), (fresh, "added"), (kept, "kept"))]
    stats = sizes[0].join(sizes[1], "one").join(sizes[2], "one").join(sizes[3], "one").select("before", "after", "added", (F.col("before") - F.col("kept")).alias("removed"))
    return both.drop("page_key", "record_key"), stats


def in_natural_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[natural_key(F.col(c)) for c in ("main_category", "subcategory", "page_label", "product_name")])


def export(rows: DataFrame, advanced: bool = True) -> DataFrame:
    """With the headings of the exports."""
    names = list(EXPORT_HEADINGS) if advanced else list(EXPORT_HEADINGS)[: list(EXPORT_HEADINGS).index("Subtype") + 1]
    return rows.select(*[F.col(EXPORT_HEADINGS[h]).alias(h) for h in names])


def hierarchy(rows: DataFrame) -> DataFrame:
    """Products for each main category, subcategory and page."""
    named = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)).alias(c)
    return rows.groupBy(named("main_category", "Uncategorized"), named("subcategory", "General"), named("page_label", "Page")).agg(F.count(F.lit(1)).alias("products"))


def for_export(flagged_only: bool, status: Column, decision: Column) -> Column:
    """Whether an item goes into a page's export: all, or those flagged or decided to be changed."""
    return F.lit(not flagged_only) | (F.coalesce(status, F.lit("")) != "pass") | F.coalesce(decision, F.lit("")).isin("use_fixed", "complete_rework")


def snapshot_summary(rows: DataFrame) -> DataFrame:
    """One row for audit rows: how many, how many with a manual edit, how many decided by an operator."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("manual_edit_applied") == "Yes").alias("manual_edits"), F.count_if(F.trim(F.coalesce("operator_decision", F.lit(""))) != "").alias("manual_decisions"))
