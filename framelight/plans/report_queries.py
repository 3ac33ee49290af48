"""Queries of totals, reports, overrides and drags over the catalogue, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.functions.fixed_values import CATEGORY_TERMS
from framelight.functions.urls import candidate_key
from framelight.operators.edits import load_remembered, remembered_drafts, reset_products, with_applied_edits
from framelight.operators.gate import gated
from framelight.operators.review import calibration, dragged_tuning, edit_history, exception_suggestions, should_normalize
from framelight.operators.scoring import corrections, page_summary, score_items
from framelight.operators.totals import (
    RECOVERED, detection_report, excluded_counts, excluded_everywhere, membership_totals, package_counts, page_counts, scans_summary, showcase_counts, showcase_manifest,
    showcase_shown,
)
from framelight.plans.catalog import CATALOG_SQL, analysed, catalog
from framelight.plans.queries import ORACLE_SQL, _CLEAN, _EVENT, ITEMS_SQL, SCORED_SQL, SCORES_SQL, _decided, query, settings

FORCED = 10  # every item whose number leaves this remainder by 11 was put back by an operator

# --- the gate as SQL: every item, whether it stays, and why not
_EVIDENCE = "CASE detected " + " ".join(
    f"WHEN '{c}' THEN array_to_string(list_filter([{', '.join(repr(t) for t in terms)}], lambda x: contains(t, replace(x, '-', ' '))), ', ')" for c, terms in CATEGORY_TERMS.items()
) + " END"
GATE_SQL = f"""
gate_catalog AS ({CATALOG_SQL}),
gate_texts AS (SELECT pos, {_CLEAN.format("name || ' ' || product_url || ' ' || image_url")} AS t FROM gate_catalog),
gate_scores AS ({SCORES_SQL.replace("FROM texts", "FROM gate_texts")}),
gate_same AS (SELECT pos FROM gate_scores WHERE category = 'Coffee machine'),
gate_other AS (SELECT pos, category AS detected, score AS detected_score, row_number() OVER (PARTITION BY pos ORDER BY score DESC, place) AS nth FROM gate_scores WHERE category <> 'Coffee machine'),
gate_second AS (SELECT o.pos, max(s.score) AS second FROM gate_other o JOIN gate_scores s ON o.pos = s.pos AND s.score <> o.detected_score WHERE o.nth = 1 GROUP BY o.pos),
gate AS (
  SELECT c.*, t.t, o.detected, o.detected_score, w.second, c.pos % 11 = {FORCED} AS forced, o.pos IS NULL OR s.pos IS NOT NULL OR c.pos % 11 = {FORCED} AS kept,
    CASE WHEN c.pos % 9 = 0 THEN '{RECOVERED}' ELSE 'dom_card' END AS membership
  FROM gate_catalog c JOIN gate_texts t USING (pos) LEFT JOIN gate_same s USING (pos) LEFT JOIN (SELECT * FROM gate_other WHERE nth = 1) o USING (pos) LEFT JOIN gate_second w USING (pos)),
gate_pages AS (
  SELECT page_id, count(*) AS raw_candidate_count, count(*) FILTER (kept) AS candidate_count, count(*) FILTER (NOT kept) AS filtered_out_count,
    count(*) FILTER (membership = '{RECOVERED}') AS recovered_membership_count, count(*) FILTER (forced) AS manual_included_count
  FROM gate GROUP BY page_id)"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("pos") % 9 == 0, RECOVERED).otherwise("dom_card").alias("page_membership_method")
    items = catalog(spark, sf_dir).select(
        "page_id", "pos", "name", "product_url", "image_url", F.lit("Coffee machine").alias("requested_category"), F.lit("").alias("page_context"),
        F.concat(F.lit("https://shop.example.com/"), "page_id").alias("page_url"), F.col("page_id").alias("page_label"), F.lit("dom").alias("source"), method,
    )
    forced = items.filter(F.col("pos") % 11 == FORCED)
    return gated(items, forced.select("page_id", candidate_key(F.col("product_url"), F.col("image_url"), F.col("name")).alias("override_key"), F.lit("Coffee machine").alias("category")))


@query(f"WITH {GATE_SQL} SELECT * FROM gate_pages")
def gate_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each page before and after a gate with products put back by hand, those left out and those recovered."""
    return page_counts(_gated(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, {GATE_SQL}, f AS (SELECT page_id, count(*) FILTER (len(issues) > 0) AS flagged FROM scored GROUP BY page_id)
SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(raw_candidate_count) AS BIGINT) AS scouted, CAST(sum(candidate_count) AS BIGINT) AS matched, CAST(sum(filtered_out_count) AS BIGINT) AS filtered, CAST(sum(flagged) AS BIGINT) AS issues
FROM gate_pages JOIN f USING (page_id)""")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: totals over all pages of candidates, matches, exclusions and flagged items."""
    flagged = page_summary(score_items(analysed(catalog(spark, sf_dir)))).select("page_id", "flagged_count")
    return scans_summary(page_counts(_gated(spark, sf_dir)).join(flagged, "page_id", "left"))


@query(f"""WITH {GATE_SQL}, p AS (SELECT *, CASE WHEN candidate_count % 3 <> 0 THEN raw_candidate_count - recovered_membership_count END AS dom, raw_candidate_count - candidate_count % 40 AS jsonld FROM gate_pages)
SELECT CAST(sum(coalesce(dom, candidate_count)) AS BIGINT) AS verified_total, CAST(sum(greatest(0, jsonld - coalesce(dom, 0))) AS BIGINT) AS structured_only_total, CAST(sum(recovered_membership_count) AS BIGINT) AS recovered_total FROM p""")
def membership_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified, structured-only and recovered products over all pages; a third of the pages do not tell how many were verified."""
    dom = F.when(F.col("candidate_count") % 3 != 0, F.col("raw_candidate_count") - F.col("recovered_membership_count"))
    pages = page_counts(_gated(spark, sf_dir)).withColumn("dom_verified_count", dom).withColumn("jsonld_discovered_count", F.col("raw_candidate_count") - F.col("candidate_count") % 40)
    return membership_totals(pages)


_REASON = f"""'Detected as ' || detected || ' while the audit category gate is Coffee machine. Evidence: ' || chr(39) || replace({_EVIDENCE}, ', ', chr(39) || ', ' || chr(39)) || chr(39) || '. No Coffee machine category phrase was found in the product name/URLs. This does not mean the website placed the product in the wrong collection; it only explains why the audit gate excluded it.'"""
_LEFT_OUT = f"""SELECT pos, '{{kind}}' AS source_kind, {{label}} AS page_label, 'https://shop.example.com/' || page_id AS page_url, name AS product_name, 'Coffee machine' AS expected_category, detected AS detected_category,
  CASE WHEN detected_score >= 5 AND detected_score - coalesce(second, 0) >= 2 THEN 'high' WHEN detected_score >= 3 THEN 'medium' ELSE 'low' END AS filter_confidence,
  CAST(detected_score AS VARCHAR) AS detected_category_score, {_EVIDENCE} AS matched_evidence, product_url, image_url, 'dom' AS source, membership AS page_membership_method, {_REASON} AS filter_reason FROM gate WHERE NOT kept"""


@query(f"WITH {GATE_SQL} SELECT * EXCLUDE (pos) FROM ({_LEFT_OUT.format(kind='Detection Test', label=repr('Latest Detection Test'))} UNION ALL {_LEFT_OUT.format(kind='Advanced Audit', label='page_id')})")
def excluded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate left out, of a detection scan and of an audit of the same listings."""
    items = _gated(spark, sf_dir)
    return excluded_everywhere(items, items)


_LISTED = f"""SELECT * EXCLUDE (pos) FROM ({_LEFT_OUT.format(kind='Detection Test', label=repr('Latest Detection Test'))} UNION ALL {_LEFT_OUT.format(kind='Advanced Audit', label='page_id')})"""
_BY = {"all": ("CAST(NULL AS VARCHAR)", "''"), "scan": ("CAST(NULL AS VARCHAR)", "source_kind"), "page": ("source_kind", "page_label"), "category": ("CAST(NULL AS VARCHAR)", "detected_category"), "confidence": ("CAST(NULL AS VARCHAR)", "filter_confidence")}


@query(f"""WITH {GATE_SQL}, l AS ({_LISTED}), c AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, {scan} AS scan, {value} AS value, count(*) AS n FROM l GROUP BY ALL" for d, (scan, value) in _BY.items())})
SELECT dimension, scan, value, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value, scan NULLS FIRST) AS INTEGER) AS place FROM c""")
def excluded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions by scan, page, category and confidence, from the filtered rows, in one pass."""
    items = _gated(spark, sf_dir)
    return excluded_counts(excluded_everywhere(items, items))


@query(f"""WITH {SCORED_SQL} SELECT name, image_url, product_url, profile, subtype, CASE WHEN len(issues) > 0 THEN 'review' ELSE 'pass' END AS status, format('{{:.6f}}', height_occupancy) AS height_occupancy, format('{{:.6f}}', width_occupancy) AS width_occupancy,
format('{{:.6f}}', abs(center_x - 0.5)) AS horizontal_center_offset, format('{{:.6f}}', top_padding) AS top_padding, format('{{:.6f}}', bottom_padding) AS bottom_padding, format('{{:.6f}}', accessory_area_ratio) AS accessory_area_ratio,
CAST(n_components AS VARCHAR) AS component_count, array_to_string(issues, ' | ') AS issues, format('{{:.6f}}', ratio) AS scale_ratio_to_family_median, format('{{:.2f}}', score) AS consistency_score, comparison_group FROM scored""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the report of a scan, numbers as text."""
    return detection_report(score_items(analysed(catalog(spark, sf_dir))))


_SHOWN = f"SELECT *, d IS DISTINCT FROM 'keep_original' AND (coalesce(d IN ('use_fixed', 'complete_rework'), false) OR len(issues) > 0) AS chosen FROM scored LEFT JOIN (SELECT user_id % 3000 AS pos, arg_max({_EVENT}, event_id) AS d FROM events GROUP BY 1) USING (pos)"
_CHANGED = f"showcase AS (SELECT *, chosen AND pos % 50 <> 0 AS changed, chosen AND pos % 50 = 0 AS failed FROM ({_SHOWN}))"


def _showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a showcase would correct, of which one in fifty fails."""
    items = _decided(spark, sf_dir)
    chosen, fails = should_normalize(F.lit("flagged"), F.col("status"), F.col("operator_decision"), F.lit(False)), F.col("pos") % 50 == 0
    return items.withColumn("changed", chosen & ~fails).withColumn("normalization_error", F.when(chosen & fails, "no foreground"))


@query(f"WITH {SCORED_SQL}, {_CHANGED} SELECT count(*) AS products, count(*) FILTER (changed) AS replaced, count(*) FILTER (NOT changed) AS unchanged, count(*) FILTER (failed) AS errors FROM showcase")
def showcase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced, unchanged and failed items of a showcase of what is flagged or decided upon."""
    return showcase_counts(_showcase(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, {_CHANGED} SELECT page_id, name AS product_name, 'corrected' AS status_in_showcase, profile, subtype, image_url AS source_image_url, product_url,
'showcase_images/' || name || CASE WHEN nth > 1 THEN '__' || nth ELSE '' END || '.png' AS showcase_file FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY pos) AS nth FROM showcase WHERE changed)""")
def showcase_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a showcase of changed items only."""
    columns = "page_id", "pos", "name", "profile", "subtype", "image_url", "product_url", "changed", "normalization_error"
    return showcase_manifest(showcase_shown(_showcase(spark, sf_dir).select(*columns), changed_only=True))


@query(f"""WITH {SCORED_SQL}, {_CHANGED} SELECT count(*) AS products, count(*) FILTER (CASE WHEN d IN ('keep_original', 'use_fixed') THEN false WHEN d = 'complete_rework' THEN true ELSE len(issues) > 0 END) AS needs_review,
count(*) FILTER (CASE WHEN d IN ('keep_original', 'use_fixed') THEN true WHEN d = 'complete_rework' THEN false ELSE len(issues) = 0 END) AS passed, count(*) FILTER (changed) AS generated_fixes, count(*) FILTER (d = 'complete_rework') AS complete_rework,
count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen AND NOT failed) AS successes, count(*) FILTER (failed) AS failures, true AS flagged_only FROM showcase""")
def package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a review package and of an export of the items that a showcase corrects."""
    counts = package_counts(_showcase(spark, sf_dir), True)
    return counts.select("flagged_only", *[c for c in counts.columns if c != "flagged_only"])


@query(f"""WITH {SCORED_SQL}, cal_rows AS (SELECT page_id, own_key, profile, CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN height_occupancy ELSE width_occupancy END AS side, baseline_y AS b FROM grouped),
cal_groups AS (SELECT page_id, own_key, profile, list_sort(list(side))[count(*) // 2 + 1] AS side, list_sort(list(b))[count(*) // 2 + 1] AS b FROM cal_rows GROUP BY ALL HAVING count(*) >= 2),
cal AS (SELECT page_id, own_key, CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN greatest(0.40, least(0.90, format('{{:.4f}}', side)::DOUBLE)) ELSE greatest(0.38, least(0.92, format('{{:.4f}}', side)::DOUBLE)) END AS own_target,
  CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN greatest(0.68, least(0.97, format('{{:.4f}}', b)::DOUBLE)) END AS own_line FROM cal_groups),
merged AS (SELECT p.* EXCLUDE (g_target, g_other, g_alignment, g_baseline), own_target IS NOT NULL AS overridden, coalesce(own_target, g_target) AS g_target, CASE WHEN own_target IS NULL THEN g_other ELSE b_other END AS g_other,
  CASE WHEN own_target IS NULL THEN g_alignment ELSE b_alignment END AS g_alignment, CASE WHEN own_target IS NULL THEN g_baseline ELSE coalesce(own_line, b_baseline, g_baseline) END AS g_baseline FROM placed p LEFT JOIN cal USING (page_id, own_key))
SELECT page_id, pos, overridden, anchor, round(CASE WHEN g_axis = 'height' THEN least(g_target / card_h, g_other / card_w) ELSE least(g_target / card_w, g_other / card_h) END, 6) AS scale,
round(0.5 - CASE WHEN anchor = 'full_center' THEN full_x ELSE card_x END, 6) AS x_shift, round(CASE WHEN anchor = 'primary' AND g_alignment = 'bottom_center' THEN coalesce(g_baseline, CAST(0.89 AS DOUBLE)) - card_line WHEN anchor = 'full_center' THEN 0.5 - full_y ELSE 0.5 - card_y END, 6) AS y_shift FROM merged""")
def strict_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections in strict mode, where each page's own groups set the standard."""
    items = analysed(catalog(spark, sf_dir))
    fix = F.col("fix")
    return corrections(items, calibration(items)).select("page_id", "pos", "overridden", fix["anchor"].alias("anchor"), *[F.round(fix[c], 6).alias(c) for c in ("scale", "x_shift", "y_shift")])


_DRAG = """SELECT p_partkey AS pos, (p_partkey % 20 - 6) / 25.0::DOUBLE AS bias, (p_partkey % 7 - 3) / 100.0::DOUBLE AS everywhere, (p_partkey % 13 - 6) / 40.0::DOUBLE AS x_nudge, (p_partkey % 11 - 5) / 40.0::DOUBLE AS y_nudge,
(p_partkey % 30) / 100.0::DOUBLE AS x, (p_partkey % 23) / 100.0::DOUBLE AS y, (p_partkey % 5) / 8.0::DOUBLE AS w, (p_partkey % 6) / 8.0::DOUBLE AS h,
(p_partkey % 31) / 100.0::DOUBLE AS to_x, (p_partkey % 27) / 100.0::DOUBLE AS to_y, (p_partkey % 5 + p_partkey % 3) / 8.0::DOUBLE AS to_w, (p_partkey % 6 + p_partkey % 4) / 8.0::DOUBLE AS to_h FROM {part}"""


@query(f"""WITH d AS ({_DRAG.replace("{part}", "part")}), s AS (SELECT *, greatest(w, 1e-6) AS bw, greatest(h, 1e-6) AS bh FROM d)
SELECT pos, round(greatest(-0.45, least(0.60, (1 + everywhere + bias) * greatest(0.25, least(4.0, (to_w / bw + to_h / bh) / 2)) - 1 - everywhere)), 8) + 0.0 AS scale_bias,
round(greatest(-0.30, least(0.30, x_nudge + to_x + to_w / 2 - x - bw / 2)), 8) + 0.0 AS x_nudge, round(greatest(-0.30, least(0.30, y_nudge + to_y + to_h / 2 - y - bh / 2)), 8) + 0.0 AS y_nudge FROM s""")
def dragged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunings after their boxes were dragged, some of them from boxes without a side."""
    rows = spark.sql(_DRAG.replace("0::DOUBLE", "0D"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    none = [F.lit(0.0).alias(k) for k in ("baseline_shift", "crop_left", "crop_right", "crop_top", "crop_bottom")]
    tuning = F.struct(F.lit("auto").alias("body_mode"), F.lit("auto").alias("anchor_mode"), F.col("bias").alias("scale_bias"), "x_nudge", "y_nudge", *none)
    box = lambda p: F.struct(*[F.col(p + k).alias(k) for k in "xywh"])
    after = rows.select("pos", dragged_tuning(tuning, F.struct(F.col("everywhere").alias("scale_bias")), box(""), box("to_")).alias("t"))
    return after.select("pos", *[(F.round(F.col("t")[k], 8) + F.lit(0.0)).alias(k) for k in ("scale_bias", "x_nudge", "y_nudge")])


_EDITS = """SELECT p_partkey AS product_key, n AS seq, CASE WHEN (p_partkey + n) % 5 = 0 THEN NULL WHEN (p_partkey + n) % 5 = 1 THEN '' ELSE concat('edit', p_partkey, '.', n) END AS image,
p_partkey * 10 + n AS metrics, CASE WHEN n = 2 THEN 'single' END AS subtype FROM {part} CROSS JOIN (VALUES (1), (2), (3)) AS v(n) WHERE n <= p_partkey % 4"""
_SHOWN = """SELECT p_partkey AS product_key, CASE p_partkey % 7 WHEN 0 THEN 'keep_original' WHEN 1 THEN 'complete_rework' WHEN 2 THEN 'generate_fix' END AS operator_decision,
CASE WHEN p_partkey % 3 = 0 THEN concat('made', p_partkey) END AS image, p_partkey % 3 = 0 AS changed, -1 AS metrics, 'multi' AS subtype FROM {part}"""


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY seq DESC) AS nth FROM ({_EDITS.replace("{part}", "part")})), s AS ({_SHOWN.replace("{part}", "part")}),
j AS (SELECT s.*, e.image AS e_image, e.metrics AS e_metrics, e.subtype AS e_subtype, coalesce(e.image <> '', false) AND coalesce(operator_decision NOT IN ('keep_original', 'complete_rework'), true) AS wins FROM s LEFT JOIN e ON s.product_key = e.product_key AND nth = 1)
SELECT product_key, CASE WHEN wins THEN e_image ELSE image END AS image, CASE WHEN wins THEN e_metrics ELSE metrics END AS metrics, CASE WHEN wins THEN e_subtype ELSE subtype END AS subtype, wins OR changed AS changed FROM j""")
def applied_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Showcase items after edits: none, one or up to three of a product, some without an image."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return with_applied_edits(spark.sql(_SHOWN, part=part), spark.sql(_EDITS, part=part)).drop("operator_decision")


@query(f"""WITH best AS (SELECT item_id, identity FROM ({ORACLE_SQL["remembered_settings"]}) WHERE "rank" = 1)
SELECT c_custkey AS product_key, c_custkey % 4 IN (0, 1) AND c_custkey % 6 <> 0 AS overridden, (c_custkey % 6 = 0)::INT + (item_id IS NOT NULL)::INT AS revision,
CASE WHEN item_id IS NOT NULL THEN identity / 100000.0::DOUBLE ELSE 0.0 END AS scale_bias,
1 + (c_custkey % 6 = 0)::INT + (item_id IS NOT NULL AND NOT (c_custkey % 6 = 0 AND identity = 0))::INT AS states FROM customer LEFT JOIN best ON c_custkey = item_id""")
def resets_and_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth product is reset, then each loads its best remembered tuning as a draft: overrides, newest state, length of history.

    A draft that is what the reset shows already (bias 0) adds no state."""
    items, library = settings(spark, sf_dir)
    keys = items.select(F.col("item_id").alias("product_key"))
    tuning = lambda bias: F.expr(f"named_struct('body_mode', 'auto', 'anchor_mode', 'auto', 'scale_bias', CAST({bias} AS DOUBLE), 'x_nudge', 0D, 'y_nudge', 0D, 'baseline_shift', 0D, 'crop_left', 0D, 'crop_right', 0D, 'crop_top', 0D, 'crop_bottom', 0D)")
    overrides = keys.filter("product_key % 4 IN (0, 1)").withColumn("override", tuning("0.5"))
    ops = keys.select("product_key", F.lit(1).alias("seq"), F.lit("record").alias("op"), tuning("-1").alias("state"))
    none = keys.filter("false").withColumn("revision", F.lit(0))
    overrides, _, ops, revisions = reset_products(keys.filter("product_key % 6 = 0"), overrides, overrides, ops, none)
    drafts = remembered_drafts(exception_suggestions(items, library), library.withColumn("override", tuning("CAST(identity AS INT) / 100000D")))
    ops, revisions = load_remembered(drafts, ops, revisions)
    newest = F.get(F.col("states"), F.col("index"))["scale_bias"]
    shown = edit_history(ops).select("product_key", F.when(newest < 0, 0.0).otherwise(newest).alias("scale_bias"), F.size("states").alias("states"))
    flags = keys.join(overrides.select("product_key", F.lit(True).alias("overridden")), "product_key", "left").join(revisions, "product_key", "left").join(shown, "product_key")
    return flags.select("product_key", F.coalesce("overridden", F.lit(False)).alias("overridden"), F.coalesce("revision", F.lit(0)).cast("int").alias("revision"), "scale_bias", "states")
