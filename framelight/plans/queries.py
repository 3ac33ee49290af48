"""Queries over the driver's tables, one or more for each group of operators, and DuckDB SQL for them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelight.functions.fixed_values import CATEGORY_ANCHOR, CATEGORY_PROFILE, CATEGORY_STANDARDS, CATEGORY_TERMS, PROFILES
from framelight.operators.gate import dedupe_candidates, gated
from framelight.operators.audit import FIXES, OTHER_FIX, audit_rows, decide, export, hierarchy, issue_level, latest_decisions, snapshot_summary, suggested_fix, upsert
from framelight.operators.review import calibration, edit_history, exception_suggestions, number_pages, unique_names
from framelight.operators.scoring import audit_against_peers, page_summary, scale_limits, score_items, score_single
from framelight.functions.urls import canonical_http_url, canonical_listing_url, is_paginated, is_public_literal, page_number
from framelight.plans.catalog import CATALOG_SQL, analysed, catalog

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL of categories, from the same fixed phrases
_CLEAN = "trim(regexp_replace(regexp_replace(translate(lower({0}), '_-', '  '), '[^a-z0-9+/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _points(category: str, terms: list[str]) -> str:
    plain = [t.replace("-", " ") for t in terms]
    total = " + ".join(f"CASE WHEN contains(t, '{p}') THEN {max(2, len(p.split()))} ELSE 0 END" for p in plain)
    return f"CASE WHEN contains(t, 'microwave') OR contains(t, 'micro wave') THEN 0 ELSE {total} END" if category == "Oven" else total


SCORES_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT pos, '{c}' AS category, {i} AS place, {_points(c, t)} AS score FROM texts" for i, (c, t) in enumerate(CATEGORY_TERMS.items())) + ") WHERE score > 0"

ITEMS_SQL = f"""
catalog AS ({CATALOG_SQL}),
texts AS (SELECT pos, {_CLEAN.format("name || ' | ' || product_url")} AS t FROM catalog),
scores AS ({SCORES_SQL}),
ranked AS (SELECT pos, category, score, row_number() OVER (PARTITION BY pos ORDER BY score DESC, place) AS nth, lead(score) OVER (PARTITION BY pos ORDER BY score DESC, place) AS second FROM scores),
best AS (SELECT pos, category FROM ranked WHERE nth = 1 AND (second IS NULL OR score >= second + 1)),
kinds AS (
  SELECT c.*, b.category AS item_category, greatest(x2 - x1, 1) AS bw, greatest(y2 - y1, 1) AS bh,
    CASE WHEN n_structural >= 2 THEN 'multipart' WHEN accessory_area_ratio >= 0.10 AND n_components >= 2 THEN 'accessory_heavy' WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 0.62 THEN 'tall_standing'
         WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) > 3.0 THEN 'flat_horizontal' WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) > 1.55 THEN 'wide' WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 0.82 THEN 'portrait_boxy' ELSE 'boxy' END AS subtype,
    CASE WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 0.68 THEN 'tall' WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 1.30 THEN 'boxy' WHEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) < 3.10 THEN 'wide' ELSE 'flat' END AS shape
  FROM catalog c LEFT JOIN best b USING (pos)),
items AS (
  SELECT *, CASE WHEN item_category = 'Vacuum cleaner' AND subtype IN ('boxy', 'portrait_boxy', 'accessory_heavy', 'multipart') THEN 'boxy' WHEN subtype = 'tall_standing' THEN 'tall' WHEN subtype = 'flat_horizontal' THEN 'flat' WHEN subtype = 'wide' THEN 'wide'
                 WHEN subtype = 'multipart' THEN shape ELSE coalesce(CASE item_category {" ".join(f"WHEN '{c}' THEN '{p}'" for c, p in CATEGORY_PROFILE.items())} END, shape) END AS profile,
    CASE WHEN item_category = 'Vacuum cleaner' THEN CASE WHEN contains(lower(name), 'robot vacuum') AND contains(lower(name), 'omni') THEN 'robot_vacuum_station' WHEN contains(lower(name), 'robot vacuum') THEN 'robot_vacuum' WHEN contains(lower(name), 'cordless') THEN 'cordless_floorcare' ELSE 'default' END
         WHEN item_category = 'Hood' THEN CASE WHEN contains(lower(name), 'chimney') THEN 'chimney_hood' ELSE 'hood' END ELSE 'default' END AS archetype
  FROM kinds),
grouped AS (SELECT *, coalesce(item_category, 'Generic') || '::' || archetype || '::' || profile AS wide_key, coalesce(item_category, 'Generic') || '::' || archetype || '::' || profile || '::' || subtype AS own_key,
  CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN height_occupancy ELSE width_occupancy END AS scale, CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN baseline_y ELSE center_y END AS line FROM items),
own AS (SELECT page_id, own_key, median(scale) AS own_scale, median(line) AS own_line, count(*) AS own_n FROM grouped GROUP BY ALL),
wide AS (SELECT page_id, wide_key, median(scale) AS wide_scale, median(line) AS wide_line, count(*) AS wide_n FROM grouped GROUP BY ALL),
peers AS (SELECT g.*, CASE WHEN own_n >= 2 THEN own_scale ELSE wide_scale END AS scale_median, CASE WHEN own_n >= 2 THEN own_line ELSE wide_line END AS align_median, CASE WHEN own_n >= 2 THEN own_n ELSE wide_n END AS n,
  CASE WHEN own_n >= 2 THEN own_key ELSE 'profile::' || wide_key END AS comparison_group FROM grouped g JOIN own USING (page_id, own_key) JOIN wide USING (page_id, wide_key))
"""


@query(f"""WITH {ITEMS_SQL}, compared AS (SELECT *, scale / greatest(scale_median, 1e-6) AS ratio, n >= 2 AND abs(line - align_median) > 0.055 AS off_line FROM peers),
zoomed AS (SELECT *, CASE WHEN n >= 2 AND ratio < 1.0 - 0.18 THEN 'zoomed out' WHEN n >= 2 AND ratio > 1.0 + 0.18 THEN 'zoomed in' ELSE '' END AS zoom FROM compared),
told AS (SELECT *, list_filter([CASE WHEN suspect THEN 'Foreground detection looks unreliable' END,
  CASE zoom WHEN 'zoomed out' THEN format('Primary body looks too zoomed out ({{:.0f}}% smaller than subgroup median)', abs(1 - ratio) * 100) WHEN 'zoomed in' THEN format('Primary body looks too zoomed in ({{:.0f}}% larger than subgroup median)', abs(ratio - 1) * 100) END,
  CASE WHEN off_line THEN CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN 'Primary-body baseline does not match comparable products' ELSE 'Primary-body vertical centering does not match comparable products' END END], lambda x: x IS NOT NULL) AS found FROM zoomed),
pages AS (SELECT page_id, count(*) AS analyzed, count(*) FILTER (len(found) > 0) AS flagged FROM told GROUP BY page_id)
SELECT page_id, pos, comparison_group, round(ratio, 6) AS scale_ratio, n AS peer_count, zoom, off_line, array_to_string(found, ' | ') AS issues, CASE WHEN len(found) > 0 THEN 'review' ELSE 'pass' END AS status,
CAST(analyzed AS BIGINT) AS analyzed_count, CAST(flagged AS BIGINT) AS flagged_count, CAST(0 AS BIGINT) AS failed_count, 'success' AS scan_status, 100.0::DOUBLE * (analyzed - flagged) / analyzed AS page_score, 'full' AS confidence FROM told JOIN pages USING (page_id)""")
def peer_baseline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the medians of its peers: what is out of scale or off the line, its status, and the summary of its page."""
    rows, peer = audit_against_peers(analysed(catalog(spark, sf_dir))), F.col("peer")
    ratio, (low, high) = F.col("scale_ratio"), scale_limits(0.18)
    zoom = F.when((peer["count"] >= 2) & (ratio < low), "zoomed out").when((peer["count"] >= 2) & (ratio > high), "zoomed in").otherwise("")
    off_line = (peer["count"] >= 2) & (F.abs(peer["line"] - peer["align_median"]) > 0.055)
    page = "analyzed_count", "flagged_count", "failed_count", "scan_status", "page_score", "confidence"
    return rows.select("page_id", "pos", peer["group"].alias("comparison_group"), F.round(ratio, 6).alias("scale_ratio"), peer["count"].alias("peer_count"), zoom.alias("zoom"), off_line.alias("off_line"), F.array_join("issues", " | ").alias("issues"), "status", *page)


@query(f"WITH {ITEMS_SQL} SELECT pos, item_category, archetype AS item_archetype, subtype, profile FROM items")
def item_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, archetype, subtype and profile of each item."""
    return analysed(catalog(spark, sf_dir)).select("pos", "item_category", "item_archetype", "subtype", "profile")


# --- the gate, for a coffee machine listing
@query(f"""WITH catalog AS ({CATALOG_SQL}), texts AS (SELECT pos, {_CLEAN.format("name || ' ' || product_url || ' ' || image_url")} AS t FROM catalog), scores AS ({SCORES_SQL}),
same AS (SELECT pos FROM scores WHERE category = 'Coffee machine'),
other AS (SELECT pos, category, score, row_number() OVER (PARTITION BY pos ORDER BY score DESC, place) AS nth FROM scores WHERE category <> 'Coffee machine'),
worst AS (SELECT o.pos, max(s.score) AS second FROM other o JOIN scores s ON o.pos = s.pos AND s.score <> o.score WHERE o.nth = 1 GROUP BY o.pos)
SELECT c.pos, NOT (o.pos IS NOT NULL AND same.pos IS NULL) AS kept, CASE WHEN same.pos IS NULL THEN o.category END AS detected_category, CASE WHEN same.pos IS NULL THEN o.score END AS detected_category_score,
  CASE WHEN same.pos IS NULL AND o.pos IS NOT NULL THEN CASE WHEN o.score >= 5 AND o.score - coalesce(w.second, 0) >= 2 THEN 'high' WHEN o.score >= 3 THEN 'medium' ELSE 'low' END END AS filter_confidence
FROM catalog c LEFT JOIN same USING (pos) LEFT JOIN (SELECT * FROM other WHERE nth = 1) o USING (pos) LEFT JOIN worst w USING (pos)""")
def category_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and excluded items of a listing that is asked for coffee machines."""
    items = catalog(spark, sf_dir).select("page_id", "pos", "name", "product_url", "image_url", F.lit("Coffee machine").alias("requested_category"), F.lit("").alias("page_context"))
    return gated(items).select("pos", "kept", "detected_category", "detected_category_score", "filter_confidence")


@query(f"""WITH catalog AS ({CATALOG_SQL}), texts AS (SELECT pos, {_CLEAN.format("name || ' ' || product_url || ' ' || image_url")} AS t FROM catalog), scores AS ({SCORES_SQL}),
same AS (SELECT pos FROM scores WHERE category = 'Coffee machine'),
other AS (SELECT pos, category, score, row_number() OVER (PARTITION BY pos ORDER BY score DESC, place) AS nth FROM scores WHERE category <> 'Coffee machine')
SELECT category AS detected_category, count(*) AS excluded FROM other o ANTI JOIN same USING (pos) WHERE nth = 1 GROUP BY category""")
def excluded_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items the gate excluded, by what they are."""
    items = catalog(spark, sf_dir).select("page_id", "pos", "name", "product_url", "image_url", F.lit("Coffee machine").alias("requested_category"), F.lit("").alias("page_context"))
    return gated(items).filter(~F.col("kept")).groupBy("detected_category").agg(F.count(F.lit(1)).alias("excluded"))


@query(f"""WITH c AS (SELECT page_id, pos, lower(image_url) AS k, (pos % 5 <> 0)::INT AS better FROM ({CATALOG_SQL})),
r AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, k ORDER BY better DESC, pos) AS nth, min(pos) OVER (PARTITION BY page_id, k) AS slot FROM c),
k AS (SELECT page_id, slot, pos AS source_pos, row_number() OVER (PARTITION BY page_id ORDER BY slot) AS nth FROM r WHERE nth = 1)
SELECT page_id, slot AS pos, source_pos FROM k WHERE nth <= 40""")
def deduped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each image of a page, the first 40 of each page."""
    rows = catalog(spark, sf_dir).select("page_id", "pos", "image_url", F.lit(None).cast("string").alias("product_url"), F.when(F.col("pos") % 5 == 0, "Unnamed product").otherwise(F.col("name")).alias("name"), F.col("pos").alias("source_pos"))
    return dedupe_candidates(rows, 40).select("page_id", "pos", "source_pos")


# --- scores: standards as SQL of the same fixed values
def _case(column: str, rows: dict, field: str) -> str:
    value = lambda p: "NULL" if p.get(field) is None else f"'{p[field]}'" if isinstance(p[field], str) else f"CAST({p[field]} AS DOUBLE)"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {value(p)}" for k, p in rows.items()) + " END"


def _flat(p: dict) -> dict:
    axis = "height" if "target_height" in p else "width"
    return {"axis": axis, "target": p[f"target_{axis}"], "other": p["max_width" if axis == "height" else "max_height"], "alignment": p["alignment"], "baseline": p.get("baseline")}


_BASE, _OWN = {k: _flat(p) for k, p in PROFILES.items()}, {k: _flat(p) for k, p in CATEGORY_STANDARDS.items()}
_SHAPED = {"tall_standing": "tall", "flat_horizontal": "flat", "wide": "wide"}
SCORED_SQL = f"""{ITEMS_SQL},
standards AS (SELECT *, {", ".join(f"{_case('profile', _BASE, f)} AS b_{f}" for f in _BASE['tall'])}, {", ".join(f"{_case('item_category', _OWN, f)} AS o_{f}" for f in _BASE['tall'])} FROM peers),
own_standard AS (SELECT *, b_axis AS g_axis, CASE WHEN o_axis = b_axis THEN o_target ELSE b_target END AS g_target, CASE WHEN o_axis = b_axis THEN o_other ELSE b_other END AS g_other,
  CASE WHEN o_axis = b_axis THEN o_alignment ELSE b_alignment END AS g_alignment, CASE WHEN o_axis = b_axis THEN coalesce(o_baseline, b_baseline) ELSE b_baseline END AS g_baseline FROM standards),
goals AS (SELECT * EXCLUDE (g_axis, g_target, g_other, g_alignment, g_baseline),
  CASE subtype WHEN 'tall_standing' THEN 'height' WHEN 'flat_horizontal' THEN 'width' WHEN 'wide' THEN 'width' ELSE g_axis END AS g_axis,
  CASE subtype WHEN 'multipart' THEN CASE WHEN g_axis = 'height' THEN CAST(0.82 AS DOUBLE) ELSE CAST(0.84 AS DOUBLE) END {" ".join(f"WHEN '{s}' THEN CAST({_BASE[p]['target']} AS DOUBLE)" for s, p in _SHAPED.items())} ELSE g_target END AS g_target,
  CASE subtype WHEN 'accessory_heavy' THEN CASE WHEN g_axis = 'height' THEN greatest(g_other, CAST(0.84 AS DOUBLE)) ELSE g_other END WHEN 'multipart' THEN CASE WHEN g_axis = 'height' THEN greatest(g_other, CAST(0.86 AS DOUBLE)) ELSE greatest(g_other, CAST(0.80 AS DOUBLE)) END
    {" ".join(f"WHEN '{s}' THEN CAST({_BASE[p]['other']} AS DOUBLE)" for s, p in _SHAPED.items())} ELSE g_other END AS g_other,
  CASE subtype WHEN 'multipart' THEN 'center' {" ".join(f"WHEN '{s}' THEN '{_BASE[p]['alignment']}'" for s, p in _SHAPED.items())} ELSE g_alignment END AS g_alignment,
  CASE subtype WHEN 'tall_standing' THEN CAST(0.91 AS DOUBLE) WHEN 'flat_horizontal' THEN NULL WHEN 'wide' THEN NULL ELSE g_baseline END AS g_baseline FROM own_standard),
cards AS (SELECT *, image_width / greatest(image_width, image_height)::DOUBLE AS sx, image_height / greatest(image_width, image_height)::DOUBLE AS sy FROM goals),
placed AS (SELECT *, width_occupancy * sx AS card_w, height_occupancy * sy AS card_h, (1 - sx) / 2 + center_x * sx AS card_x, (1 - sy) / 2 + center_y * sy AS card_y, (1 - sy) / 2 + baseline_y * sy AS card_line, (1 - sx) / 2 + left_padding * sx + width_occupancy * sx / 2 AS full_x, (1 - sy) / 2 + top_padding * sy + height_occupancy * sy / 2 AS full_y,
  CASE WHEN subtype = 'multipart' THEN 'full_center' WHEN accessory_area_ratio >= 0.08 OR subtype = 'accessory_heavy' THEN 'primary' ELSE
    coalesce(CASE item_category {" ".join(f"WHEN '{c}' THEN '{m}'" for c, m in CATEGORY_ANCHOR.items())} END, CASE WHEN subtype IN ('flat_horizontal', 'wide') THEN 'full_center' ELSE 'primary' END) END AS anchor FROM cards),
fixes AS (SELECT *, CASE WHEN g_axis = 'height' THEN least(g_target / card_h, g_other / card_w) ELSE least(g_target / card_w, g_other / card_h) END AS fix_scale, 0.5 - CASE WHEN anchor = 'full_center' THEN full_x ELSE card_x END AS x_shift,
  CASE WHEN anchor = 'primary' AND g_alignment = 'bottom_center' THEN coalesce(g_baseline, CAST(0.89 AS DOUBLE)) - card_line WHEN anchor = 'full_center' THEN 0.5 - full_y ELSE 0.5 - card_y END AS y_shift,
  (CASE WHEN g_axis = 'height' THEN height_occupancy ELSE width_occupancy END) / g_target AS frame_ratio, CASE WHEN subtype IN ('accessory_heavy', 'multipart') THEN CAST(0.23 AS DOUBLE) + CAST(0.07 AS DOUBLE) ELSE CAST(0.23 AS DOUBLE) END AS tolerance,
  CASE WHEN g_alignment = 'bottom_center' THEN abs(baseline_y - coalesce(g_baseline, CAST(0.89 AS DOUBLE))) ELSE abs(center_y - 0.5) END AS frame_delta, scale / greatest(scale_median, 1e-6) AS ratio,
  least(left_padding, right_padding, top_padding, bottom_padding) AS edge, abs(center_x - 0.5) AS off_x FROM placed),
flags AS (SELECT *, n >= 2 AND (ratio < 1.0 - 0.18 OR ratio > 1.0 + 0.18) AS f_zoom, n >= 2 AND abs(line - align_median) > 0.055 AS f_line, NOT suspect AND (frame_ratio < 1.0 - tolerance OR frame_ratio > 1.0 + tolerance) AS f_size,
  NOT suspect AND frame_delta > greatest(0.085, 0.055 * 1.55) AS f_frame, NOT suspect AND (fix_scale > 1.055 OR fix_scale < 0.945) AS f_fix FROM fixes),
scored AS (SELECT *, list_filter([
  CASE WHEN suspect THEN 'Foreground detection looks unreliable' END,
  CASE WHEN f_zoom AND ratio < 1 THEN format('Primary body looks too zoomed out ({{:.0f}}% smaller than subgroup median)', abs(1 - ratio) * 100) WHEN f_zoom THEN format('Primary body looks too zoomed in ({{:.0f}}% larger than subgroup median)', abs(ratio - 1) * 100) END,
  CASE WHEN f_line THEN CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN 'Primary-body baseline does not match comparable products' ELSE 'Primary-body vertical centering does not match comparable products' END END,
  CASE WHEN f_size AND NOT f_zoom THEN CASE WHEN frame_ratio < 1 THEN format('Primary body is clearly too small for the expected {{}} framing standard ({{:.0f}}% below expected size)', profile, abs(1 - frame_ratio) * 100)
    ELSE format('Primary body is clearly too large for the expected {{}} framing standard ({{:.0f}}% above expected size)', profile, abs(frame_ratio - 1) * 100) END END,
  CASE WHEN f_frame AND NOT f_line THEN CASE WHEN g_alignment = 'bottom_center' THEN 'Primary-body baseline is clearly outside the expected framing range' ELSE 'Primary-body vertical centering is clearly outside the expected framing range' END END,
  CASE WHEN f_fix AND NOT f_zoom AND NOT f_size THEN CASE WHEN fix_scale > 1 THEN format('Normalizer would visibly enlarge this product by about {{:.0f}}%; the source framing is too small on the catalog card', (fix_scale - 1) * 100)
    ELSE format('Normalizer would visibly reduce this product by about {{:.0f}}%; the source framing is too large on the catalog card', (1 - fix_scale) * 100) END END,
  CASE WHEN NOT suspect AND abs(x_shift) > 0.028 THEN format('Normalizer would move the product {{}} by about {{:.1f}}% of the card width', CASE WHEN x_shift > 0 THEN 'right' ELSE 'left' END, abs(x_shift) * 100) END,
  CASE WHEN NOT suspect AND abs(y_shift) > 0.028 AND NOT f_line AND NOT f_frame THEN format('Normalizer would move the product {{}} by about {{:.1f}}% of the card height to correct its {{}}', CASE WHEN y_shift > 0 THEN 'down' ELSE 'up' END, abs(y_shift) * 100,
    CASE WHEN anchor = 'visual_center' THEN 'visual mass center' WHEN anchor = 'primary' AND g_alignment = 'bottom_center' THEN 'baseline' ELSE 'center' END) END,
  CASE WHEN off_x > 0.055 THEN 'Primary product body is shifted too far ' || CASE WHEN center_x > 0.5 THEN 'right' ELSE 'left' END END,
  CASE WHEN edge < 0.012 THEN 'Full product/accessory extent is touching or nearly touching the image edge' END], lambda x: x IS NOT NULL) AS issues,
  greatest(0.0, least(100.0, 100.0 - least(38.0, abs(ratio - 1) * 120) - least(22.0, abs(frame_ratio - 1) * 62) - least(18.0, abs(fix_scale - 1) * 115) - least(12.0, abs(x_shift) * 180) - least(12.0, abs(y_shift) * 180) - least(24.0, off_x * 260)
    - CASE WHEN n >= 2 THEN least(20.0, abs(line - align_median) * 180) ELSE 0.0 END - CASE WHEN suspect THEN 25.0 ELSE 0.0 END)) AS score FROM flags)
"""


@query(f"WITH {SCORED_SQL} SELECT page_id, pos, array_to_string(issues, ' | ') AS issues, CASE WHEN len(issues) > 0 THEN 'review' ELSE 'pass' END AS status, round(score, 4) AS consistency_score, round(fix_scale, 6) AS fix_scale, anchor FROM scored")
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in order, status and score of each item."""
    rows = score_items(analysed(catalog(spark, sf_dir)))
    return rows.select("page_id", "pos", F.array_join("issues", " | ").alias("issues"), "status", F.round("consistency_score", 4).alias("consistency_score"), F.round("normalizer_recommended_scale", 6).alias("fix_scale"), F.col("normalizer_anchor_mode").alias("anchor"))


@query(f"WITH {SCORED_SQL} SELECT page_id, CAST(count(*) AS BIGINT) AS analyzed_count, CAST(count(*) FILTER (len(issues) > 0) AS BIGINT) AS flagged_count, CAST(0 AS BIGINT) AS failed_count, 'success' AS scan_status, 100.0::DOUBLE * (count(*) - count(*) FILTER (len(issues) > 0)) / count(*) AS page_score, 'full' AS confidence FROM scored GROUP BY page_id")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page."""
    return page_summary(score_items(analysed(catalog(spark, sf_dir))))


@query("""SELECT page_id, regexp_extract(url, '[?&](page|paged|pageno|page_no|page-number|page_number|pg|product-page|product_page)=([0-9]+)', 2) AS number, regexp_matches(url, '[?&](page|paged|pageno|page_no|page-number|page_number|pg|product-page|product_page)(=|&|$)') AS paginated,
regexp_matches(url, '^https?://') AS public FROM pages""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers and listings of the pages' addresses."""
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce(page_number(url).cast("string"), F.lit("")).alias("number"), is_paginated(url).alias("paginated"), is_public_literal(url).alias("public"))


_KEY = "CASE WHEN regexp_matches(a[1], '^https?://[^/]*/*$') THEN rtrim(a[1], '/') || '/' ELSE rtrim(a[1], '/') END || coalesce('?' || array_to_string(list_sort(string_split(a[2], '&')), '&'), '')"


@query(f"SELECT page_id, {_KEY} AS http_key, {_KEY} AS listing_key FROM (SELECT page_id, string_split(string_split(url, '#')[1], '?') AS a FROM pages)")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical keys of the pages' addresses."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", canonical_http_url("url").alias("http_key"), canonical_listing_url("url").alias("listing_key"))



_EVENT = "CASE event_id % 4 WHEN 0 THEN 'keep_original' WHEN 1 THEN 'use_fixed' WHEN 2 THEN 'complete_rework' ELSE 'reset' END"


@query(f"""WITH {SCORED_SQL}, last AS (SELECT user_id % 3000 AS pos, arg_max({_EVENT}, event_id) AS d FROM events GROUP BY 1)
SELECT s.pos, CASE WHEN d IN ('keep_original', 'use_fixed') THEN 'pass' WHEN d = 'complete_rework' THEN 'review' WHEN len(issues) > 0 THEN 'review' ELSE 'pass' END AS status, CASE WHEN d <> 'reset' THEN d END AS operator_decision, CASE WHEN len(issues) > 0 THEN 'review' ELSE 'pass' END AS auto_status
FROM scored s LEFT JOIN last USING (pos)""")
def operator_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision of each item, from events."""
    return _decided(spark, sf_dir).select("pos", "status", "operator_decision", "auto_status")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 3000).alias("pos"), F.expr(_EVENT).alias("decision"), F.col("event_id").alias("seq"))
    return decide(score_items(analysed(catalog(spark, sf_dir))), latest_decisions(events, ["pos"]), ["pos"])


_FIX = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + f" THEN '{fix}'" for words, fix in FIXES) + f" ELSE '{OTHER_FIX}' END"


@query(f"""WITH {SCORED_SQL}, fixed AS (SELECT pos, score, issues, list_transform(issues, lambda x: {_FIX}) AS f FROM scored)
SELECT pos, CASE WHEN len(issues) = 0 THEN 'No correction required.' ELSE array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ' ') END AS suggested_fix,
CASE WHEN len(list_filter(issues, lambda x: contains(lower(x), 'foreground detection'))) > 0 THEN 'Manual review' WHEN score < 55 OR len(issues) >= 3 THEN 'High' WHEN score < 78 OR len(issues) >= 2 THEN 'Medium' WHEN len(issues) > 0 THEN 'Low' ELSE 'Pass' END AS issue_level FROM fixed""")
def suggested_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in order, each once, and the level of each item's issues."""
    rows = score_items(analysed(catalog(spark, sf_dir)))
    return rows.select("pos", suggested_fix(F.col("issues")).alias("suggested_fix"), issue_level(F.col("consistency_score"), F.col("issues")).alias("issue_level"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = {"main_category": F.lit("Home Appliances"), "subcategory": F.coalesce("item_category", F.lit("")), "page_label": F.col("page_id"), "page_url": F.concat(F.lit("https://shop.example.com/c/"), F.col("page_id")), "effective_category": F.lit(None).cast("string")}
    return audit_rows(_decided(spark, sf_dir).withColumns(page))


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit table with its export headings."""
    return export(_audit(spark, sf_dir))


QUERIES["audit_table"] = audit_table


@query(f"""WITH {SCORED_SQL}, last AS (SELECT user_id % 3000 AS pos, arg_max({_EVENT}, event_id) AS d FROM events GROUP BY 1)
SELECT 'Home Appliances' AS main_category, coalesce(item_category, 'General') AS subcategory, page_id AS page_label, count(*) AS products FROM scored LEFT JOIN last USING (pos)
WHERE CASE WHEN d IN ('keep_original', 'use_fixed', 'complete_rework') THEN true ELSE len(issues) > 0 END GROUP BY ALL""")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, F8: the audit's products for each category, subcategory and page."""
    return hierarchy(_audit(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, last AS (SELECT user_id % 3000 AS pos, arg_max({_EVENT}, event_id) AS d FROM events GROUP BY 1),
shown AS (SELECT coalesce(d IN ('keep_original', 'use_fixed', 'complete_rework'), false) AS decided, len(issues) > 0 AS flagged FROM scored LEFT JOIN last USING (pos))
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS manual_edits, count(*) FILTER (decided) AS manual_decisions FROM shown WHERE decided OR flagged""")
def audit_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, edits and decisions of the audit table."""
    return snapshot_summary(_audit(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(condition)
    return rows.select(F.col("o_orderpriority").alias("main_category"), F.col("o_orderstatus").alias("subcategory"), F.concat(F.lit("Page "), F.col("o_custkey") % 50).alias("page_label"), F.lit("").alias("page_url"), F.lit("x").alias("product_name"),
                       F.concat(F.lit("https://shop.example.com/o/"), F.col("o_orderkey") % 4000).alias("product_url"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))


_ROWS = "SELECT o_orderpriority AS m, o_orderstatus AS s, 'Page ' || (o_custkey % 50) AS p, 'https://shop.example.com/o/' || (o_orderkey % 4000) AS u, o_totalprice AS price, o_orderkey AS seq FROM orders WHERE"
_OLD, _FRESH = " o_orderdate < TIMESTAMP '2001-07-01 00:00:00'", " o_orderdate >= TIMESTAMP '2001-07-01 00:00:00'"  # all orders are on one side
_DEDUPED = "SELECT m, s, p, u, arg_max(price, seq) AS price, min(seq) AS seq FROM ({0}) GROUP BY m, s, p, u"


@query(f"""WITH old AS ({_DEDUPED.format(_ROWS + _OLD)}), fresh AS ({_DEDUPED.format(_ROWS + _FRESH)}),
kept AS (SELECT * FROM old ANTI JOIN (SELECT DISTINCT m, s, p FROM fresh) USING (m, s, p))
SELECT m AS main_category, s AS subcategory, p AS page_label, u AS product_url, price, part FROM (SELECT *, 0 AS part FROM kept UNION ALL SELECT *, 1 AS part FROM fresh)""")
def master_replace_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of new rows replace the stored ones."""
    out, _ = upsert(_orders(spark, sf_dir, _OLD), _orders(spark, sf_dir, _FRESH))
    return out.select("main_category", "subcategory", "page_label", "product_url", "price", "part")


@query(f"""WITH old AS ({_DEDUPED.format(_ROWS + _OLD)}), fresh AS (SELECT * FROM ({_DEDUPED.format(_ROWS + _FRESH)}) ANTI JOIN old USING (m, s, p, u))
SELECT (SELECT count(*) FROM old) AS before, (SELECT count(*) FROM old) + (SELECT count(*) FROM fresh) AS after, (SELECT count(*) FROM fresh) AS added, CAST(0 AS BIGINT) AS removed""")
def master_append_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What appending adds."""
    return upsert(_orders(spark, sf_dir, _OLD), _orders(spark, sf_dir, _FRESH), "append")[1]


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT page_id, own_key AS group_key, profile, CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN height_occupancy ELSE width_occupancy END AS side, baseline_y AS b FROM grouped),
g AS (SELECT page_id, group_key, profile, count(*) AS n, list_sort(list(side))[count(*) // 2 + 1] AS side, list_sort(list(b))[count(*) // 2 + 1] AS b FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT page_id, group_key, profile, n, CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN greatest(0.40, least(0.90, format('{{:.4f}}', side)::DOUBLE)) END AS target_height, CASE WHEN profile NOT IN ('tall', 'boxy', 'compact') THEN greatest(0.38, least(0.92, format('{{:.4f}}', side)::DOUBLE)) END AS target_width,
CASE WHEN profile IN ('tall', 'boxy', 'compact') THEN greatest(0.68, least(0.97, format('{{:.4f}}', b)::DOUBLE)) END AS baseline FROM g""")
def page_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: targets of each page's own groups."""
    return calibration(analysed(catalog(spark, sf_dir)))


@query("""WITH n AS (SELECT p_partkey // 40 AS page_id, p_partkey AS pos, 'A/B: ' || p_partkey % 7 AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY pos) AS nth FROM n)
SELECT page_id, pos, replace(replace(name, '/', '_'), ':', '_') || '__' || left(sha256(name), 8) || CASE WHEN nth > 1 THEN '__' || nth ELSE '' END AS file_name FROM r""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names, unique on each page of 40 items."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey div 40 AS page_id", "p_partkey AS pos", "'A/B: ' || CAST(p_partkey % 7 AS STRING) AS name")
    return unique_names(rows).select("page_id", "pos", "file_name")


_NUMBERED = r"""WITH p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS listing_id, page_id, url, TRY_CAST(nullif(regexp_extract(url, '[?&](page|paged|pageno|page_no|page-number|page_number|pg|product-page|product_page)=([0-9]+)', 2), '') AS BIGINT) AS n FROM pages),
u AS (SELECT listing_id, n - row_number() OVER (PARTITION BY listing_id ORDER BY n) AS below FROM (SELECT DISTINCT listing_id, n FROM p WHERE n IS NOT NULL)),
w AS (SELECT listing_id, url, page_id, row_number() OVER (PARTITION BY listing_id ORDER BY page_id) AS j FROM p WHERE n IS NULL),
f AS (SELECT w.listing_id, w.url, w.page_id, j + count(u.below) AS n FROM w LEFT JOIN u ON w.listing_id = u.listing_id AND u.below < j GROUP BY w.listing_id, w.url, w.page_id, j)
SELECT listing_id, url, CAST(n AS BIGINT) AS page_number, 'Page ' || n AS page_label FROM (SELECT listing_id, url, n FROM p WHERE n IS NOT NULL UNION ALL SELECT listing_id, url, n FROM f)"""


@query(_NUMBERED)
def listing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for all pages of each host's listing."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "://([^/]*)", 1).alias("listing_id"), F.col("page_id").alias("pos"), "url", page_number(F.col("url")).alias("page_number"))
    return number_pages(pages, None)


def undo_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's record, undo and redo events leave."""
    ops = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("product_key"), F.col("event_id").alias("seq"), F.expr("CASE event_id % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'redo' ELSE 'record' END").alias("op"), F.col("event_type").alias("state"))
    return edit_history(ops).select("product_key", F.array_join("states", ",").alias("states"), "index")


QUERIES["undo_histories"] = undo_histories


def settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items under review, and a library of remembered settings."""
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("https://X.example/p/"), F.col("c_custkey") % 100, F.lit("/?q=1")).alias("product_url"), F.concat(F.lit("Model "), F.col("c_nationkey") % 5).alias("name"), F.lit("").alias("item_category"), F.lit("").alias("item_archetype"))
    library = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("identity"), F.concat(F.lit("https://x.example/p/"), F.col("s_suppkey")).alias("product_url"), F.concat(F.lit("model "), F.col("s_nationkey") % 5).alias("normalized_name"),
                                                                               F.lit("").alias("category"), F.lit("").alias("archetype"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("Z")).alias("saved_at"), F.lit(None).cast("string").alias("updated_at"), F.lit("bad").alias("created_at"))
    return items, library


@query("""WITH t AS (SELECT c_custkey AS item_id, c_nationkey % 5 AS k, c_mktsegment AS c FROM customer), e AS (SELECT s_suppkey AS identity, s_nationkey % 5 AS k, s_nationkey AS n FROM supplier),
m AS (SELECT item_id, identity, CASE WHEN item_id % 100 = identity THEN 100 ELSE 75 END AS score, e.n FROM t JOIN e ON item_id % 100 = identity OR t.k = e.k),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n DESC, lpad(identity::VARCHAR, 6, '0')) AS rank FROM m)
SELECT item_id, identity, score AS match_score, rank FROM r WHERE rank <= 4""")
def remembered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best remembered entries of each item, by address, then by name, the newest first."""
    items, library = settings(spark, sf_dir)
    return exception_suggestions(items, library).select("item_id", F.col("identity").cast("long").alias("identity"), "match_score", "rank")


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN 'dom' ELSE 'jsonld' END AS source, item_category FROM items)
SELECT page_id, source, count(*) AS n, count(item_category) AS known FROM r GROUP BY ALL""")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by page and source, and how many have a category."""
    rows = analysed(catalog(spark, sf_dir)).withColumn("source", F.when(F.col("pos") % 2 == 0, "dom").otherwise("jsonld"))
    return rows.groupBy("page_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count("item_category").alias("known"))


@query(f"""WITH {SCORED_SQL} SELECT pos, round(greatest(0.0, least(100.0, 100.0 - least(28.0, abs(frame_ratio - 1) * 70) - least(22.0, abs(fix_scale - 1) * 120) - least(18.0, abs(x_shift) * 180) - least(18.0, abs(y_shift) * 180) - CASE WHEN suspect THEN 25.0 ELSE 0.0 END)), 4) AS consistency_score,
CAST(CASE WHEN suspect THEN 1 ELSE (frame_ratio < 1.0 - tolerance OR frame_ratio > 1.0 + tolerance)::INT + f_frame::INT + f_fix::INT + (abs(x_shift) > 0.028)::INT + (abs(y_shift) > 0.028)::INT END + (off_x > 0.055)::INT + (edge < 0.012)::INT AS INT) AS n_issues FROM scored""")
def single_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item scored by itself."""
    rows = score_single(analysed(catalog(spark, sf_dir)))
    return rows.select("pos", F.round("consistency_score", 4).alias("consistency_score"), F.col("issue_count").alias("n_issues"))
